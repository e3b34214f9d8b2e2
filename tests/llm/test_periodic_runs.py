import hashlib
import random
import zlib

import numpy as np

from leadrank.llm import periodic_runs as runs, queries
from tests.conftest import TEST_DATA
from tests.llm.samples import awkward, nothing


def plain(codes):
    """Period by period: maximal stretches in which words that far apart are equal, unless a smaller period has them too."""
    codes, found = np.asarray(codes, np.int64), []
    for q in range(1, len(codes) // 4 + 1):
        same = np.concatenate(([0], (codes[:-q] == codes[q:]).astype(np.int8), [0]))
        edges = np.diff(same)
        for start, stop in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            length = stop - start + q
            smaller = any(a <= start and start + length <= a + b for a, b, p in found if p < q)
            if length >= max(6, 4 * q) and not smaller:
                found.append((start, length, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def test_equals_the_plain_rule():
    rng = random.Random(0)
    for _ in range(3000):
        letters, n = rng.choice([1, 2, 3, 5, 40]), rng.randrange(70)
        codes = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            start = rng.randrange(n + 1)
            period = 1 + (n - start) // rng.randrange(3, 11)
            codes[start:n] = [codes[start + i % period] for i in range(n - start)]
        assert runs.runs_of(np.array(codes, np.int64)) == plain(codes)


def test_overlapping_nested_and_special_words():
    thue = [bin(n).count("1") % 2 for n in range(4096)]
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    nested = ([0] * 7 + [1]) * 9 + [2] + [3, 4] * 5 + [4, 3] * 5
    for codes in (thue, b, nested, [0] * 5000, list(range(50)) * 6, [0, 1] * 3 + [0], [0] * 5, [0] * 6):
        assert runs.runs_of(np.array(codes, np.int64)) == plain(codes)


def test_squares_are_found_by_recoloured_segments():
    rng = random.Random(4)
    for _ in range(300):
        codes = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        expected = set()
        for end in range(len(codes)):
            for q in range(1, (end + 1) // 2 + 1):
                half = codes[end - q + 1 : end + 1]
                primitive = not any(q % d == 0 and half == half[:d] * (q // d) for d in range(1, q))
                if primitive and codes[end - 2 * q + 1 : end - q + 1] == half:
                    expected.add((q, end))
        found = list(runs.squares(codes))
        assert set(found) == expected and len(found) == len(expected)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if n and h % 10 == 0 and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    numbers = {word: i for i, word in enumerate(dict.fromkeys(words))}
    found = plain([numbers[word] for word in words])
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id,
        len(found),
        *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        digest("".join(f"{s},{length},{q}\n" for s, length, q in found)),
        digest(b" ".join(word for i, word in enumerate(words) if i not in gone).decode()),
    )


def test_query_equals_the_plain_rule_on_whole_texts(spark):
    folder = f"{TEST_DATA}/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op13_runs(spark, folder)
    assert dict(found.dtypes) == {name: "string" if name.endswith("sha256") else "bigint" for name in found.columns}
    found = sorted(map(tuple, found.collect()))
    assert found == sorted(expected_row(*row) for row in rows)
    assert sum(row[1] > 0 for row in found) > 5


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "1 as row", "2 as found", "'x' as runs", "'y' as `a.b`")
    out = runs.with_runs(docs)
    assert out.columns == [c for c in docs.columns if c != "runs"] + ["runs", "collapsed"]
    by_id = {r.doc_id: r for r in out.collect()}
    assert [tuple(r) for r in by_id[5].runs] == [(0, 100_000, 5)] and by_id[5].collapsed == "lorem ipsum dolor sit amet"
    assert by_id[2].runs == [] and by_id[2].collapsed == by_id[3].collapsed == by_id[4].collapsed == ""
    assert out.count() == 9 and runs.with_runs(nothing(spark)).count() == 0
