import hashlib
import random

import pytest

from leadrank.llm import minhash
from tests.llm.samples import awkward, nothing


def shingles(text):
    words = text.encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, rows, partitions=3):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    found = {row.doc_id: row for row in minhash.fingerprinted(frame).collect()}
    ordered = sorted(rows, key=lambda row: (row[0] is None, row[0]))
    errors = []
    for place, (key, text) in enumerate(ordered):
        text, follow = text or "", ordered[(place + 1) % len(ordered)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + follow[:quarter]
        row = found[key]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [row.near_edited - alike(text, edited), row.near_next - alike(text, follow)]
    return found, errors


@pytest.mark.parametrize("group", [4000, 7])
def test_likeness_is_near_the_share_of_common_shingles(spark, monkeypatch, group):
    monkeypatch.setattr(minhash.with_next, "__defaults__", (group,))
    rng = random.Random(5)
    rows = [(n * n * 1000 + rng.randrange(50), " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 300)))) for n in range(60)]
    rows += [(None, "the last one"), (-5, "first of all"), (10**15, "far away")]
    rows += [(4_000_001 + n, " ".join(rows[n][1].split()[: 10 + n])) for n in range(20)]
    _, errors = check(spark, rows)
    assert sum(errors) / len(errors) == pytest.approx(0, abs=0.02)
    assert sum(map(abs, errors)) / len(errors) < 0.04 and max(map(abs, errors)) < 0.2


def test_equal_texts_and_texts_without_words(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, " \n"), (6, "one")]
    found, _ = check(spark, rows)
    assert found[1].fingerprint == found[2].fingerprint and found[1].near_next == 1.0
    assert {found[n].fingerprint for n in (3, 4, 5)} == {""} and found[3].near_next == 1.0 and found[2].near_next == 0.0
    assert len(found[6].fingerprint) == 2 * minhash.BINS
    (alone,) = check(spark, [(9, "a b c d e f g h")])[0].values()
    assert alone.near_next == 1.0


def test_awkward_rows(spark):
    rows = minhash.fingerprinted(awkward(spark).selectExpr("*", "1 as bins", "2 as tie")).collect()
    assert len(rows) == 9 and len({r.fingerprint for r in rows if r.doc_id in (1, 6)}) == 1
    assert minhash.fingerprinted(nothing(spark)).count() == 0
