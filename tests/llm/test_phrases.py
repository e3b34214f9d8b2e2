import random
import re
from collections import Counter

from leadrank.llm import phrases
from tests.llm.samples import awkward, nothing

UPPER = {n: n + 32 for n in range(65, 91)}


def plain(rows, least, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        mine = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            mine.update(" ".join(words[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(words) - k + 1))
    out = []
    for lang, mine in counts.items():
        kept = {p: a for p, a in mine.items() if a >= least and " " in p}
        found = []
        for phrase, a in kept.items():
            words = phrase.split(" ")
            cuts = []
            for k in range(1, len(words)):
                left, right = mine[" ".join(words[:k])], mine[" ".join(words[k:])]
                cuts.append((2_000_000 * a // (left + right), k, left, right))
            score, _, left, right = min(cuts)
            if not any(100 * b >= 80 * a and f" {phrase} " in f" {longer} " for longer, b in kept.items() if longer != phrase):
                found.append((-score, -a, phrase.encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def sample(rng, texts):
    words = ["the", "The", "new", "york", "city", "Ünï", "of", "日本", "a.b", "x" * 30, "c", "d"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!?", " ", " . "]
    join = lambda: "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(60)))
    rows = [(rng.choice(["en", "fr", None]), join()) for _ in range(texts)]
    return rows + [("en", "new york city " * 50), ("en", None), (None, ""), ("und", "c d c d c d"), ("en", rows[0][1])]


def test_equals_the_plain_rule(spark):
    rows = sample(random.Random(1), 80)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for least, top, period in ((1, 10_000, 1), (2, 50, 4), (5, 10_000, 32), (10_000, 5, 32)):
        found = phrases.collocations(docs, least=least, top=top, period=period)
        assert sorted(map(tuple, found.collect())) == plain(rows, least, top)
        assert set(dict(found.drop("lang", "phrase").dtypes).values()) == {"bigint"}


def test_each_start_belongs_to_one_chunk():
    rng = random.Random(2)
    for period in (1, 2, 5, 1000):
        found = [b"%d" % rng.randrange(5) for _ in range(300)]
        parts = [c.split(b" ") for c in phrases.chunks(b" ".join(found), period)]
        owned = [part[: len(part) - phrases.SHARED] for part in parts]
        assert [token for part in owned for token in part] == found
        for a, b in zip(parts, owned[1:] + [[phrases.BREAK] * 3]):
            assert len(b) < 3 or a[-3:] == b[:3]


def test_copies_share_their_chunks(spark):
    text = " ".join(f"w{n}" for n in range(400))
    docs = spark.createDataFrame([("en", f"own{n} {text}") for n in range(50)], "lang string, text string")
    rows = phrases.parse(docs, period=8).collect()
    assert len(rows) < 50 + 80 and max(r.weight for r in rows) == 50


def test_scores_of_huge_counts_are_exact(spark):
    big = 9_000_000_000_000_000_001
    counts = spark.createDataFrame([("en", "a b", big, 2), ("en", "a", big, 1), ("en", "b", big, 1)], "lang string, phrase string, a long, size int")
    row = phrases._lowest_cut(counts.where("size = 2"), counts).first()
    assert row.score == 1_000_000 and phrases._uncovered(counts.where("size = 2"), counts).count() == 1


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "1 as chunk", "2 as weight", "'x' as phrase", "3 as count")
    found = phrases.collocations(docs)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(map(tuple, found.collect())) == plain(rows, 30, 2000)
    assert phrases.collocations(nothing(spark)).count() == 0
