import random

import numpy as np

from leadrank.llm import tiling
from tests.llm.samples import awkward, nothing


def plain_tiles(item, doc, least=5):
    """The longest match of what is unmarked, again and again."""
    marked_i, marked_d, done = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while (
                    i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k]
                    and not marked_i[i + k] and not marked_d[d + k]
                ):
                    k += 1
                if k > best[0]:
                    best = (k, i, d)
        if best[0] < least:
            return done
        words, i, d = best
        marked_i[i : i + words] = marked_d[d : d + words] = [True] * words
        done.append(best)


def test_tiles_equal_the_plain_rule():
    rng = random.Random(3)
    for _ in range(120):
        alphabet = rng.choice([2, 3, 8, 50])
        item = [rng.randrange(alphabet) for _ in range(rng.randrange(40))]
        doc = [rng.randrange(alphabet) for _ in range(rng.randrange(50))]
        if item and rng.random() < 0.6:
            cut = rng.randrange(len(item))
            doc[5:5] = item[cut:] + item[:cut]
        assert tiling.tiles(np.array(item, np.uint64), np.array(doc, np.uint64)) == plain_tiles(item, doc)


def sentence(rng, words):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(words))


def test_leaks_equal_the_plain_rule(spark):
    rng = random.Random(7)
    items = [(n, sentence(rng, rng.randint(3, 40))) for n in range(30)] + [(30, None), (31, ""), (32, "a " * 30)]
    items.append((33, items[9][1]))
    docs = []
    for n in range(120):
        words = sentence(rng, 60).split()
        if n % 3 == 0:
            leak = rng.choice(items)[1] or ""
            parts = leak.split()
            cut = rng.randrange(len(parts) + 1)
            words[20:20] = (parts[cut:] + ["between"] + parts[:cut])[: rng.choice([12, 100])]
        docs.append((n, "; ".join(words).upper()))
    docs += [(None, items[5][1]), (121, "a " * 200), (122, docs[0][1]), (122, docs[0][1])]
    coder = tiling.Coder()
    expected = set()
    for doc_id, text in docs:
        for item_id, item in items:
            codes = coder(item).tolist()
            covered = sum(t[0] for t in plain_tiles(codes, coder(text).tolist())) / max(1, len(codes))
            if covered >= 0.8:
                expected.add((doc_id, item_id, round(covered, 6)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    found = tiling.leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id, round(r.coverage, 6)) for r in found} == expected
    assert len([r for r in found if r.doc_id == 122]) == 2 * len([r for r in found if r.doc_id == 0])
    clean = tiling.decontaminated(frame, bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in docs if d not in {e[0] for e in expected})


def test_awkward_rows(spark):
    docs = awkward(spark)
    items = docs.selectExpr("doc_id as item_id", "text").where("item_id = 1")
    assert sorted(r.doc_id for r in tiling.leaks(docs, items).collect()) == [1, 6, 6]
    assert tiling.decontaminated(docs, items).count() == 6
    assert tiling.decontaminated(docs, items.limit(0)).count() == 9
    assert tiling.leaks(nothing(spark), items).count() == 0
