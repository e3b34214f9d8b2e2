import random

from pyspark.sql import functions as F

import corpus_pipeline
from leadrank.llm import components, near_copies
from tests.llm.samples import awkward, nothing


def edited(rng, words, changes):
    words = list(words)
    for place in rng.sample(range(len(words)), changes):
        words[place] = f"x{rng.random()}"
    return words


def test_the_stage_keeps_one_of_each_component_of_likeness(spark):
    rng = random.Random(5)
    texts = {}
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 150, 400]))]
        for changes in (0, 1, len(base) // 60, len(base) // 45, len(base) // 25):
            texts[len(texts)] = " ".join(edited(rng, base, changes))
    base = [f"h{n}" for n in range(300)]
    for _ in range(60):
        texts[len(texts)] = " ".join(edited(rng, base, rng.randint(1, 6)))
    sets = {n: near_copies.shingles(t) for n, t in texts.items()}
    root = {n: n for n in texts}
    for a in texts:
        for b in range(a):
            if near_copies.likeness(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {n: low if r == high else r for n, r in root.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    kept = corpus_pipeline.keep_one_of_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def exact_classes(texts):
    sets = {n: near_copies.shingles(t) for n, t in texts.items()}
    root = {n: n for n in texts}
    for a in texts:
        for b in range(a):
            if root[a] != root[b] and near_copies.likeness(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {n: low if r == high else r for n, r in root.items()}
    return root


def test_clusters_of_many_parts_lose_no_link(spark):
    """Copies of one text, stragglers that reach it only through others, and copies that are unlike one another."""
    rng = random.Random(8)
    base = [f"h{n}" for n in range(200)]
    texts = {n: " ".join(edited(rng, base, rng.randint(1, 12))) for n in range(160)}
    chain = list(base)
    for _ in range(12):
        chain = edited(rng, chain, 2)
        texts[len(texts)] = " ".join(chain)
    root = exact_classes(texts)
    named = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = named.select(near_copies.digests("text").alias("fp"), "text", "doc_id")
    for shingles in (10**9, 3_000, 900):
        ids = {bytes(r.fp): r.doc_id for r in rows.collect()}
        found = {n: n for n in texts}
        for edge in near_copies.links(rows, shingles).collect():
            u, v = sorted((found[ids[bytes(edge.u)]], found[ids[bytes(edge.v)]]))
            found = {n: u if r == v else r for n, r in found.items()}
        assert found == root


def test_what_is_compared_grows_with_the_group(spark):
    """Rows that reach the search: one a text, however many texts meet without being alike."""
    rng = random.Random(9)
    base = [f"h{n}" for n in range(300)]
    for copies in (100, 200, 400):
        texts = [(n, " ".join(edited(rng, base, 9))) for n in range(copies)]
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
        rows = near_copies.clusters(docs.select(near_copies.digests("text").alias("fp"), "text"))
        assert rows.count() <= copies and rows.select("fp").distinct().count() == rows.count()


def test_texts_meet_before_they_are_shuffled(spark):
    """Copies leave the map task as a row a band, near copies as a link each; names are those that Spark works out."""
    rng = random.Random(10)
    base = [f"h{n}" for n in range(300)]
    texts = [" ".join(base)] * 300 + [" ".join(edited(rng, base, 1)) for _ in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rows = docs.mapInArrow(near_copies._banded, "band long, name long, link long").collect()
    assert len(rows) < len(texts) * near_copies.BANDS / 2
    named = docs.select(F.xxhash64(near_copies.digests("text")).alias("name")).distinct().collect()
    assert {r.name for r in rows} == {r.name for r in named}


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "1 as rank", "2 as copies", "3 as fp", "4 as __rank")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 5, 8, None], key=str)
    assert near_copies.keep_one(nothing(spark)).count() == 0


def test_searches_leave_stars_that_take_no_round(spark, monkeypatch):
    """A chain of near copies in one part comes out as a star around the smallest digest, and components are done at once."""
    rng = random.Random(11)
    chain, texts = [f"h{n}" for n in range(200)], []
    for _ in range(30):
        chain = edited(rng, chain, 2)
        texts.append((" ".join(chain),))
    rows = spark.createDataFrame(texts, "text string").repartition(3).select(near_copies.digests("text").alias("fp"), "text")
    edges = near_copies.links(rows)
    found = {(bytes(e.u), bytes(e.v)) for e in edges.collect()}
    assert len(found) > 20 and len({u for u, _ in found}) == len(found)
    assert all(v < u for u, v in found) and not {u for u, _ in found} & {v for _, v in found}
    monkeypatch.delattr(components, "_small_star")
    assert {(bytes(e.u), bytes(e.v)) for e in components.components(edges).collect()} == found


def test_components_of_chains_and_hubs(spark):
    """Nodes end at the smallest of their component, with no round after the edges have become stars."""
    rng = random.Random(12)
    names = rng.sample(range(10_000), 900)
    pairs = [(names[n], names[n + 1]) for n in range(200)] + [(names[300], names[n]) for n in range(301, 600)]
    pairs += [(names[rng.randrange(600, 900)], names[rng.randrange(600, 900)]) for _ in range(200)]
    root = {n: n for n in names}
    for u, v in pairs:
        low, high = sorted((root[u], root[v]))
        root = {n: low if r == high else r for n, r in root.items()}
    edges = spark.createDataFrame([*pairs, *pairs[:50], (5, 5)], "u long, v long").repartition(3)
    rows = components.components(edges).collect()
    assert sorted((r.u, r.v) for r in rows) == sorted((n, r) for n, r in root.items() if n != r)
