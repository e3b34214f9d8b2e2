import random

import numpy as np
import pytest
import xxhash

from leadrank.llm import simhash
from tests.llm.samples import AWKWARD, awkward, nothing


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum((sum(h >> bit & 1 for h in hashes) * 2 > len(hashes)) << bit for bit in range(64))


def lowest_reachable(prints):
    """Component of each fingerprint by comparing all pairs."""
    left, found = set(prints), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            node = todo.pop()
            group.add(node)
            near = {other for other in left if bin(node ^ other).count("1") <= 3}
            left -= near
            todo += near
        found |= dict.fromkeys(group, min(group))
    return found


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_every_value_meets_each_neighbour_at_an_anchor():
    rng = random.Random(1)
    for _ in range(200):
        value = rng.getrandbits(31)
        near = [value] + [value ^ (1 << bit) for bit in range(31)]
        index, words = simhash.anchors(np.array(near, np.uint64))
        sets = [set(words[index == n].tolist()) for n in range(32)]
        assert all(sets[0] & other for other in sets[1:])
        assert {len(s) for s in sets} <= {1, 16}
        assert all(bin(w ^ near[n]).count("1") <= 2 for n, s in enumerate(sets) for w in s)


@pytest.mark.parametrize("limit", [16_384, 20])
def test_components_equal_those_of_all_pairs(spark, limit):
    rng = random.Random(limit)
    prints = set()
    for _ in range(25):
        chain = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(chain)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                chain ^= 1 << bit
    dense = rng.getrandbits(64)
    prints |= {dense ^ sum(1 << bit for bit in rng.sample(range(0, 60, 6), rng.randint(0, 5))) for _ in range(150)}
    frame = spark.createDataFrame([(signed(p), signed(p)) for p in prints], "fp long, first_id long").repartition(4)
    expected = lowest_reachable({p for p in prints})
    found = {row.fp: row.component_id for row in simhash.classes(frame, limit).collect()}
    groups = {}
    for p in prints:
        groups.setdefault(expected[p], set()).add(signed(p))
    assert {frozenset(g) for g in groups.values()} == {
        frozenset(fp for fp in found if found[fp] == c) for c in set(found.values())
    }
    assert all(found[fp] == min(g) for g in groups.values() for fp in g)


def test_awkward_rows(spark):
    rows = simhash.simhash_components(awkward(spark)).collect()
    texts = {row[0]: row[1] for row in AWKWARD}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in AWKWARD)
    for row in rows:
        assert row.fingerprint == f"{plain_fingerprint(texts[row.doc_id]):016x}"
    component = {row.doc_id: row.component_id for row in rows}
    assert component[2] == component[3] == component[4] == 2 and component[6] == component[1] == 1
    assert component[None] is None and component[5] == 5
    assert simhash.simhash_components(nothing(spark)).collect() == []


def test_one_row_of_each_component_stays(spark):
    docs = awkward(spark)
    kept = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 2, 5, 8, None], key=str)
    assert simhash.keep_one(docs).columns == docs.columns
    twice = docs.where("doc_id = 6")
    assert twice.count() == 2 and simhash.keep_one(twice).count() == 1
    assert simhash.keep_one(nothing(spark)).count() == 0
