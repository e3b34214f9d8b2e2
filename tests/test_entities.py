"""Company resolution and trigger de-duplication against the rules applied one by one."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from leadrank.operators import matching
from leadrank.operators.ids import assign_ids
from leadrank.operators.key_filter import with_any_key
from leadrank.operators.matching import first_come_matching
from leadrank.operators.resolve import company_snapshot, resolve_companies
from leadrank.operators.triggers import dedup_triggers, eligible_triggers
from leadrank.schemas import TABLES
from leadrank.session import cut_lineage


def one_by_one(candidates, companies):
    companies, placed = [dict(company) for company in companies], []
    for candidate in candidates:
        domain, name = candidate["domain"], candidate["name"]
        matches = [c for c in companies if domain and c["domain"] == domain] or [
            c for c in companies if c["name"] == name and not (domain and c["domain"] and c["domain"] != domain)
        ]
        if len(matches) == 1:
            company = matches[0]
            company["domain"] = company["domain"] or domain
        else:
            company = {"id": len(companies) + 1, "name": name, "domain": domain}
            companies.append(company)
        placed.append(company["id"])
    return placed, companies


def candidate_frame(spark, candidates, step=1):
    rows = [
        (i * step, c["name"], c["domain"] and f"https://{c['domain']}/x", "l") for i, c in enumerate(candidates)
    ]
    return spark.createDataFrame(rows, "ord long, company_name string, website string, location string")


def company_frame(spark, companies, as_of):
    rows = [(c["id"], c["name"], c["name"], None, c["domain"], "l", as_of, as_of) for c in companies]
    return spark.createDataFrame(rows, TABLES["companies"])


def worlds(seed, count):
    """Many small independent cases in one input, so that one job checks them all."""
    rng, candidates, companies = random.Random(seed), [], []
    for world in range(count):
        domains = [None] * rng.randint(1, 5) + [f"w{world}-{i}.example" for i in range(rng.randint(0, 6))]
        names = [f"n{world}-{i}" for i in range(rng.randint(1, 3))]
        used = set()
        for _ in range(rng.randint(0, 3)):
            domain = rng.choice(domains)
            domain = None if domain in used else domain
            used.add(domain)
            companies.append({"id": len(companies) + 1, "name": rng.choice(names), "domain": domain})
        candidates += [{"name": rng.choice(names), "domain": rng.choice(domains)} for _ in range(rng.randint(1, 16))]
    rng.shuffle(candidates)
    return candidates, companies


@pytest.mark.parametrize("width, step, partitions", [(1 << 18, 1, 3), (5, 1, 7), (64, 3, 1)])
def test_resolution_equals_the_rule(spark, as_of, width, step, partitions):
    candidates, companies = worlds(width, 150)
    expected, final = one_by_one(candidates, companies)
    stored = company_frame(spark, companies, as_of)
    found = resolve_companies(
        candidate_frame(spark, candidates, step).repartition(partitions), stored, len(companies), width, hot_rows=2
    )
    placed = {row.ord // step: row.company_id for row in found.collect()}
    assert [placed[i] for i in range(len(candidates))] == expected
    snapshot = company_snapshot(stored, found, as_of).collect()
    assert {(row.id, row.normalized_name, row.website_domain) for row in snapshot} == {
        (c["id"], c["name"], c["domain"]) for c in final
    }


def test_one_hot_name_spreads_over_blocks(spark, as_of):
    rng = random.Random(3)
    candidates = [
        {"name": "hot", "domain": None if rng.random() < 0.02 else f"d{i}.example"} for i in range(600)
    ]
    expected, _ = one_by_one(candidates, [])
    found = resolve_companies(candidate_frame(spark, candidates), company_frame(spark, [], as_of), 0, 16)
    placed = {row.ord: row.company_id for row in found.collect()}
    assert [placed[i] for i in range(len(candidates))] == expected


def test_known_cases(spark, as_of):
    def resolve(*candidates, stored=()):
        frame = candidate_frame(spark, [{"name": n, "domain": d} for n, d in candidates])
        found = resolve_companies(frame, company_frame(spark, list(stored), as_of), len(stored))
        rows = sorted(found.collect(), key=lambda row: row.ord)
        return [row.company_id for row in rows], [row.fills_domain for row in rows]

    assert resolve(("株式会社ABC", "www.example.com"), ("ABC株式会社", "example.com"))[0] == [1, 1]
    assert resolve(("ABC", None), ("ABC 株式会社", "example.com")) == ([1, 1], [False, True])
    assert resolve(("ABC", "example.com"), ("ABC", "different.example"))[0] == [1, 2]
    twice = [{"id": 1, "name": "abc", "domain": "a.example"}, {"id": 2, "name": "abc", "domain": "b.example"}]
    assert resolve(("ABC", None), ("ABC", None), stored=twice)[0] == [3, 4]


def print_of(kind, title):
    return hashlib.sha256(f"{kind}|{title}|None".encode()).hexdigest()


def triggers_one_by_one(rows, history):
    stored, found = [(c, t, print_of(t, f), u) for c, t, f, u in history], []
    for company, kind, title, url in rows:
        mark = print_of(kind, title)
        matches = [i for i, s in enumerate(stored) if s[0] == company and s[2] == mark] or [
            i for i, s in enumerate(stored) if s[0] == company and s[1] == kind and s[3] == url
        ]
        if not matches:
            stored.append((company, kind, mark, url))
        found.append((matches[0] + 1, False) if matches else (len(stored), True))
    return found


def observations(spark, rows):
    data = [(i * 3, c, t, f, None, u + "#part") for i, (c, t, f, u) in enumerate(rows)]
    ddl = "ord long, company_id long, trigger_type string, trigger_title string, published_at date, source_url string"
    return spark.createDataFrame(data, ddl)


def trigger_frame(spark, history, as_of):
    data = [
        (i + 1, c, t, f, "", u, "", None, as_of, 1, print_of(t, f), "", "", "", [])
        for i, (c, t, f, u) in enumerate(history)
    ]
    return spark.createDataFrame(data, TABLES["triggers"])


def check_triggers(spark, as_of, rows, history, **options):
    found = dedup_triggers(observations(spark, rows), trigger_frame(spark, history, as_of), len(history), **options)
    got = {row.ord // 3: (row.trigger_id, row.is_new) for row in found.collect()}
    assert [got[i] for i in range(len(rows))] == triggers_one_by_one(rows, history)


@pytest.mark.parametrize("width, hot_rows", [(200_000, 10**6), (2, 2), (1, 1)])
def test_dedup_equals_the_rule(spark, as_of, width, hot_rows):
    rng, rows, history = random.Random(width), [], []
    for company in range(120):
        titles = [f"t{i}" for i in range(rng.randint(1, 5))]
        urls = [f"https://u.example/{i}" for i in range(rng.randint(1, 5))]
        taken = set()
        for _ in range(rng.randint(0, 2)):
            kind, title, url = rng.choice("xy"), rng.choice(titles), rng.choice(urls)
            if not taken & {(kind, title), (kind, url)}:
                taken |= {(kind, title), (kind, url)}
                history.append((company, kind, title, url))
        rows += [(company, rng.choice("xy"), rng.choice(titles), rng.choice(urls)) for _ in range(rng.randint(1, 14))]
    rng.shuffle(rows)
    check_triggers(spark, as_of, rows, history, width=width, hot_rows=hot_rows)


def test_dropped_rows_do_not_extend_the_match(spark, as_of):
    u = "https://u.example/"
    check_triggers(spark, as_of, [(1, "x", "f1", u + "1"), (1, "x", "f2", u + "1"), (1, "x", "f2", u + "2")], [])
    check_triggers(spark, as_of, [(1, "x", "f1", u + "2"), (1, "x", "f1", u + "1")], [(1, "x", "f9", u + "1")])


def edge_frame(spark, edges):
    rows = [(1, "t", f, a, 7 * n) for n, (f, a) in enumerate(edges)]
    ddl = "company_id long, trigger_type string, fingerprint string, article string, ord long"
    return spark.createDataFrame(rows, ddl).repartition(3)


def kept_in_order(edges):
    prints, articles, kept = set(), set(), []
    for n, (f, a) in enumerate(edges):
        if f not in prints and a not in articles:
            kept.append(7 * n)
            prints.add(f)
            articles |= set() if a is None else {a}
    return kept


def test_blocks_of_a_company_give_the_same_matching(spark):
    rng = random.Random(11)
    mixed = [(f"f{rng.randrange(60)}", f"a{rng.randrange(60)}") for _ in range(500)]
    sparse = [(f"f{rng.randrange(700)}", rng.choice([None, f"a{rng.randrange(700)}"])) for _ in range(600)]
    hot = [("f", f"a{n}") if rng.random() < 0.5 else (f"f{rng.randrange(200)}", f"a{rng.randrange(n + 1)}") for n in range(400)]
    for edges in (mixed, sparse, hot):
        for width in (10**6, 64, 9):
            found = first_come_matching(edge_frame(spark, edges), width).select("ord").collect()
            assert sorted(row.ord for row in found) == kept_in_order(edges)


@pytest.mark.parametrize("rows, width, most", [(100_000, 1_000, 30), (100_000, 10_000, 24)])
def test_rounds_of_a_chain_grow_with_its_logarithm(spark, monkeypatch, rows, width, most):
    """Each observation shares a mark with the one before, over all blocks of the company."""
    written = []
    monkeypatch.setattr(matching, "cut_lineage", lambda df: written.append(1) or cut_lineage(df))
    chain = spark.range(rows).select(
        F.lit(1).cast("long").alias("company_id"),
        F.lit("t").alias("trigger_type"),
        F.concat(F.lit("f"), F.floor((F.col("id") + 1) / 2).cast("string")).alias("fingerprint"),
        F.concat(F.lit("a"), F.floor(F.col("id") / 2).cast("string")).alias("article"),
        (F.col("id") * 3).alias("ord"),
    )
    found = matching.first_come_matching(chain.repartition(5), width)
    assert found.where("ord % 6 = 0").count() == found.count() == rows // 2
    assert len(written) <= most


def test_ids_follow_arrival_order(spark):
    hashed = [(n * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63) for n in range(1, 3000)]
    for orders in ([5, 900, 7, 10**12, 31, 6], hashed, []):
        rows = spark.createDataFrame([(value,) for value in orders], "ord long").repartition(3)
        ids = {row.ord: row.id for row in assign_ids(rows, "ord", "id", 40).collect()}
        assert ids == {value: 41 + i for i, value in enumerate(sorted(orders))}


def test_ids_take_one_exchange_and_keep_the_columns(spark):
    rows = spark.range(50_000).selectExpr("id * 7 % 50000 AS ord", "id % 3 AS _part", "null AS empty").repartition(9)
    found = assign_ids(rows, "ord", "id")
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == ["ord", "_part", "empty", "id"]
    assert found.where("id <> ord + 1 or _part <> (ord * 7143 % 50000) % 3").count() == 0 and found.count() == 50_000


def test_ids_follow_several_columns(spark):
    rows = spark.createDataFrame([(2, "a"), (1, "b"), (1, "a")], "topic_no long, request_id string").repartition(2)
    found = assign_ids(rows, ["topic_no", "request_id"], "ord").orderBy("ord").collect()
    assert [(row.topic_no, row.request_id) for row in found] == [(1, "a"), (1, "b"), (2, "a")]


def test_a_digest_that_two_types_spell_is_one_trigger(spark, as_of):
    u = "https://u.example/"
    check_triggers(spark, as_of, [(1, "a|b", "c", u + "1"), (1, "a", "b|c", u + "2"), (1, "a", "d", u + "1")], [])


def test_last_payload_is_scored(spark):
    observed = spark.createDataFrame(
        [(1, 7, "first"), (2, 8, "scored"), (5, 7, "last")], "ord long, trigger_id long, payload string"
    )
    scores = spark.createDataFrame([(8,)], "trigger_id long")
    (row,) = eligible_triggers(observed, scores).collect()
    assert (row.trigger_id, row.payload, row.ord, row.first_ord) == (7, "last", 5, 1)
    assert {row.trigger_id for row in eligible_triggers(observed, scores, replay=True).collect()} == {7, 8}
    assert observed.where(F.col("ord") == 2).count() == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_stored_companies_that_may_be_met_are_shuffled(spark, as_of):
    companies = [{"id": n + 1, "name": f"n{n}", "domain": f"d{n}.example" if n % 3 else None} for n in range(5000)]
    stored = company_frame(spark, companies, as_of).repartition(4)
    keys = spark.createDataFrame([("d7.example", "n7"), (None, "n9"), ("new.example", "n12")], "domain string, name string")
    met = with_any_key(stored, keys, {"website_domain": "domain", "normalized_name": "name"})
    found = {row.id for row in met.collect()}
    assert {8, 10, 13} <= found and len(found) < 60
    assert "hashpartitioning" not in plan_of(met)
    assert met.columns == stored.columns and with_any_key(stored, keys.limit(0), {"normalized_name": "name"}).count() == 0
