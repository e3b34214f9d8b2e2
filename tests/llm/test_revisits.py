import random

from pyspark.sql import functions as F

from leadrank.llm import revisits

DDL = "record_id long, type string, url string, at long, status int, headers array<struct<name:string,value:string>>, payload string"


def response(number, url, at, tag=None, status=200, payload="body", **more):
    headers = [("ETag", tag)] * (tag is not None) + [("Content-Length", "4"), ("Date", "old")]
    return (number, "response", url, at, status, headers, payload and f"{payload}{number}")


def revisit(number, url, at, *headers):
    return (number, "revisit", url, at, 304, list(headers), None)


def solve(spark, rows):
    return {r.record_id: r for r in revisits.resolved(spark.createDataFrame(rows, DDL).repartition(3)).collect()}


def test_spellings_of_an_address(spark):
    spellings = ["http://www.A.com/x/?b=2&a=1#top", "https://a.com:443/x?a=1&utm_source=q&b=2", " HTTPS://A.COM/x/?a=1&b=2&ref=z", "a.com/x?a=1&b=2"]
    frame = spark.createDataFrame([(s,) for s in [*spellings, "http://a.com/X?a=1&b=2", "", None]], "url string")
    keys = [r[0] for r in frame.select(revisits.canonical_url(F.col("url"))).collect()]
    assert set(keys[:4]) == {"a.com/x?a=1&b=2"} and keys[4] == "a.com/X?a=1&b=2" and keys[5:] == ["", None]


def test_validators_and_headers(spark):
    rows = [
        response(1, "http://a/", 10, '"x"'),
        response(2, "http://a", 20, '"y"'),
        response(3, "http://a", 25, '"z"', status=404),
        revisit(11, "https://a#f", 30, ("etag", 'W/"y"'), ("DATE", "new"), ("content-length", "0"), ("X", "1"), ("X", "2")),
        revisit(12, "https://a", 31, ("etag", '"x"')),
        revisit(13, "https://a", 20, ("etag", '"x"')),
        revisit(14, "https://a", 10),
        revisit(15, "https://a", 99),
        revisit(16, None, 99),
        revisit(17, "https://a", None),
        revisit(18, "https://b", 5),
    ]
    found = solve(spark, rows)
    assert {n: (r.outcome, r.response_id, r.payload) for n, r in found.items()} == {
        11: ("resolved", 2, "body2"),
        12: ("mismatch", 2, None),
        13: ("resolved", 1, "body1"),
        14: ("missing", None, None),
        15: ("unverified", 2, "body2"),
        16: ("missing", None, None),
        17: ("missing", None, None),
        18: ("missing", None, None),
    }
    assert [tuple(h) for h in found[11].headers] == [("ETag", '"y"'), ("Content-Length", "4"), ("DATE", "new"), ("X", "1"), ("X", "2")]
    assert [tuple(h) for h in found[12].headers] == [("etag", '"x"')]


def test_the_join_equals_a_plain_search(spark):
    rng, rows = random.Random(6), []
    for number in range(1500):
        url = "http://hot" if rng.random() < 0.4 else f"http://h{rng.randrange(40)}"
        at = rng.randrange(12) * 40_000 + rng.randrange(3)
        rows.append(response(number, url, at) if rng.random() < 0.3 else revisit(number, url, at))
    found = solve(spark, rows)
    for number, kind, url, at, *_ in rows:
        if kind == "revisit":
            earlier = [(r[3], r[0]) for r in rows if r[1] == "response" and r[2] == url and r[3] < at]
            assert found[number].response_id == (max(earlier)[1] if earlier else None)


def test_repeated_rows_and_empty_tables(spark):
    rows = [response(1, "http://a", 1), response(1, "http://a", 1), revisit(2, "http://a", 3), revisit(2, "http://a", 3), (3, "revisit", "http://a", 4, 304, None, None)]
    frame = spark.createDataFrame(rows, DDL).selectExpr("*", "1 as earlier", "'x' as url_key", "2 as outcome")
    found = revisits.resolved(frame).collect()
    assert sorted((r.record_id, r.response_id) for r in found) == [(2, 1), (2, 1), (3, 1)]
    assert revisits.resolved(frame.limit(0)).count() == 0
