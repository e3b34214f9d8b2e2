"""Not-modified revisit records of web archives, resolved by an as-of join.

A revisit record of the profile server-not-modified has headers but no body. Its body is that of the latest earlier full
response for the same canonical URL, if the validators agree. The headers of the stored response are updated by those
that a 304 response may change.

The as-of join works on points, the distinct times of a URL, so that a URL with a third of all records counts once per
time. Points are cut into days: each point looks back within its day, and a second, much smaller pass over the last
response of every day looks further back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadrank.session import cut_lineage

DAY = 86_400
# Header fields that a 304 response must not change in the stored response, and fields of one connection.
KEPT_FIELDS = (
    "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag", "transfer-encoding",
    "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-connection", "te", "trailer", "upgrade",
)
# Query parameters that name a visit, not a page.
VISIT_PARAMETERS = r"^(?:utm_[a-z]+|ref|fbclid|gclid|sid|sessionid|jsessionid|phpsessid)(?:=|$)"
HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """One spelling for the addresses of a page: scheme, `www.`, default port, fragment, index file, closing slash and
    parameters that name a visit are gone, the host is in lower case, parameters are sorted. Null stays null."""
    bare = F.regexp_replace(F.trim(url), r"(?i)^https?://", "")
    bare = F.substring_index(bare, "#", 1)
    address, has_query = F.substring_index(bare, "?", 1), F.contains(bare, F.lit("?"))
    host = F.lower(F.substring_index(address, "/", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^www\.", "")
    path = F.substr(address, F.length(F.substring_index(address, "/", 1)) + 1, F.length(address) + 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", "/"), r"/+$", "")
    query = F.when(has_query, F.substr(bare, F.length(address) + 2, F.length(bare) + 1)).otherwise("")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(VISIT_PARAMETERS))
    sorted_query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(sorted_query != "", F.concat(F.lit("?"), sorted_query)).otherwise(""))


def field(headers: Column, name: str) -> Column:
    """First value of a header field, null if there is none."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def validators(stored: Column, new: Column) -> Column:
    """True if the strongest validator that both have agrees, false if not, null if they share none."""
    tag = lambda headers: F.regexp_replace(F.trim(field(headers, "etag")), "^W/", "")
    changed = lambda headers: F.trim(field(headers, "last-modified"))
    return F.coalesce(tag(stored) == tag(new), changed(stored) == changed(new))


def merged(stored: Column, new: Column) -> Column:
    """Stored fields, with those that the 304 may change replaced by its own. Repeated fields are kept or replaced together."""
    may = F.filter(new, lambda h: ~F.lower(h["name"]).isin(*KEPT_FIELDS))
    rest = F.filter(stored, lambda h: ~F.exists(may, lambda m: F.lower(m["name"]) == F.lower(h["name"])))
    return F.concat(rest, may)


def as_of(points: DataFrame) -> DataFrame:
    """`url_key`, `at`, `response` (null where only a revisit is) in; out with `earlier`, the last response before `at`."""
    dated = points.withColumn("day", F.floor(F.col("at") / DAY))
    days = dated.where(F.col("response").isNotNull()).groupBy("url_key", "day").agg(F.max_by("response", "at").alias("response"))
    every = dated.select("url_key", "day").distinct().join(days, ["url_key", "day"], "left")
    by_day = Window.partitionBy("url_key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("url_key", "day", F.last("response", ignorenulls=True).over(by_day).alias("carried"))
    in_day = Window.partitionBy("url_key", "day").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    near = dated.withColumn("near", F.last("response", ignorenulls=True).over(in_day))
    return near.join(carried, ["url_key", "day"]).select("url_key", "at", F.coalesce("near", "carried").alias("earlier"))


def resolved(records: DataFrame) -> DataFrame:
    """One row per revisit record of `records`, whose columns are `record_id` (unique), `type` ('response' or 'revisit'),
    `url`, `at` (seconds), `status`, `headers` (name and value pairs) and `payload`.

    Out: `record_id`, `url`, `at`, `url_key`, `response_id`, `outcome`, `headers`, `payload`.

    * A full response has status 200 and a payload, which may be empty. Of several at one time the largest id counts. A
      response at the time of the revisit is not earlier.
    * `outcome`: 'resolved' if a validator agrees, 'unverified' if there is none to compare (both get merged headers
      and the payload), 'mismatch' if it differs, 'missing' without an earlier response (both keep their own headers and
      get no payload; a mismatch names the response).
    * A null or empty URL, or a null time, matches nothing; null headers count as none. Repeated revisit rows each give a row. An
      empty table gives an empty one. Other columns of `records` are left out.
    """
    rows = records.select(
        "record_id",
        "type",
        "url",
        "at",
        "status",
        "payload",
        F.coalesce(F.col("headers"), F.array().cast(HEADERS)).cast(HEADERS).alias("headers"),
        F.nullif(canonical_url(F.col("url")), F.lit("")).alias("url_key"),
    )
    known = F.col("url_key").isNotNull() & F.col("at").isNotNull()
    full = rows.where((F.col("type") == "response") & (F.col("status") == 200) & F.col("payload").isNotNull() & known)
    asked = rows.where("type = 'revisit'")
    points = (
        full.select("url_key", "at", F.col("record_id").alias("response"))
        .union(asked.where(known).select("url_key", "at", F.lit(None).cast(records.schema["record_id"].dataType)))
        .groupBy("url_key", "at")
        .agg(F.max("response").alias("response"))
    )
    found = cut_lineage(as_of(cut_lineage(points)).where(F.col("earlier").isNotNull()))
    stored = full.select(F.col("record_id").alias("earlier"), F.col("headers").alias("stored"), F.col("payload").alias("body"))
    stored = stored.dropDuplicates(["earlier"])
    joined = asked.drop("payload", "status", "type").join(found, ["url_key", "at"], "left").join(stored, "earlier", "left")
    agrees = validators(F.col("stored"), F.col("headers"))
    outcome = (
        F.when(F.col("earlier").isNull(), "missing")
        .when(agrees.isNull(), "unverified")
        .when(agrees, "resolved")
        .otherwise("mismatch")
    )
    taken = F.col("outcome").isin("resolved", "unverified")
    return joined.withColumn("outcome", outcome).select(
        "record_id",
        "url",
        "at",
        "url_key",
        F.col("earlier").alias("response_id"),
        "outcome",
        F.when(taken, merged(F.col("stored"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(taken, F.col("body")).alias("payload"),
    )
