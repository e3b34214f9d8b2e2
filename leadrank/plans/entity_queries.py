"""Queries over companies, triggers and eligibility."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadrank.functions.text import trigger_fingerprint
from leadrank.operators.ids import assign_ids, max_id
from leadrank.operators.matching import first_come_matching
from leadrank.operators.resolve import company_snapshot, first_per_domain, identify, resolve_companies
from leadrank.operators.triggers import dedup_triggers, eligible_triggers, latest_observation_per_trigger, unscored
from leadrank.plans.bindings import table
from leadrank.plans.registry import query

_AS_OF = datetime(2024, 7, 1, tzinfo=timezone.utc)


def _host():
    return F.regexp_extract("url", "^[^/]*//([^/]*)", 1)


def page_companies(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as sightings of companies: many hosts share a name, and secure pages without a fragment give no
    site."""
    bare = F.col("url").startswith("https") & ~F.col("url").contains("#") & ~F.col("url").contains("?")
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("ord"),
        F.concat(F.lit("Brand "), F.length(_host()).cast("string")).alias("company_name"),
        F.when(~bare, F.col("url")).alias("website"),
        F.lit("somewhere").alias("location"),
    )


def stored_companies(spark: SparkSession, folder: str) -> DataFrame:
    """Companies of earlier runs: hosts ending in .org, and one company without site per name of .net hosts."""
    pages = table(spark, folder, "pages").withColumn("host", _host())
    name = F.concat(F.lit("brand"), F.length("host").cast("string"))
    known = pages.where(F.col("host").endswith(".org") & F.col("host").startswith("blog.")).groupBy("host").agg(
        (F.min("page_id") * 2 + 1).alias("id")
    )
    bare = pages.where(F.col("host").endswith(".net") & F.col("host").startswith("m.")).groupBy(
        name.alias("normalized_name")
    ).agg((F.min("page_id") * 2 + 2).alias("id"))
    empty = F.lit(None).cast("string")
    return (
        known.select("id", name.alias("normalized_name"), F.col("host").alias("website_domain"))
        .unionByName(bare.select("id", "normalized_name", empty.alias("website_domain")))
        .select(
            "id",
            F.col("normalized_name").alias("name"),
            "normalized_name",
            F.lit(None).cast("string").alias("website"),
            "website_domain",
            F.lit("old").alias("location"),
            F.lit(_AS_OF).alias("first_seen_at"),
            F.lit(_AS_OF).alias("last_seen_at"),
        )
    )


# The oracle takes the candidates one by one, as the rule is written, and keeps the companies as a list.
_SQL_COMPANIES = r"""
sighting AS (
  SELECT row_number() OVER (ORDER BY page_id) AS i, page_id,
         'brand' || length(regexp_extract(url, '^[^/]*//([^/]*)', 1)) AS n,
         CASE WHEN NOT (starts_with(url, 'https') AND NOT contains(url, '#') AND NOT contains(url, '?'))
              THEN regexp_replace(regexp_extract(url, '^[^/]*//([^/]*)', 1), '^www\.', '') END AS d
  FROM pages),
hosts AS (SELECT page_id, regexp_extract(url, '^[^/]*//([^/]*)', 1) AS host FROM pages),
stored AS (
  SELECT min(page_id) * 2 + 1 AS id, 'brand' || length(host) AS n, host AS d FROM hosts
  WHERE host LIKE 'blog.%.org' GROUP BY host
  UNION ALL SELECT min(page_id) * 2 + 2, 'brand' || length(host), NULL FROM hosts
  WHERE host LIKE 'm.%.net' GROUP BY length(host)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, list({'id': id, 'n': n, 'd': d}) AS st, max(id) AS top, CAST(NULL AS BIGINT) AS hit,
         CAST(NULL AS BIGINT) AS page_id
  FROM stored
  UNION ALL
  SELECT i, CASE WHEN found IS NULL THEN list_append(st, {'id': top + 1, 'n': n, 'd': d})
                 ELSE list_transform(st, lambda x: CASE WHEN x.id = found AND x.d IS NULL
                                                        THEN {'id': x.id, 'n': x.n, 'd': d} ELSE x END) END,
         CASE WHEN found IS NULL THEN top + 1 ELSE top END, coalesce(found, top + 1), page_id
  FROM (
    SELECT s.i, w.st, w.top, s.n, s.d, s.page_id,
           coalesce(list_filter(w.st, lambda x: x.d = s.d)[1].id,
             CASE WHEN len(list_filter(w.st, lambda x: x.n = s.n AND (s.d IS NULL OR x.d IS NULL))) = 1
                  THEN list_filter(w.st, lambda x: x.n = s.n AND (s.d IS NULL OR x.d IS NULL))[1].id END) AS found
    FROM walk w JOIN sighting s ON s.i = w.i + 1))"""


def _resolved(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    companies = stored_companies(spark, folder)
    return companies, resolve_companies(page_companies(spark, folder), companies, max_id(companies))


@query(f"WITH RECURSIVE {_SQL_COMPANIES} SELECT page_id AS ord, hit AS company_id FROM walk WHERE i > 0")
def resolved_companies(spark: SparkSession, folder: str) -> DataFrame:
    """E1 + J1 + J2: the company of every sighting, in arrival order."""
    return _resolved(spark, folder)[1].select("ord", "company_id")


@query(
    f"""WITH RECURSIVE {_SQL_COMPANIES}
SELECT c.id, c.n AS normalized_name, c.d AS website_domain
FROM (SELECT unnest(st) AS c FROM walk WHERE i = (SELECT max(i) FROM walk))"""
)
def company_state(spark: SparkSession, folder: str) -> DataFrame:
    """S5 + E3: the companies after the run, with domains filled in."""
    companies, resolved = _resolved(spark, folder)
    return company_snapshot(companies, resolved, _AS_OF).select("id", "normalized_name", "website_domain")


@query(
    f"""WITH {_SQL_COMPANIES.split('hosts AS')[0].rstrip().rstrip(',')}
SELECT d AS domain, min(page_id) AS leader_ord, arg_min(n, page_id) AS normalized_name
FROM sighting WHERE d IS NOT NULL GROUP BY d"""
)
def domain_leaders(spark: SparkSession, folder: str) -> DataFrame:
    """The first sighting of each domain."""
    return first_per_domain(identify(page_companies(spark, folder))).drop("key_rows")


def _page_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as observations of triggers: few titles and few articles per company, so that they collide."""
    host = _host()
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("ord"),
        F.length(host).cast("long").alias("company_id"),
        F.regexp_extract("url", "^[^/]*//[^/]*/([a-z]+)/", 1).alias("trigger_type"),
        F.concat(F.lit("Story "), (F.length("html") % 5).cast("string")).alias("trigger_title"),
        F.lit(None).cast("date").alias("published_at"),
        F.concat(F.lit("https://news.example/"), (F.length("url") % 6).cast("string"), F.lit("#top")).alias(
            "source_url"
        ),
    )


def _stored_triggers(spark: SparkSession, folder: str) -> DataFrame:
    """One trigger of an earlier run per company and type, where the first page has a fragment."""
    pages = _page_observations(spark, folder)
    first = pages.groupBy("company_id", "trigger_type").agg(F.min("ord").alias("ord"))
    fragments = table(spark, folder, "pages").where(F.col("url").contains("#")).select(F.col("page_id").alias("ord"))
    rows = pages.join(first.select("ord"), "ord").join(fragments, "ord", "left_semi")
    return rows.select(
        (F.col("ord") + 1).alias("id"),
        "company_id",
        "trigger_type",
        trigger_fingerprint(F.col("trigger_type"), F.lit("Story 0"), F.col("published_at")).alias("fingerprint"),
        F.regexp_replace("source_url", "#.*$", "").alias("source_url"),
    )


_SQL_TRIGGERS = r"""
seen AS (
  SELECT row_number() OVER (ORDER BY page_id) AS i, page_id, url,
         length(regexp_extract(url, '^[^/]*//([^/]*)', 1)) AS c,
         regexp_extract(url, '^[^/]*//[^/]*/([a-z]+)/', 1) AS t,
         'story' || CAST(length(html) % 5 AS VARCHAR) AS f, 'https://news.example/' || CAST(length(url) % 6 AS VARCHAR) AS u
  FROM pages),
stored AS (
  SELECT page_id + 1 AS id, c, t, 'story0' AS f, u FROM seen WHERE contains(url, '#')),
firsts AS (SELECT c, t, min(page_id) AS page_id FROM seen GROUP BY c, t),
history AS (SELECT s.* FROM stored s JOIN firsts x ON x.page_id + 1 = s.id),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, list({'id': id, 'c': c, 't': t, 'f': f, 'u': u}) AS st, max(id) AS top,
         CAST(NULL AS BIGINT) AS hit, false AS is_new, CAST(NULL AS BIGINT) AS page_id
  FROM history
  UNION ALL
  SELECT i, CASE WHEN found IS NULL THEN list_append(st, {'id': top + 1, 'c': c, 't': t, 'f': f, 'u': u}) ELSE st END,
         CASE WHEN found IS NULL THEN top + 1 ELSE top END, coalesce(found, top + 1), found IS NULL, page_id
  FROM (
    SELECT s.i, s.page_id, s.c, s.t, s.f, s.u, w.st, w.top,
           coalesce(list_filter(w.st, lambda x: x.c = s.c AND x.t = s.t AND x.f = s.f)[1].id,
                    list_filter(w.st, lambda x: x.c = s.c AND x.t = s.t AND x.u = s.u)[1].id) AS found
    FROM walk w JOIN seen s ON s.i = w.i + 1))"""


@query(f"WITH RECURSIVE {_SQL_TRIGGERS} SELECT page_id AS ord, hit AS trigger_id, is_new FROM walk WHERE i > 0")
def deduped_triggers(spark: SparkSession, folder: str) -> DataFrame:
    """E2 + J3 + J4: the trigger of every observation, and whether it is new."""
    stored = _stored_triggers(spark, folder)
    found = dedup_triggers(_page_observations(spark, folder), stored, max_id(stored))
    return found.select("ord", "trigger_id", "is_new")


@query(
    """WITH placed AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part)
SELECT p_partkey AS ord FROM placed WHERE place % 2 = 0"""
)
def chained_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as one chain of observations of one company, each sharing a mark with the one before; blocks of a hundred."""
    placed = assign_ids(table(spark, folder, "part").select("p_partkey"), "p_partkey", "place", -1)
    mark = lambda name, half: F.concat(F.lit(name), F.floor(half / 2).cast("string"))
    edges = placed.select(
        F.lit(1).cast("long").alias("company_id"),
        F.lit("launch").alias("trigger_type"),
        mark("print ", F.col("place") + 1).alias("fingerprint"),
        mark("https://news.example/", F.col("place")).alias("article"),
        F.col("p_partkey").alias("ord"),
    )
    return first_come_matching(edges, 100).select("ord")


def _event_observations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events as observations of one trigger per user and type; users with a purchase were scored on it."""
    kinds = F.array(*[F.lit(kind) for kind in ("click", "error", "purchase", "signup", "view")])
    trigger = F.col("user_id") * 8 + F.array_position(kinds, F.col("event_type"))
    events = table(spark, folder, "events").select(
        F.col("event_id").alias("ord"),
        trigger.alias("trigger_id"),
        F.col("user_id").alias("company_id"),
        "event_type",
        "value",
    )
    scores = events.where(F.col("event_type").isin("purchase", "signup") & (F.col("value") > 30)).select("trigger_id")
    return events, scores


_SQL_ELIGIBLE = """
seen AS (
  SELECT event_id AS ord, user_id * 8 + list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)
           AS trigger_id, event_type, value FROM events),
scored AS (SELECT DISTINCT trigger_id FROM seen WHERE event_type IN ('purchase', 'signup') AND value > 30)"""


@query(
    f"""WITH {_SQL_ELIGIBLE}
SELECT trigger_id, max(ord) AS ord, min(ord) AS first_ord, arg_max(value, ord) AS value
FROM seen WHERE trigger_id NOT IN (SELECT trigger_id FROM scored) GROUP BY trigger_id"""
)
def triggers_to_score(spark: SparkSession, folder: str) -> DataFrame:
    """Each unscored trigger once, with its last payload."""
    events, scores = _event_observations(spark, folder)
    return eligible_triggers(events, scores).select("trigger_id", "ord", "first_ord", "value")


@query(f"WITH {_SQL_ELIGIBLE} SELECT ord, trigger_id FROM seen WHERE trigger_id NOT IN (SELECT trigger_id FROM scored)")
def unscored_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations of triggers without any earlier score."""
    events, scores = _event_observations(spark, folder)
    return unscored(events, scores).select("ord", "trigger_id")


@query(
    f"""WITH {_SQL_ELIGIBLE}
SELECT trigger_id, max(ord) AS ord, min(ord) AS first_ord, arg_max(value, ord) AS value FROM seen GROUP BY trigger_id"""
)
def latest_observations(spark: SparkSession, folder: str) -> DataFrame:
    """The last observation of each trigger, as a replay scores it."""
    events, _ = _event_observations(spark, folder)
    return latest_observation_per_trigger(events).select("trigger_id", "ord", "first_ord", "value")
