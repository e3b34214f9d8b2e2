"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from leadrank.llm import bpe_counts, language, line_blocks, line_dedup, minhash, mixing, periodic_runs
from leadrank.llm import phrases, revisits, simhash, surrogates, tiling, toxicity
from leadrank.llm.common import table
from leadrank.session import cut_lineage

# Stands for the secret that a user keeps; with another key all surrogates differ.
SURROGATE_KEY = "synthetic tables"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name; `sql` gives the same rows on the same tables."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


MIX_SQL = r"""
WITH units AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM {documents}),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM units GROUP BY source),
weighed AS (
  SELECT *, list_extract([3, 1, 2], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS source_no, 2 * source_size AS cap FROM sizes),
running AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget,
         sum(cap) OVER ratio - cap AS caps_before, sum(weight) OVER () - sum(weight) OVER ratio + weight AS weights_on
  FROM weighed
  WINDOW ratio AS (ORDER BY CAST(cap AS DOUBLE) / weight, source_no ROWS UNBOUNDED PRECEDING)),
marked AS (
  SELECT *, CAST(cap AS DOUBLE) <= weight * ((budget - CAST(caps_before AS DOUBLE)) / CAST(weights_on AS DOUBLE)) AS capped FROM running),
goals AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
           weight * ((budget - CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS DOUBLE))
                     / CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS DOUBLE)) END AS target
  FROM marked),
epochs AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(floor(target / source_size) AS BIGINT), 2) END AS rounds FROM goals),
ranked AS (
  SELECT u.doc_id, u.size, e.source_size, e.target, e.rounds, e.target - e.rounds * e.source_size AS rest,
         sum(u.size) OVER (PARTITION BY u.source ORDER BY u.h RANGE UNBOUNDED PRECEDING) AS upto_words,
         sum(u.size) OVER (PARTITION BY u.source, u.h) AS own_words
  FROM units u JOIN epochs e ON u.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (rounds + CASE
         WHEN rest <= 0 THEN 0
         WHEN upto_words < rest THEN 1
         WHEN upto_words - own_words < rest AND upto_words - rest <= rest - (upto_words - own_words) THEN 1
         ELSE 0 END) AS BIGINT) AS taken
FROM ranked"""


@query(MIX_SQL.replace("{documents}", "documents"))
def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the words that a mix of the sources takes of each."""
    units = cut_lineage(mixing.measured(table(spark, folder, "documents")).select("doc_id", "source", "size", "mix_hash"))
    return mixing.apply_thresholds(units, mixing.thresholds(units)).drop("source")


@query()
def op3_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with SimHash fingerprint and component."""
    return simhash.simhash_components(table(spark, folder, "documents"))


@query()
def op7_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and how much of it the tiles cover."""
    return tiling.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op5_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.pseudonymized(docs, SURROGATE_KEY)


@query()
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the score of a classifier that learns from labelled rows outside the held-out quarter."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query()
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the language that output codes give them."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = language.identified(docs.drop("lang"), language.fit(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query()
def op6_bpe_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their size in bytes and tokens."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe_counts.counted(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


@query()
def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their fingerprints and those of their edited texts."""
    return minhash.fingerprinted(table(spark, folder, "documents"))


@query()
def op10_line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """All pages with their main text."""
    return line_blocks.extracted(table(spark, folder, "pages"))


def archive_records(pages: DataFrame) -> DataFrame:
    """The pages as records of a web archive: each one is fetched once, and revisited twice within hours under another
    spelling of its address. Some first fetches fail, some revisits bring another validator or none."""
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 8), F.lit('"'))
    at = F.lit(1_700_000_000).cast("long") + F.col("page_id") * 61
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    first = F.array(
        header("Content-Type", F.lit("text/html")),
        header("Content-Length", F.octet_length("html")),
        header("ETag", tag),
        header("Date", at),
        header("Cache-Control", F.lit("max-age=60")),
    )
    fetched = pages.select(
        (F.col("page_id") * 4).alias("record_id"),
        F.lit("response").alias("type"),
        "url",
        at.alias("at"),
        F.when(F.col("page_id") % 7 == 3, 404).otherwise(200).alias("status"),
        first.alias("headers"),
        F.col("html").alias("payload"),
    )
    turn = F.col("turn").cast("long")
    later = at + turn * 3600 * (1 + F.col("page_id") % 29)
    sent = F.when(F.col("page_id") % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    always = [
        header("Date", later),
        header("CACHE-CONTROL", F.lit("max-age=120")),
        header("Content-Length", F.lit("0")),
        header("Connection", F.lit("close")),
    ]
    again = F.when(F.col("page_id") % 11 == 0, F.array(*always)).otherwise(F.array(header("etag", sent), *always))
    spelled = F.when(turn == 1, F.concat("url", F.lit("#again"))).otherwise(F.regexp_replace("url", "^https://", "HTTP://WWW."))
    revisited = pages.withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.col("page_id") * 4 + turn,
        F.lit("revisit"),
        spelled,
        later,
        F.lit(304),
        again,
        F.lit(None).cast("string"),
    )
    return fetched.union(revisited)


REVISIT_SQL = r"""
WITH pairs AS (
  SELECT *, 1700000000 + page_id * 61 AS fetched, '"' || substr(md5(coalesce(html, '')), 1, 8) || '"' AS tag FROM pages),
records AS (
  SELECT page_id, 0 AS turn, page_id * 4 AS record_id, url, fetched AS seen, tag, html FROM pairs
  UNION ALL
  SELECT page_id, turn, page_id * 4 + turn,
         CASE turn WHEN 1 THEN url || '#again' ELSE regexp_replace(url, '^https://', 'HTTP://WWW.') END,
         fetched + turn * 3600 * (1 + page_id % 29), tag, NULL
  FROM pairs, (VALUES (1), (2)) turns(turn)),
cut AS (
  SELECT *, split_part(regexp_replace(trim(url), '^https?://', '', 'i'), '#', 1) AS bare FROM records),
parts AS (
  SELECT *, split_part(split_part(bare, '?', 1), '/', 1) AS host,
         substr(split_part(bare, '?', 1), length(split_part(split_part(bare, '?', 1), '/', 1)) + 1) AS path,
         CASE WHEN contains(bare, '?') THEN substr(bare, length(split_part(bare, '?', 1)) + 2) ELSE '' END AS query
  FROM cut),
keyed AS (
  SELECT *, nullif(regexp_replace(regexp_replace(lower(host), ':(80|443)$', ''), '^www\.', '')
         || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '')
         || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT
              regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sid|sessionid|jsessionid|phpsessid)(=|$)'))), '&'), ''), ''), '') AS url_key
  FROM parts),
stored AS (SELECT * FROM keyed WHERE turn = 0 AND page_id % 7 <> 3 AND html IS NOT NULL),
found AS (
  SELECT k.record_id, max_by(s.record_id, {'seen': s.seen, 'id': s.record_id}) AS response_id
  FROM keyed k JOIN stored s ON k.url_key = s.url_key AND s.seen < k.seen WHERE k.turn > 0 GROUP BY k.record_id),
judged AS (
  SELECT k.*, f.response_id, s.html AS body, s.tag AS stored_tag, s.seen AS stored_at,
         CASE WHEN f.response_id IS NULL THEN 'missing' WHEN k.page_id % 11 = 0 THEN 'unverified'
              WHEN (CASE WHEN k.page_id % 5 = 0 THEN '"other"' ELSE k.tag END) = s.tag THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM keyed k LEFT JOIN found f USING (record_id) LEFT JOIN stored s ON s.record_id = f.response_id WHERE k.turn > 0)
SELECT record_id, url_key, response_id, outcome,
       CASE WHEN outcome IN ('resolved', 'unverified') THEN
         'content-type: text/html; content-length: ' || CAST(strlen(body) AS VARCHAR) || '; etag: ' || stored_tag
           || '; date: ' || CAST(seen AS VARCHAR) || '; cache-control: max-age=120'
       ELSE CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 5 = 0 THEN 'etag: "other"; ' ELSE 'etag: W/' || tag || '; ' END
           || 'date: ' || CAST(seen AS VARCHAR) || '; cache-control: max-age=120; content-length: 0; connection: close' END AS headers,
       CASE WHEN outcome IN ('resolved', 'unverified') THEN sha256(body) END AS payload_sha256
FROM judged"""


@query(REVISIT_SQL)
def op4_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """All revisit records of an archive of the pages, with the response that each one stands for."""
    found = revisits.resolved(archive_records(table(spark, folder, "pages")))
    lines = F.transform("headers", lambda h: F.concat(F.lower(h["name"]), F.lit(": "), h["value"]))
    return found.select(
        "record_id",
        "url_key",
        "response_id",
        "outcome",
        F.array_join(lines, "; ").alias("headers"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("payload_sha256"),
    )


LINES_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
spread AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS name FROM spread),
held AS (
  SELECT name, max(doc_id) AS keeper FROM keyed WHERE length(name) >= 40 GROUP BY name HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.*, coalesce(h.keeper <> k.doc_id, false) AS goes FROM keyed k LEFT JOIN held h USING (name))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


@query(LINES_SQL)
def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the lines that many of them share."""
    found = line_dedup.deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


PHRASES_SQL = r"""
WITH folded AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM folded),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM listed),
sized AS (SELECT *, unnest([1, 2, 3, 4]) AS size FROM starts),
counts AS (
  SELECT lang, size, array_to_string(words[pos : pos + size - 1], ' ') AS phrase, count(*) AS a
  FROM sized WHERE pos + size - 1 <= len(words) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS words FROM counts WHERE size > 1 AND a >= 30),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, f.a AS l, g.a AS r, CAST((2000000::HUGEINT * c.a) // (f.a + g.a) AS BIGINT) AS score
  FROM cuts c
  JOIN counts f ON f.lang = c.lang AND f.phrase = array_to_string(words[1 : k], ' ')
  JOIN counts g ON g.lang = c.lang AND g.phrase = array_to_string(words[k + 1 : c.size], ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
inner_parts AS (
  SELECT lang, a, words, size, unnest(range(2, size)) AS part FROM candidates),
inside AS (
  SELECT lang, array_to_string(words[pos : pos + part - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, size - part + 2)) AS pos FROM inner_parts) GROUP BY ALL),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank
  FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE s.place = 1 AND NOT coalesce(100 * i.most >= 80 * s.a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


@query(PHRASES_SQL)
def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 collocations of each language in all documents."""
    return phrases.collocations(table(spark, folder, "documents"))


def repeated_tail(doc_id: int | None, text: str | None) -> str:
    """The words of a text, joined by blanks; every tenth document, by a hash of its id, repeats a stretch to its end."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(int(doc_id)).encode())
    if n and h % 10 == 0:
        start = h // 10 % n
        period = 1 + (n - start) // (3 + h // 10 % 8)
        part = words[start : start + period]
        words[start:] = (part * ((n - start) // period + 1))[: n - start]
    return b" ".join(words).decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def _repeated_tails(doc_ids: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([repeated_tail(*row) for row in zip(doc_ids.astype(object).where(doc_ids.notna(), None), texts)], dtype=object)


@query()
def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the runs of repeated words in their texts, some of which are made to repeat."""
    docs = table(spark, folder, "documents").select("doc_id", _repeated_tails("doc_id", "text").alias("text"))
    found = periodic_runs.with_runs(docs)
    place = lambda run: F.struct((-run["length"]).alias("less"), run["start"].alias("start"), run["period"].alias("period"))
    line = lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.withColumn("best", F.array_min(F.transform("runs", place))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
        digest(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
