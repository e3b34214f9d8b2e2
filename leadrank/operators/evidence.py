"""Search evidence: which URLs a response really visited or cited, and the gates built on them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from leadrank.functions.records import RESPONSE_DDL
from leadrank.functions.text import canonical_url, drop_default_port


def parse_response(raw: Column) -> Column:
    """Declared parts of a raw JSON response as a struct."""
    return F.from_json(raw, RESPONSE_DDL)


def response_text(response: Column) -> Column:
    """Generated text: given as a whole, or as the text parts of the messages."""
    parts = F.flatten(
        F.transform(
            F.filter(response["output"], lambda item: item["type"] == "message"),
            lambda item: F.transform(
                F.filter(item["content"], lambda part: part["type"] == "output_text"),
                lambda part: part["text"],
            ),
        )
    )
    return F.coalesce(response["output_text"], F.array_join(parts, ""))


def response_completed(response: Column) -> Column:
    return F.coalesce(response["status"] == "completed", F.lit(False))


def evidence_array(response: Column) -> Column:
    """URLs from tool metadata only, never from generated text: search sources, opened pages, citations.

    One response holds a bounded number of them, so this stays a row-local array without a shuffle.
    """
    none = F.array().cast("array<string>")

    def urls_of(item: Column) -> Column:
        action = item["action"]
        sources = F.coalesce(F.transform(action["sources"], lambda source: source["url"]), none)
        opened = F.when(action["type"] == "open_page", F.array(action["url"])).otherwise(none)
        cited = F.coalesce(
            F.flatten(
                F.transform(
                    item["content"],
                    lambda part: F.transform(
                        F.filter(
                            F.coalesce(part["annotations"], _no_annotations()),
                            lambda note: note["type"] == "url_citation",
                        ),
                        lambda note: note["url"],
                    ),
                )
            ),
            none,
        )
        searched = (item["type"] == "web_search_call") & (item["status"] == "completed")
        return (
            F.when(searched, F.concat(sources, opened))
            .when(item["type"] == "message", cited)
            .otherwise(none)
        )

    urls = F.flatten(F.transform(F.coalesce(response["output"], _no_output()), urls_of))
    return F.array_distinct(F.filter(urls, lambda url: F.coalesce(url != "", F.lit(False))))


def _no_annotations() -> Column:
    return F.array().cast("array<struct<type:string,url:string>>")


def _no_output() -> Column:
    output_ddl = RESPONSE_DDL[RESPONSE_DDL.index("output:") + len("output:") : -1]
    return F.array().cast(output_ddl)


def extract_evidence(responses: DataFrame, raw: str = "response") -> DataFrame:
    """Long table of evidence: every column of `responses` but the raw text, and `url`."""
    keys = [name for name in responses.columns if name != raw]
    urls = evidence_array(parse_response(F.col(raw)))
    return responses.select(*keys, F.explode(urls).alias("url"))


def collect_evidence(responses: DataFrame, raw: str = "response") -> DataFrame:
    """Distinct URLs per request over all its attempts, invalid ones included."""
    return extract_evidence(responses, raw).select("request_id", "url").distinct()


def canonical_evidence(evidence: DataFrame) -> DataFrame:
    return evidence.select("request_id", canonical_url(F.col("url")).alias("url")).distinct()


def candidate_url(url: Column) -> Column:
    """Comparable form of a URL that a candidate claims."""
    return canonical_url(drop_default_port(url))


def explode_facts(candidates: DataFrame) -> DataFrame:
    """One row per research fact, with its position; candidates without facts keep one empty row."""
    return candidates.select(
        "ord", "request_id", F.posexplode_outer("research_facts").alias("fact_no", "fact")
    ).select("ord", "request_id", "fact_no", "fact.*")


def gate_source(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidates whose source is in the evidence of the same request. `evidence` is canonical.

    The join keys include the URL, so one large request spreads over many tasks.
    """
    return (
        candidates.withColumn("url", candidate_url(F.col("source_url")))
        .join(evidence, ["request_id", "url"], "left_semi")
        .drop("url")
    )


def unsourced_facts(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """`ord` of candidates with a research fact outside the evidence of their request."""
    return (
        explode_facts(candidates)
        .where(F.col("source_url").isNotNull())
        .select("ord", "request_id", candidate_url(F.col("source_url")).alias("url"))
        .join(evidence, ["request_id", "url"], "left_anti")
        .select("ord")
        .distinct()
    )


def gate_research(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidates all of whose research facts are in the evidence of the same request."""
    return candidates.join(unsourced_facts(candidates, evidence), "ord", "left_anti")


def not_in_future(published: Column, today: date | Column) -> Column:
    return F.coalesce(published <= F.lit(today), F.lit(True))


def gate_future(candidates: DataFrame, today: date | Column) -> DataFrame:
    """Candidates not published after today; a missing date passes."""
    return candidates.where(not_in_future(F.col("published_at"), today))


def gate_reason(candidate: Column, evidence: Column, today: date | Column) -> Column:
    """First gate a candidate struct fails, null if it passes all. `evidence` is a canonical array.

    The array form needs no shuffle: a response and its evidence lie in the same row.
    """
    known = lambda url: F.array_contains(evidence, candidate_url(url))
    facts_known = F.forall(candidate["research_facts"], lambda fact: known(fact["source_url"]))
    return (
        F.when(~F.coalesce(known(candidate["source_url"]), F.lit(False)), "unverified_source")
        .when(~F.coalesce(facts_known, F.lit(True)), "unverified_research")
        .when(~not_in_future(candidate["published_at"], today), "future_date")
    )
