"""Company resolution: which company each candidate belongs to, in arrival order.

The rule, candidate by candidate: a known domain decides. Otherwise the companies of the same normalized
name count, unless both domains are known and differ; exactly one such company takes the candidate and, if
it has no domain yet, receives the candidate's domain. Zero or several make a new company.

Why no sequential pass is needed. After the first candidate of a new domain (its leader) some company holds
that domain, so later ones follow it. Only leaders and candidates without domain ("bare" ones) change
anything, and only within one normalized name. In one name, in arrival order:

* While the name has at most one company, every candidate up to a certain leader falls to that company. The
  certain leader is the second one, or the first one if the only company is stored and has a domain already.
  It makes the second company. Call its arrival number `split`.
* After `split` a bare candidate always makes a company. A leader joins the company of the candidate just
  before it if that one is bare, unless two bare candidates have come in a row since `split` (`flood`): from
  then on several companies lack a domain and everything makes a new company.

So each outcome depends on the neighbour in arrival order and on two numbers per name. Both come from a
two-level pass: names are cut into blocks of the rank in arrival order, each with a bounded number of rows, and
the blocks of a name are combined from one summary row each. Ranks are dense, whatever the arrival numbers are. One name holding a third of all rows is thus spread
over many tasks.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadrank.functions.text import normalize_name, website_domain
from leadrank.operators.ids import BLOCK_WIDTH, arrival_block, assign_ids, rank_places
from leadrank.operators.key_filter import with_any_key
from leadrank.operators.skew import HOT_ROWS, salted_lookup
from leadrank.session import cut_lineage

_START = -(1 << 62)


def identify(candidates: DataFrame) -> DataFrame:
    """Adds `domain` and `normalized_name`."""
    return candidates.withColumn("domain", website_domain(F.col("website"))).withColumn(
        "normalized_name", normalize_name(F.col("company_name"))
    )


def first_per_domain(identified: DataFrame) -> DataFrame:
    """Leader of each domain: arrival number and name of its first candidate; and the number of candidates."""
    return (
        identified.where(F.col("domain").isNotNull())
        .groupBy("domain")
        .agg(
            F.min("ord").alias("leader_ord"),
            F.min_by("normalized_name", "ord").alias("normalized_name"),
            F.count(F.lit(1)).alias("key_rows"),
        )
    )


def known_domains(companies: DataFrame) -> DataFrame:
    return companies.where(F.col("website_domain").isNotNull()).select(
        F.col("website_domain").alias("domain"), F.col("id").alias("known_id")
    )


def _name_state(companies: DataFrame) -> DataFrame:
    """Per stored name: number of companies, number without domain, and the lowest id of each kind."""
    bare = F.col("website_domain").isNull()
    return companies.groupBy("normalized_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(bare).alias("bare"),
        F.min("id").alias("only_id"),
        F.min(F.when(bare, F.col("id"))).alias("bare_id"),
    )


def _place_movers(movers: DataFrame, companies: DataFrame, width: int) -> DataFrame:
    """Outcome of leaders and bare candidates: existing_id or creator_ord, and whether a domain is filled in."""
    block = ["normalized_name", "block"]
    in_block = Window.partitionBy(*block).orderBy("ord")
    placed = (
        movers.withColumn("block", arrival_block("place", width))
        .withColumn("before_leads", F.lag("leads").over(in_block))
        .withColumn("before_ord", F.lag("ord").over(in_block))
        .withColumn("leads_so_far", F.sum(F.col("leads").cast("int")).over(in_block))
    )

    # One summary row per block. `flood_n`: first bare candidate right after a bare one, counted from the
    # n-th leader of the block on.
    doubled = ~F.col("leads") & ~F.coalesce(F.col("before_leads"), F.lit(True))
    flood = lambda n: F.min(F.when(doubled & (F.col("leads_so_far") >= n), F.col("ord")))
    blocks = placed.groupBy(*block).agg(
        F.min("ord").alias("first_ord"),
        F.max("ord").alias("last_ord"),
        F.min_by("leads", "ord").alias("first_leads"),
        F.max_by("leads", "ord").alias("last_leads"),
        F.min(F.when(F.col("leads"), F.col("ord"))).alias("lead_1"),
        F.min(F.when(F.col("leads") & (F.col("leads_so_far") == 2), F.col("ord"))).alias("lead_2"),
        flood(0).alias("flood_0"),
        flood(1).alias("flood_1"),
        flood(2).alias("flood_2"),
    )

    by_block = Window.partitionBy("normalized_name").orderBy("block")
    name = Window.partitionBy("normalized_name")
    several = F.col("total") >= 2
    summary = (
        blocks.join(_name_state(companies), "normalized_name", "left")
        .fillna(0, ["total", "bare"])
        .withColumn("prior_leads", F.lag("last_leads").over(by_block))
        .withColumn("prior_ord", F.lag("last_ord").over(by_block))
        .withColumn("name_first", F.min("first_ord").over(name))
        .withColumn("name_lead_1", F.min("lead_1").over(name))
        .withColumn(
            "name_lead_2",
            F.min(
                F.when(F.col("lead_1") == F.col("name_lead_1"), F.col("lead_2")).otherwise(F.col("lead_1"))
            ).over(name),
        )
        .withColumn(
            "split",
            F.when(several, F.lit(_START))
            .when((F.col("total") == 1) & (F.col("bare") == 0), F.col("name_lead_1"))
            .otherwise(F.col("name_lead_2")),
        )
        # A stored company without domain in an ambiguous name acts like a bare candidate just before.
        .withColumn(
            "prior_bare",
            F.when(F.col("prior_ord").isNull(), several & (F.col("bare") == 1)).otherwise(
                ~F.col("prior_leads")
            ),
        )
        .withColumn(
            "flood_here",
            F.least(
                F.when(
                    (F.col("first_ord") > F.col("split")) & ~F.col("first_leads") & F.col("prior_bare"),
                    F.col("first_ord"),
                ),
                F.when(F.col("split") < F.col("first_ord"), F.col("flood_0"))
                .when(F.col("split") == F.col("lead_1"), F.col("flood_1"))
                .when(F.col("split") == F.col("lead_2"), F.col("flood_2")),
            ),
        )
        .withColumn(
            "flood",
            F.when(several & (F.col("bare") >= 2), F.lit(_START)).otherwise(F.min("flood_here").over(name)),
        )
        .select(
            *block, "first_ord", "prior_bare", "prior_ord", "name_first", "name_lead_1", "split", "flood",
            "total", "bare", "only_id", "bare_id",
        )
    )

    rows = placed.join(summary, block)
    opens_block = F.col("ord") == F.col("first_ord")
    after_bare = F.when(opens_block, F.col("prior_bare")).otherwise(~F.col("before_leads"))
    before_ord = F.when(opens_block, F.col("prior_ord")).otherwise(F.col("before_ord"))
    single = F.col("split").isNull() | (F.col("ord") < F.col("split"))
    joins = (
        ~single
        & F.col("leads")
        & (F.col("ord") > F.col("split"))
        & (F.col("flood").isNull() | (F.col("ord") < F.col("flood")))
        & after_bare
    )
    fills_single = (
        single
        & (F.col("ord") == F.col("name_lead_1"))
        & F.when(F.col("total") == 0, F.col("name_lead_1") > F.col("name_first")).otherwise(F.col("bare") == 1)
    )
    return rows.select(
        "ord",
        "place",
        "domain",
        F.when(single & (F.col("total") == 1), F.col("only_id"))
        .when(joins & before_ord.isNull(), F.col("bare_id"))
        .alias("existing_id"),
        F.when(single & (F.col("total") == 0), F.col("name_first"))
        .when(~single & ~joins, F.col("ord"))
        .when(joins, before_ord)
        .alias("creator_ord"),
        F.coalesce(F.col("leads") & (fills_single | joins), F.lit(False)).alias("fills_domain"),
    )


def resolve_companies(
    candidates: DataFrame,
    companies: DataFrame,
    next_id_after: int = 0,
    width: int = BLOCK_WIDTH,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Adds domain, normalized_name, company_id, creates_company and fills_domain to every candidate.

    `candidates` needs a unique LONG `ord`, `company_name` and `website`. `companies` is the stored table.
    New companies get ids after `next_id_after` in arrival order of the candidates that made them.

    Domains and names are worked out and written once. Stored companies pass a filter of them where they are scanned, so
    of the store only what this run may meet is shuffled. Candidates of one domain collapse to their leader
    before any shuffle. The final lookup meets one row per domain or bare candidate; a domain with more than
    `hot_rows` candidates is salted there.
    """
    narrow = cut_lineage(identify(candidates.select("ord", "company_name", "website")).drop("company_name", "website"))
    companies = with_any_key(companies, narrow, {"website_domain": "domain", "normalized_name": "normalized_name"})
    companies = cut_lineage(companies.select("id", "website_domain", "normalized_name"))
    domains = cut_lineage(first_per_domain(narrow).join(known_domains(companies), "domain", "left"))
    leaders = domains.where(F.col("known_id").isNull()).select(
        F.col("leader_ord").alias("ord"), "domain", "normalized_name", F.lit(True).alias("leads")
    )
    bare = narrow.where(F.col("domain").isNull()).select(
        "ord", "domain", "normalized_name", F.lit(False).alias("leads")
    )
    movers = assign_ids(leaders.unionByName(bare), "ord", "place")
    placed = cut_lineage(_place_movers(movers, companies, width))
    creators = placed.where(F.col("creator_ord") == F.col("ord")).select("creator_ord", "place")
    new_ids = rank_places(creators, "place", "new_id", next_id_after, width).drop("place")
    # A company of a common name has many members. Rows of a stored company get a key of their own, since
    # rows without a key would all meet in one task.
    members = placed.groupBy("creator_ord").agg(F.count(F.lit(1)).alias("key_rows"))
    placed = placed.withColumn("creator", F.coalesce(F.col("creator_ord"), -1 - F.col("ord")))
    created = new_ids.join(members, "creator_ord").withColumnRenamed("creator_ord", "creator")
    outcome = salted_lookup(placed, created, ["creator"], "ord", hot_rows).select(
        _handle(F.col("domain"), F.col("ord")).alias("handle"),
        F.coalesce("existing_id", "new_id").alias("company_id"),
        F.col("ord").alias("mover_ord"),
        F.coalesce(F.col("creator_ord") == F.col("ord"), F.lit(False)).alias("creates"),
        F.col("fills_domain").alias("fills"),
    )
    stored = domains.where(F.col("known_id").isNotNull()).select(
        F.col("domain").alias("handle"),
        F.col("known_id").alias("company_id"),
        F.lit(None).cast("long").alias("mover_ord"),
        F.lit(False).alias("creates"),
        F.lit(False).alias("fills"),
    )
    counts = domains.select(F.col("domain").alias("handle"), "key_rows")
    entries = (
        outcome.unionByName(stored).join(counts, "handle", "left").fillna(1, ["key_rows"])
    )
    moved_here = F.coalesce(F.col("ord") == F.col("mover_ord"), F.lit(False))
    handled = narrow.withColumn("handle", _handle(F.col("domain"), F.col("ord")))
    outcome = (
        salted_lookup(handled, cut_lineage(entries), ["handle"], "ord", hot_rows)
        .withColumn("creates_company", moved_here & F.col("creates"))
        .withColumn("fills_domain", moved_here & F.col("fills"))
        .drop("handle", "mover_ord", "creates", "fills")
    )
    # The payload meets the outcome by the unique arrival number, which no row shares with another.
    return candidates.drop(*[name for name in outcome.columns if name != "ord"]).join(outcome, "ord")


def _handle(domain: Column, order: Column) -> Column:
    # A host never contains "#", so bare candidates cannot meet a domain.
    return F.coalesce(domain, F.concat(F.lit("#"), order.cast("string")))


def company_snapshot(companies: DataFrame, resolved: DataFrame, as_of: datetime) -> DataFrame:
    """All companies after a run: those it did not see as they were, the others as `company_changes` has them."""
    changes = cut_lineage(company_changes(companies, resolved, as_of))
    return companies.join(changes.select("id"), "id", "left_anti").unionByName(changes)


def company_changes(companies: DataFrame, resolved: DataFrame, as_of: datetime) -> DataFrame:
    """The companies that a run saw, as they are after it: new ones, domains filled in once, last sighting moved.

    Name and location keep their first value. Stored companies that the run did not see take no part beyond the join
    with the few that it did.
    """
    now = F.lit(as_of)
    added = F.col("creates_company")
    filled = F.col("fills_domain")
    # At most one candidate creates a company and at most one fills its domain, so each max() sees one value.
    seen = resolved.groupBy(F.col("company_id").alias("id")).agg(
        F.max(F.when(added, F.col("company_name"))).alias("new_name"),
        F.max(F.when(added, F.col("normalized_name"))).alias("new_normalized"),
        F.max(F.when(added, F.col("location"))).alias("new_location"),
        F.max(F.when((added | filled) & F.col("domain").isNotNull(), F.col("website"))).alias("new_website"),
        F.max(F.when(added | filled, F.col("domain"))).alias("new_domain"),
        F.max(F.when(added & F.col("domain").isNull(), F.col("website"))).alias("bare_website"),
    )
    fill = F.col("website_domain").isNull() & F.col("new_domain").isNotNull()
    seen = cut_lineage(seen)
    known = companies.join(seen, "id")
    # A company is new to the store if a candidate of this run made it.
    new = seen.where(F.col("new_name").isNotNull()).join(companies.limit(0), "id", "left")
    return known.unionByName(new).select(
        "id",
        F.coalesce("name", "new_name").alias("name"),
        F.coalesce("normalized_name", "new_normalized").alias("normalized_name"),
        F.when(fill, F.col("new_website")).otherwise(F.coalesce("website", "bare_website")).alias("website"),
        F.coalesce("website_domain", "new_domain").alias("website_domain"),
        F.coalesce("location", "new_location").alias("location"),
        F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.greatest(F.coalesce("last_seen_at", now), now).alias("last_seen_at"),
    )
