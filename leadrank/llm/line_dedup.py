"""Removal of lines that many documents share.

Lines are exploded with their places and named by a 128-bit hash of their normalised form. Documents per name are
counted; names over the threshold meet their lines again, and what they drop comes back to each text as a list of places.
Texts themselves move once, when they meet their list.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from leadrank.llm.common import without
from leadrank.session import cut_lineage

LEAST_CHARS = 40
LEAST_DOCS = 5
SPACES = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _names(lines: DataFrame) -> DataFrame:
    """`line` replaced by two independent 64-bit hashes of it, stripped and with A-Z in lower case."""
    folded = F.translate("line", string.ascii_uppercase, string.ascii_lowercase)
    names = [F.xxhash64(F.lit(seed), folded).alias(f"name_{seed}") for seed in (1, 2)]
    return lines.select("doc", "unit", "place", *names)


def shared_lines(docs: DataFrame, text: str, key: str, least_chars: int, least_docs: int) -> DataFrame:
    """`doc`, `unit` (key and hash of a text) and `gone`, the places of the lines that it loses."""
    spread = docs.select(
        F.col(key).alias("doc"), F.xxhash64(text).alias("unit"), F.posexplode(lines_of(F.col(text))).alias("place", "line")
    ).withColumn("line", F.btrim("line", F.lit(SPACES)))
    lines = cut_lineage(_names(spread.where(F.char_length("line") >= least_chars)))
    name = ["name_1", "name_2"]
    # Rows without a key count as one document, which comes before all others.
    holders = F.count_distinct("doc") + F.max(F.col("doc").isNull().cast("int"))
    held = lines.groupBy(*name).agg(holders.alias("holders"), F.max("doc").alias("keeper")).where(F.col("holders") >= least_docs)
    found = lines.join(held.select(*name, "keeper"), name)
    lost = found.where(F.col("doc").isNull() | (F.col("doc") != F.col("keeper")))
    return lost.groupBy("doc", "unit").agg(F.collect_set("place").alias("gone"))


def deduplicated(
    docs: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """`docs` with `n_lines`, `n_dropped` and `kept_text`, the text without lines that many documents share.

    * Lines end at \\n. A line counts by its normalised form: ASCII white space stripped at both ends, A-Z in lower case.
    * A form of at least `least_chars` code points that at least `least_docs` documents hold goes everywhere but in the
      document with the largest key among them, where all its lines stay.
    * Null and empty texts have one empty line. A text that loses all its lines becomes empty.
    * Rows that share a key are one document. Rows without a key are one document too, before all others.
    * Rows and other columns stay; columns of the three names are replaced. An empty table gives an empty one.

    A list of places is never longer than its text has lines. A line with a third of all rows combines in the map tasks
    when it is counted, and adaptive execution splits it when lines meet their count.
    """
    lost = shared_lines(docs, text, key, least_chars, least_docs)
    rows = without(docs, ["n_lines", "n_dropped", "kept_text"])
    names = [F.col(f"row.`{name}`") for name in rows.columns]
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in rows.columns]).alias("row"),
        F.col(key).alias("at"),
        F.xxhash64(text).alias("of"),
        F.coalesce(F.col(text), F.lit("")).alias("whole"),
    )
    met = rows.join(lost, F.col("at").eqNullSafe(F.col("doc")) & (F.col("of") == F.col("unit")), "left")
    breaks = F.octet_length("whole") - F.octet_length(F.replace("whole", F.lit("\n"), F.lit("")))
    stay = F.array_except(F.sequence(F.lit(0), breaks), F.col("gone"))
    # The outer transform binds the split text once; inside the inner one it would be split again for each line.
    picked = F.transform(F.array(lines_of(F.col("whole"))), lambda ls: F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n"))
    judged = met.select(
        "row",
        (breaks + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.get(picked, F.lit(0))).alias("kept_text"),
    )
    return judged.select(*names, "n_lines", "n_dropped", "kept_text")
