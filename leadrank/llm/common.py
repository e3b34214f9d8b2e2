"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A word is a run of anything but the six ASCII white-space characters; bytes.split() cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` without the columns that the operator is about to add; names compare as Spark compares them."""
    taken = {name.lower() for name in names}
    return df.drop(*[name for name in df.columns if name.lower() in taken])


def text_key(text: Column | str) -> Column:
    """A 128-bit name of a text; null and the empty text share one."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.md5(text.cast("binary"))
