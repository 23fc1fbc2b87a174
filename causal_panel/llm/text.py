"""Column expressions and small helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """White-space separated words of a text; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Deal the rows to the session's shuffle partitions by ``keys``, or evenly."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def as_text(name: str) -> Column:
    """A column as text, for the way through pandas, where a null among whole numbers would make them floats."""
    return F.col(name).cast("string").alias(name)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
