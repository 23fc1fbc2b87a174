"""Group and column aggregates shared by the statistics and the models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import latest
from .ordered import match


def entity_summaries(rows: DataFrame, entity: str, label: str, features: Sequence[str], how: str = "mean") -> DataFrame:
    """One value per entity and feature (missing skipped) and the entity label.

    ``how`` names any Spark aggregate of one column.
    """
    apply = getattr(F, how)
    return rows.groupBy(entity).agg(*[apply(c).alias(c) for c in features], F.max(label).alias(label))


def last_observed(rows: DataFrame, entity: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Last non-missing value per entity: a fixed-size buffer, no sort."""
    return rows.groupBy(entity).agg(*[latest(F.col(c), F.col(order)).alias(c) for c in columns])


def with_entity_max(rows: DataFrame, entity: str, column: str, name: str) -> DataFrame:
    """Group maximum on every row, joined from one row per entity."""
    top = rows.groupBy(entity).agg(F.max(column).alias(name))
    return match(rows, top, [entity], "left")


def column_profile(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing-aware mean and missing share of every column, one row per column."""
    wide = rows.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}|mean") for c in columns],
        *[F.avg(F.col(c).isNull().cast("int")).alias(f"{c}|gap") for c in columns],
    )
    return stacked(wide, columns, ("mean", "gap"), by).select(
        *by, "feature", F.col("mean"), F.col("gap").alias("missing")
    )


def stacked(wide: DataFrame, columns: Sequence[str], parts: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Turn one row of ``column|part`` fields into one row per column."""
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), *[F.col(f"`{c}|{p}`").cast("double").alias(p) for p in parts])
            for c in columns
        ]
    )
    return wide.select(*by, F.explode(entries).alias("_e")).select(*by, "_e.feature", *[F.col(f"_e.{p}").alias(p) for p in parts])


def column_moments(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column; all-missing gives 0 and 1, constant gives 1."""
    wide = rows.agg(
        *[F.avg(c).alias(f"{c}|mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}|std") for c in columns]
    )
    long = stacked(wide, columns, ("mean", "std"))
    return long.select(
        "feature",
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.coalesce(F.nullif("std", F.lit(0.0)), F.lit(1.0)).alias("std"),
    )


def confusion(rows: DataFrame, alert: Column, y: str = "y", groups: Sequence[str] = ()) -> DataFrame:
    positive = F.col(y) == 1
    return rows.groupBy(*groups).agg(
        F.count_if(alert & positive).alias("tp"),
        F.count_if(alert & ~positive).alias("fp"),
        F.count_if(~alert & positive).alias("fn"),
        F.count_if(~alert & ~positive).alias("tn"),
    )


def class_ratio(rows: DataFrame, y: str = "y", groups: Sequence[str] = ()) -> DataFrame:
    """Negatives per positive; 1 when there is no positive."""
    ratio = F.try_divide(F.count_if(F.col(y) == 0), F.count_if(F.col(y) == 1))
    return rows.groupBy(*groups).agg(F.coalesce(ratio, F.lit(1.0)).alias("ratio"))


def positive_weight(rows: DataFrame, y: str) -> float:
    return float(class_ratio(rows, y).first()["ratio"])


def wide_results(results: DataFrame, metrics: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """Model x (split, metric) table from one row per model and split."""
    cells = [F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}") for m in metrics for s in splits]
    return results.groupBy("model").agg(*cells)
