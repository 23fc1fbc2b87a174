"""Splits, folds and samples by hash order.

``md5(id:seed)`` orders entities independently of partitioning and engine. A
quota is cut from that order with distributed ranks, never by sorting everything
in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import match, prefix_totals

_HEX = 13  # leading hex digits that a double holds exactly (52 bits)


def hash_order(seed: int, *ids: str) -> Column:
    """Hex digest that orders rows pseudo-randomly."""
    parts = [F.col(i).cast("string") for i in ids]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))).cast("binary"))


def _rank(df: DataFrame, ids: Sequence[str], seed: int, strata: Sequence[str] = ()) -> DataFrame:
    """Add ``_rank`` (0-based position in hash order within the stratum) and ``_size``.

    The numeric head of the digest is ranked with bucketed prefix sums. Rows whose
    heads collide (about n^2 / 2^53 of them) are ordered by the whole digest.
    """
    from pyspark.sql import Window

    hashed = df.withColumn("_hash", hash_order(seed, *ids))
    hashed = hashed.withColumn("_head", F.conv(F.substring("_hash", 1, _HEX), 16, 10).cast("double"))
    prefix = prefix_totals(hashed, "_head", {"_k": F.lit(1)}, strata).select(
        *strata, "_head", F.col("_k_below").alias("_below"), F.col("_k_all").alias("_size")
    )
    tie = Window.partitionBy(*strata, "_head").orderBy("_hash", *ids)
    ranked = hashed.withColumn("_tie", F.row_number().over(tie) - 1)
    return match(ranked, prefix, [*strata, "_head"]).withColumn("_rank", F.col("_below") + F.col("_tie")).drop(
        "_hash", "_head", "_below", "_tie"
    )


def entity_labels(panel: DataFrame, entity: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Largest label per entity."""
    return panel.groupBy(*by, entity).agg(F.max(label).alias(label))


def share(size: Column, numerator: int, denominator: int) -> Column:
    """Rows of a stratum a fraction stands for, rounded half up in integers."""
    return F.floor((size * F.lit(2 * numerator) + F.lit(denominator)) / F.lit(2 * denominator)).cast("bigint")


def make_splits(
    panel: DataFrame,
    entity: str,
    label: str,
    site: str,
    development: str,
    seed: int,
    test_percent: int = 15,
    val_percent: int = 15,
) -> DataFrame:
    """Entity -> split table: train/val/test of one site, everything else external.

    Stratified on the entity label, a missing label being a stratum of its own;
    every stratum meets its quota exactly. A missing site counts as another. The
    validation quota is a share of the whole, as ``val / (1 - test)`` of the rest.
    """
    labels = entity_labels(panel, entity, label, (site,))
    home = _rank(labels.where(F.col(site) == development), [entity], seed, [label])
    test = share(F.col("_size"), test_percent, 100)
    val = share(F.col("_size"), val_percent, 100)
    name = (
        F.when(F.col("_rank") < test, "test").when(F.col("_rank") < test + val, "val").otherwise("train")
    )
    away = labels.where(~F.col(site).eqNullSafe(development)).select(entity, F.lit("external").alias("split"))
    return home.select(entity, name.alias("split")).unionByName(away)


def take(panel: DataFrame, assignment: DataFrame, entity: str, split: str) -> DataFrame:
    """Rows of the entities assigned to one split."""
    return panel.join(assignment.where(F.col("split") == split).select(entity), entity, "left_semi")


def with_split(panel: DataFrame, assignment: DataFrame, entity: str) -> DataFrame:
    """The whole panel with its split as a column: one job feeds every split."""
    return panel.join(assignment, entity)


def entity_split(panel: DataFrame, entity: str, label: str, seed: int, test_percent: int = 25) -> DataFrame:
    """Honest two-way split table (entity, split) with whole entities on one side."""
    ranked = _rank(entity_labels(panel, entity, label), [entity], seed, [label])
    name = F.when(F.col("_rank") < share(F.col("_size"), test_percent, 100), "test").otherwise("train")
    return ranked.select(entity, name.alias("split"))


def row_split(panel: DataFrame, ids: Sequence[str], seed: int, test_percent: int = 25) -> DataFrame:
    """Deliberate leak: rows go to train or test whatever entity they belong to.

    Exactly ``int(n * (1 - test))`` rows are train rows.
    """
    ranked = _rank(panel, ids, seed)
    train = F.floor(F.col("_size") * F.lit(100 - test_percent) / F.lit(100))
    return ranked.withColumn("split", F.when(F.col("_rank") < train, "train").otherwise("test")).drop("_rank", "_size")


def grouped_folds(panel: DataFrame, entity: str, label: str, folds: int, seed: int) -> DataFrame:
    """Entity -> fold table: entities whole, positives dealt evenly over folds."""
    ranked = _rank(entity_labels(panel, entity, label), [entity], seed, [label])
    return ranked.select(entity, (F.col("_rank") % folds).cast("int").alias("fold"))


def downsample_negatives(
    rows: DataFrame, label: str, ids: Sequence[str], keep_percent: int, seed: int
) -> DataFrame:
    """Exactly ``int(n_negative * keep)`` negatives, and all rows that are not negatives: positives and rows without a label."""
    ranked = _rank(rows.where(F.col(label) == 0), ids, seed)
    quota = F.floor(F.col("_size") * F.lit(keep_percent) / F.lit(100))
    kept = ranked.where(F.col("_rank") < quota).drop("_rank", "_size")
    return rows.where(~F.col(label).eqNullSafe(0)).unionByName(kept)


def sample_rows(rows: DataFrame, ids: Sequence[str], size: int, seed: int) -> DataFrame:
    """Fixed-size sample without replacement: the first rows in hash order."""
    ordered = rows.withColumn("_hash", hash_order(seed, *ids))
    return ordered.orderBy("_hash", *ids).limit(size).drop("_hash")


def overlapping_entities(assignment: DataFrame, entity: str) -> DataFrame:
    """Entities found in more than one split; empty for an honest split."""
    return assignment.groupBy(entity).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def shared_entities(train: DataFrame, test: DataFrame, entity: str) -> DataFrame:
    """Entities on both sides."""
    return train.select(entity).intersect(test.select(entity))


def split_summary(rows: DataFrame, entity: str, label: str, split: str = "split") -> DataFrame:
    """Rows, entities, positive entities and rates per split, in two steps."""
    per_entity = rows.groupBy(split, entity).agg(
        F.count(F.lit(1)).alias("_n"), F.max(label).alias("_max"), F.sum(label).alias("_sum")
    )
    return per_entity.groupBy(split).agg(
        F.sum("_n").cast("bigint").alias("hours"),
        F.count(F.lit(1)).cast("bigint").alias("admissions"),
        F.sum("_max").cast("bigint").alias("septic_admissions"),
        F.avg("_max").alias("septic_admission_rate"),
        (F.sum("_sum") / F.sum("_n")).alias("positive_hour_rate"),
    )
