"""Ranking quality from distinct scores with prefix totals (see ``ordered``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.tails import normal_two_sided
from .ordered import prefix_totals


def label_prefix(scores: DataFrame, score: str = "score", y: str = "y", groups: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with running counts of rows and positives."""
    return prefix_totals(scores, score, {"n": F.lit(1), "pos": F.col(y).cast("bigint")}, groups)


def _neg(side: str = ""):
    return F.col(f"n{side}") - F.col(f"pos{side}")


def auroc(prefix: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half."""
    wins = F.sum(F.col("pos") * (_neg("_below") + _neg() / F.lit(2.0)))
    pairs = F.max("pos_all").cast("double") * F.max(_neg("_all")).cast("double")
    return prefix.groupBy(*groups).agg(F.try_divide(wins, pairs).alias("auroc"))


def average_precision(prefix: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Step-wise area: recall gained at each distinct score times its precision."""
    hits = (F.col("pos_all") - F.col("pos_below")).cast("double")
    flagged = F.col("n_all") - F.col("n_below")
    gained = F.sum(F.col("pos") * hits / flagged)
    return prefix.groupBy(*groups).agg(F.try_divide(gained, F.max("pos_all").cast("double")).alias("auprc"))


def roc_points(prefix: DataFrame, score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    return prefix.select(
        *groups,
        F.col(score).alias("threshold"),
        F.try_divide(_neg("_all") - _neg("_below"), _neg("_all")).alias("fpr"),
        F.try_divide(F.col("pos_all") - F.col("pos_below"), F.col("pos_all")).alias("tpr"),
    )


def pr_points(prefix: DataFrame, score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    hits = F.col("pos_all") - F.col("pos_below")
    return prefix.select(
        *groups,
        F.col(score).alias("threshold"),
        F.try_divide(hits, F.col("pos_all")).alias("recall"),
        (hits / (F.col("n_all") - F.col("n_below"))).alias("precision"),
    )


def delong_components(rows: DataFrame, a: str, b: str, y: str = "y") -> DataFrame:
    """AUC pair, their difference, its variance and z for two scores of the same rows.

    Rows collapse to distinct (score, score, label) triples first. The placement
    of a score among the other class depends on its value alone, so it is looked
    up per distinct value instead of ranking the rows.
    """
    triples = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b"), F.col(y).cast("int").alias("y")).agg(
        F.count(F.lit(1)).alias("w")
    )

    def placements(side: str) -> DataFrame:
        sums = {"n": F.col("w"), "pos": F.col("w") * F.col("y")}
        prefix = prefix_totals(triples, side, sums)
        among_neg = (_neg("_below") + _neg() / F.lit(2.0)) / _neg("_all")
        among_pos = F.lit(1.0) - (F.col("pos_below") + F.col("pos") / F.lit(2.0)) / F.col("pos_all")
        return prefix.select(side, among_neg.alias(f"{side}_v10"), among_pos.alias(f"{side}_v01"))

    v = lambda s: F.when(F.col("y") == 1, F.col(f"{s}_v10")).otherwise(F.col(f"{s}_v01"))
    placed = (
        triples.join(placements("a"), "a").join(placements("b"), "b")
        .select("y", F.col("w").cast("double").alias("w"), v("a").alias("va"), v("b").alias("vb"))
    )
    w, va, vb = F.col("w"), F.col("va"), F.col("vb")
    by_class = placed.groupBy("y").agg(
        F.sum("w").alias("k"),
        F.sum(w * va).alias("sa"), F.sum(w * vb).alias("sb"),
        F.sum(w * va * va).alias("saa"), F.sum(w * vb * vb).alias("sbb"), F.sum(w * va * vb).alias("sab"),
    )
    cov = lambda xy, x, z: F.try_divide(F.col(xy) - F.col(x) * F.col(z) / F.col("k"), F.col("k") - 1)
    part = by_class.select(
        "y", "k", "sa", "sb",
        ((cov("saa", "sa", "sa") + cov("sbb", "sb", "sb") - 2 * cov("sab", "sa", "sb")) / F.col("k")).alias("var"),
    )
    positive = F.col("y") == 1
    joined = part.agg(
        F.max(F.when(positive, F.col("sa") / F.col("k"))).alias("auc_a"),
        F.max(F.when(positive, F.col("sb") / F.col("k"))).alias("auc_b"),
        F.sum("var").alias("var"),
    )
    diff = F.col("auc_a") - F.col("auc_b")
    z = F.when(F.col("var") > 0, diff / F.sqrt("var")).otherwise(F.lit(0.0))
    return joined.select("auc_a", "auc_b", diff.alias("diff"), "var", z.alias("z"))


def delong_test(rows: DataFrame, a: str, b: str, y: str = "y") -> dict[str, float]:
    """The one-row result of ``delong_components`` with its two-sided p-value."""
    found = delong_components(rows, a, b, y).first().asDict()
    found["p_value"] = normal_two_sided(found["z"]) if found.pop("var") > 0 else 1.0
    return found
