"""How much of a performance gap between two sites is their case mix.

Site B is reweighted to look like site A by the odds of a propensity model.
Weighted against unweighted B is the case-mix part; A against weighted B is what
remains. Scores, thresholds and calibration are held fixed throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators import linear
from ..operators.ordered import exact_quantiles, prefix_totals
from ..session import staged


def site_weights(entities: DataFrame, features: Sequence[str], is_reference: str, trim_percent: int = 1) -> tuple[DataFrame, dict]:
    """Odds of belonging to the reference site per comparison entity, trimmed at
    the given outer percentiles; also reports how many were trimmed."""
    model = linear.fit_logistic(entities, features, is_reference, balanced=False)
    odds = model.predict(entities, "_p").where(F.col(is_reference) == 0).withColumn("_odds", F.try_divide(F.col("_p"), F.lit(1.0) - F.col("_p")))
    odds = staged(odds, "odds")
    ends = {r["j"]: r["q"] for r in exact_quantiles(odds, "_odds", [(trim_percent, 100), (100 - trim_percent, 100)]).collect()}
    low, high = F.lit(ends[0]), F.lit(ends[1])
    trimmed = odds.agg(F.count_if((F.col("_odds") < low) | (F.col("_odds") > high)).alias("n")).first()["n"]
    weights = odds.withColumn("weight", F.least(F.greatest("_odds", low), high)).drop("_p", "_odds")
    return weights, {"low": ends[0], "high": ends[1], "trimmed": trimmed}


def weighted_metrics(rows: DataFrame, threshold: float, weight: str = "weight", score: str = "score", y: str = "y") -> dict:
    """AUROC and normalised utility with row weights; rows carry ``delta``."""
    w = F.col(weight)
    prefix = prefix_totals(rows, score, {"pos": w * F.col(y), "neg": w * (F.lit(1.0) - F.col(y))})
    auc = prefix.agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)), F.max("pos_all") * F.max("neg_all")).alias("auroc")
    ).first()["auroc"]
    gained = F.sum(F.when(F.col(score) >= threshold, F.col("delta") * w).otherwise(0.0))
    best = F.sum(F.greatest(F.col("delta"), F.lit(0.0)) * w)
    return {"auroc": auc, "utility": rows.agg(F.coalesce(F.try_divide(gained, best), F.lit(0.0)).alias("u")).first()["u"]}


def decompose(reference: DataFrame, comparison: DataFrame, weights: DataFrame, entity: str, threshold: float) -> DataFrame:
    """Reference, comparison and reweighted comparison, with the two parts of the gap."""
    ones = lambda df: df.withColumn("weight", F.lit(1.0))
    a = weighted_metrics(ones(reference), threshold)
    b = weighted_metrics(ones(comparison), threshold)
    matched = weighted_metrics(comparison.join(weights.select(entity, "weight"), entity), threshold)
    rows = [(m, a[m], b[m], matched[m], matched[m] - b[m], a[m] - matched[m]) for m in ("auroc", "utility")]
    return reference.sparkSession.createDataFrame(
        rows, "metric string, reference double, comparison double, reweighted double, case_mix double, degradation double"
    )
