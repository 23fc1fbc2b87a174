"""Time-dependent alert utility.

For a fixed panel the utility is linear in the alerts: with ``delta = u_pos -
u_neg`` a policy is worth the sum of ``u_neg`` plus the sum of ``delta`` over its
alert rows. A threshold sweep is therefore a suffix sum over distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..spec import UtilityParams
from .ordered import match, prefix_totals, quantile_points


def onsets(rows: DataFrame, entity: str, idx: str, y: str, params: UtilityParams, by: Sequence[str] = ()) -> DataFrame:
    """Event position per positive entity: the label leads it by ``-dt_optimal`` rows."""
    first = rows.where(F.col(y) == 1).groupBy(*by, entity).agg(F.min(idx).alias("_first"))
    return first.select(*by, entity, (F.col("_first") - F.lit(params.dt_optimal)).alias("onset"))


def weight_columns(dt: Column, params: UtilityParams) -> tuple[Column, Column]:
    """Value of alerting and of silence, ``dt`` rows after the event."""
    p = params
    gain = p.max_u_tp / (p.dt_optimal - p.dt_early)
    fade = p.dt_late - p.dt_optimal
    early = dt <= F.lit(p.dt_optimal)
    rising = F.greatest(F.lit(gain) * dt - F.lit(gain * p.dt_early), F.lit(p.u_fp))
    falling = F.lit(-p.max_u_tp / fade) * dt + F.lit(p.max_u_tp / fade * p.dt_late)
    missed = F.lit(p.min_u_fn / fade) * dt - F.lit(p.min_u_fn / fade * p.dt_optimal)
    over = dt > F.lit(p.dt_late)
    u_pos = F.when(dt.isNull(), F.lit(p.u_fp)).when(over, F.lit(0.0)).when(early, rising).otherwise(falling)
    u_neg = F.when(dt.isNull(), F.lit(p.u_tn)).when(over | early, F.lit(0.0)).otherwise(missed)
    return u_pos, u_neg


def utility_weights(
    rows: DataFrame,
    entity: str = "entity",
    idx: str = "idx",
    y: str = "y",
    params: UtilityParams = UtilityParams(),
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``u_pos``, ``u_neg`` and ``delta`` to every row.

    The onset is one small row per positive entity, joined back: unlike a window
    this never gathers an entity's rows, and a skewed join side can be split.
    """
    joined = match(rows, onsets(rows, entity, idx, y, params, by), [*by, entity], "left")
    u_pos, u_neg = weight_columns(F.col(idx) - F.col("onset"), params)
    weighted = joined.withColumns({"u_pos": u_pos, "u_neg": u_neg}).drop("onset")
    return weighted.withColumn("delta", F.col("u_pos") - F.col("u_neg"))


def _best(delta: Column) -> Column:
    return F.sum(F.greatest(delta, F.lit(0.0)))


def utility_scores(weighted: DataFrame, alert: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Raw and normalised utility: 0 is never alerting, 1 the best possible policy."""
    gained = F.sum(F.when(alert, F.col("delta")).otherwise(F.lit(0.0)))
    out = weighted.groupBy(*groups).agg(
        F.sum("u_neg").alias("_idle"), gained.alias("_gained"), _best(F.col("delta")).alias("_best")
    )
    return out.select(
        *groups,
        (F.col("_idle") + F.col("_gained")).alias("utility_raw"),
        F.when(F.col("_best") == 0, F.lit(0.0)).otherwise(F.try_divide("_gained", "_best")).alias("utility"),
    )


SWEEP_SUMS = ("n", "pos", "delta", "best")


def score_prefix(weighted: DataFrame, score: str = "score", y: str = "y", groups: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with running totals of rows, positives and utility."""
    delta = F.col("delta")
    sums = {
        "n": F.lit(1),
        "pos": F.col(y).cast("bigint"),
        "delta": delta,
        "best": F.greatest(delta, F.lit(0.0)),
    }
    return prefix_totals(weighted, score, sums, groups)


def threshold_points(prefix: DataFrame, points: int, score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """Distinct quantile thresholds with the totals of the rows at or above each."""
    payload = [f"{s}_{k}" for s in SWEEP_SUMS for k in ("below", "all")]
    grid = quantile_points(prefix, score, points, groups, payload=payload)
    at_lo = F.col("q") <= F.col("lo")
    above = {
        s: F.when(at_lo, F.col(f"lo_{s}_all") - F.col(f"lo_{s}_below"))
        .otherwise(F.col(f"hi_{s}_all") - F.col(f"hi_{s}_below"))
        for s in SWEEP_SUMS
    }
    flat = grid.select(
        *groups,
        F.col("q").alias("threshold"),
        *[c.alias(f"{s}_above") for s, c in above.items()],
        *[F.col(f"lo_{s}_all").alias(f"{s}_all") for s in SWEEP_SUMS],
    )
    return flat.dropDuplicates([*groups, "threshold"])


def sweep(prefix: DataFrame, points: int = 200, score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """Normalised utility and alert rate at each distinct quantile threshold.

    Utility is missing where no policy can gain anything (the division by zero
    that ``utility_scores`` reports as 0).
    """
    at = threshold_points(prefix, points, score, groups)
    return at.select(
        *groups,
        "threshold",
        F.try_divide("delta_above", "best_all").alias("utility"),
        (F.col("n_above") / F.col("n_all")).alias("alert_rate"),
    )


def best_threshold(swept: DataFrame, groups: Sequence[str] = (), digits: int = 12) -> DataFrame:
    """First maximum of a sweep: the lowest threshold among equal utilities.

    Utilities are compared at ``digits`` decimals, since sums taken in another
    order differ in the last bits.
    """
    key = F.struct(F.round("utility", digits).alias("u"), (-F.col("threshold")).alias("t"))
    top = swept.where(F.col("utility").isNotNull()).groupBy(*groups).agg(
        F.max_by(F.struct("threshold", "utility"), key).alias("_top")
    )
    return top.select(*groups, F.col("_top.threshold").alias("threshold"), F.col("_top.utility").alias("utility"))


def expected_cost_sweep(
    prefix: DataFrame,
    cost_false_alarm: float = 1.0,
    cost_missed: float = 40.0,
    points: int = 200,
    score: str = "score",
    groups: Sequence[str] = (),
) -> DataFrame:
    """Threshold sweep under an explicit price of false alarms and misses."""
    at = threshold_points(prefix, points, score, groups)
    false_alarms = (F.col("n_above") - F.col("pos_above")).cast("bigint")
    missed = (F.col("pos_all") - F.col("pos_above")).cast("bigint")
    return at.select(
        *groups,
        "threshold",
        (F.col("n_above") / F.col("n_all") * F.lit(1000.0)).alias("alerts_per_1000_hours"),
        false_alarms.alias("false_alarms"),
        missed.alias("missed_positive_hours"),
        (F.lit(cost_false_alarm) * false_alarms + F.lit(cost_missed) * missed).alias("expected_cost"),
        F.coalesce(F.try_divide("delta_above", "best_all"), F.lit(0.0)).alias("utility"),
    )
