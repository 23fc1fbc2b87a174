"""First alert of every entity from a stream of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_alerts(scored: DataFrame, threshold: float, entity: str = "entity", idx: str = "idx", score: str = "score") -> DataFrame:
    """Earliest row at or above the frozen threshold, per entity.

    An aggregate in update mode: the state is one number per alerting entity, and
    the answer does not depend on the order in which rows arrive.
    """
    alerting = scored.where(F.col(score) >= F.lit(float(threshold)))
    return alerting.groupBy(entity).agg(F.min(idx).alias("first_alert"), F.count(F.lit(1)).alias("n_alert_hours"))


def announce_once(scored: DataFrame, threshold: float, timestamp: str, delay: str, entity: str = "entity", score: str = "score") -> DataFrame:
    """Append-mode form: one announcement per entity within the watermark delay."""
    alerting = scored.withWatermark(timestamp, delay).where(F.col(score) >= F.lit(float(threshold)))
    return alerting.dropDuplicatesWithinWatermark([entity])
