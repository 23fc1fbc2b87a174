"""Ordered per-entity arrays and padded batches for sequence learners."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .aggregates import column_moments
from .ordered import match, row_positions
from .splits import hash_order

STATIC_FEATURES = ("age", "gender", "unit_micu", "unit_sicu", "unit_unknown", "hosp_adm_time", "log_iculos")


@dataclass(frozen=True)
class SequenceEncoder:
    """Standardised carried-forward values, a mask per channel, standardised statics.

    The mask says whether a channel has been measured at all so far, because it
    is read off carried-forward values.
    """

    values: tuple[str, ...]
    statics: tuple[str, ...]
    moments: dict[str, tuple[float, float]]

    @property
    def n_features(self) -> int:
        return 2 * len(self.values) + len(self.statics)

    def steps(self):
        """One array per row: values, masks, statics."""
        scaled = lambda c: (F.col(c).cast("double") - F.lit(self.moments[c][0])) / F.lit(self.moments[c][1])
        filled = [F.coalesce(scaled(c), F.lit(0.0)) for c in self.values]
        masks = [F.col(c).isNotNull().cast("double") for c in self.values]
        return F.array(*filled, *masks, *[F.coalesce(scaled(c), F.lit(0.0)) for c in self.statics])

    def transform(self, rows: DataFrame, entity: str, idx: str, label: str, longest: int) -> DataFrame:
        """One row per entity with its steps and labels in order.

        Stays longer than ``longest`` continue in further segments, so no row
        holds an unbounded history.
        """
        segment = F.floor(F.col(idx) / F.lit(longest)).cast("int").alias("segment")
        step = F.struct(F.col(idx).alias("at"), self.steps().alias("x"), F.col(label).cast("double").alias("y"))
        ordered = rows.groupBy(entity, segment).agg(F.sort_array(F.collect_list(step)).alias("_s"))
        return ordered.select(
            entity, "segment", F.size("_s").alias("n"),
            F.transform("_s", lambda s: s["x"]).alias("x"), F.transform("_s", lambda s: s["y"]).alias("y"),
        )


def fit_sequence_encoder(rows: DataFrame, values: Sequence[str], statics: Sequence[str] = STATIC_FEATURES) -> SequenceEncoder:
    found = column_moments(rows, [*values, *statics]).collect()
    return SequenceEncoder(tuple(values), tuple(statics), {r["feature"]: (r["mean"], r["std"]) for r in found})


def make_batches(
    sequences: DataFrame, entity: str, width: int, batch_size: int = 64, positive_weight: float = 1.0, seed: int = 0
) -> DataFrame:
    """Batches of similar length, padded to their own longest member.

    Sequences are numbered in the order of length and hash, range by range; padded
    steps weigh 0, positive steps ``positive_weight``.
    """
    keys = [entity, "segment"]
    order = [F.col("n"), hash_order(seed, *keys), *[F.col(k) for k in keys]]
    places = row_positions(sequences.select(*keys, "n"), order, "_place").select(*keys, "_place")  # narrow rows
    numbered = match(sequences, places, keys)
    position = F.col("_place") - 1
    placed = numbered.withColumn("batch", F.floor(position / F.lit(batch_size))).withColumn("slot", F.pmod(position, F.lit(batch_size)).cast("int"))
    tops = placed.groupBy("batch").agg(F.max("n").alias("steps"))
    padded = placed.join(tops, "batch")
    gap = F.col("steps") - F.col("n")
    blank = F.array_repeat(F.array_repeat(F.lit(0.0), width), gap)
    weights = F.transform("y", lambda v: F.when(v > 0, F.lit(float(positive_weight))).otherwise(F.lit(1.0)))
    zeros = F.array_repeat(F.lit(0.0), gap)
    return padded.select(
        "batch", "slot", entity, "segment", "n", "steps",
        F.concat("x", blank).alias("x"), F.concat("y", zeros).alias("y"), F.concat(weights, zeros).alias("w"),
    )
