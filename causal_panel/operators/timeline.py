"""Position of rows within an entity, and the layout that keeps one entity from
filling one task.

Entities are split into runs of ``CHUNK_ROWS`` consecutive positions. A run is
the unit of partitioning, so an entity holding a third of the panel is spread
over as many tasks as it has runs. What a run needs from earlier rows reaches it
in two ways: a fixed number of copied rows before its start (for sliding frames
and lags) and one summary row (for running values).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..spec import PanelSpec

CHUNK_ROWS = 16_384
RUN = "_run"
COPIED = "_copied"


def index_rows(panel: DataFrame, spec: PanelSpec, block: int = CHUNK_ROWS) -> DataFrame:
    """Add ``spec.index``: the 0-based position of each row within its entity.

    ``spec.order`` must be an integer that is unique within the entity. Rows are
    numbered inside blocks of the order axis and shifted by the number of rows in
    earlier blocks, so no task sees more than ``block`` rows of one entity.
    """
    e, o = spec.entity, spec.order
    blocked = panel.withColumn("_block", F.floor(F.col(o) / F.lit(block)))
    before = Window.partitionBy(e).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(e, "_block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(e, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(e, "_block").orderBy(o)
    return (
        blocked.withColumn("_row", F.row_number().over(inside))
        .join(offsets, [e, "_block"])
        .withColumn(spec.index, (F.col("_offset") + F.col("_row") - 1).cast("int"))
        .drop("_block", "_row", "_offset")
    )


def longest_entity(panel: DataFrame, spec: PanelSpec) -> int:
    """Rows of the longest entity: one aggregate, combined before its shuffle."""
    if spec.index in panel.columns:
        top = panel.agg(F.max(spec.index).alias("m")).first()["m"]
        return 0 if top is None else int(top) + 1
    counts = panel.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("n"))
    return int(counts.agg(F.max("n").alias("m")).first()["m"] or 0)


@dataclass(frozen=True)
class Layout:
    """A panel arranged for causal windows."""

    df: DataFrame
    spec: PanelSpec
    split: bool
    chunk: int

    @property
    def keys(self) -> list[str]:
        return [self.spec.entity, RUN] if self.split else [self.spec.entity]

    def ordered(self):
        return Window.partitionBy(*self.keys).orderBy(self.spec.index)

    def running(self):
        return self.ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def sliding(self, rows: int):
        return self.ordered().rowsBetween(-(rows - 1), Window.currentRow)

    def replaced(self, df: DataFrame) -> "Layout":
        return Layout(df, self.spec, self.split, self.chunk)

    def summary_block(self) -> Column:
        """Block whose rows all lie before the first (copied) row of later runs."""
        lookback = self.spec.windows.lookback
        return F.floor((F.col(self.spec.index) + F.lit(lookback)) / F.lit(self.chunk)).cast("int")

    def carried(self, source: DataFrame, totals: dict[str, Column], onward: dict[str, Column]) -> DataFrame:
        """Attach to every row what the rows before its run add up to.

        ``totals`` summarise a block of rows; ``onward`` fold the summaries of
        earlier blocks and may refer to the names in ``totals``.
        """
        e = self.spec.entity
        window = Window.partitionBy(e).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
        summary = source.groupBy(e, self.summary_block().alias(RUN)).agg(
            *[c.alias(n) for n, c in totals.items()]
        )
        # The last rows of a run belong to the next block, which may own no run;
        # and a run may own no block rows: both are covered by the left join.
        folded = summary.select(e, RUN, *[c.over(window).alias(n) for n, c in onward.items()])
        return self.df.join(folded, [e, RUN], "left")

    def own_rows(self) -> DataFrame:
        """Drop the copies again."""
        return self.df.where(~F.col(COPIED)).drop(COPIED, RUN) if self.split else self.df


def lay_out(
    panel: DataFrame, spec: PanelSpec, longest: int | None = None, chunk: int = CHUNK_ROWS
) -> Layout:
    """Arrange ``panel`` for causal windows.

    ``longest`` is a bound on the rows of one entity that the caller can vouch
    for; without it one is measured. Entities within one chunk need no splitting.
    """
    if chunk < spec.windows.lookback:
        raise ValueError("a run must be at least as long as the look-back")
    if longest is None:
        longest = longest_entity(panel, spec)
    if longest <= chunk:
        return Layout(panel, spec, False, chunk)
    idx = F.col(spec.index)
    run = F.floor(idx / F.lit(chunk)).cast("int")
    near_end = idx % F.lit(chunk) >= F.lit(chunk - spec.windows.lookback)
    placed = F.array(
        F.struct(run.alias(RUN), F.lit(False).alias(COPIED)),
        F.when(near_end, F.struct((run + 1).alias(RUN), F.lit(True).alias(COPIED))),
    )
    copies = (
        panel.withColumn("_place", F.explode(F.array_compact(placed)))
        .withColumn(RUN, F.col(f"_place.{RUN}"))
        .withColumn(COPIED, F.col(f"_place.{COPIED}"))
        .drop("_place")
    )
    return Layout(copies, spec, True, chunk)
