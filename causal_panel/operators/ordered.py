"""Order-based arithmetic without a global sort into one task.

Rank statistics, quantiles, threshold sweeps and ROC curves all need, for each
distinct value, the totals of everything below it. ``prefix_totals`` collapses
rows to one row per distinct value (combined before the shuffle, so a value
shared by a third of the rows is one row) and scans them by ranges of values
(``scan.range_scan``). Results are exact and do not depend on where ranges end.
``groups`` may be any columns (feature names, model x split).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged
from .scan import match, range_scan

_ALL = "_all_rows"


def _keys(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    # A constant group keeps one code path for grouped and ungrouped input.
    return (df, list(groups)) if groups else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def distinct_totals(df: DataFrame, value: str, sums: dict[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """One row per distinct non-missing value with the sums of its rows."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    )


def prefix_totals(df: DataFrame, value: str, sums: dict[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """Per distinct value: each sum ``s``, plus ``s_below`` (smaller values) and ``s_all``."""
    totals = distinct_totals(df, value, sums, groups)
    scanned = range_scan(totals, [value], {f"{n}_below": ("sum", n) for n in sums}, by=groups, totals=True)
    columns = [*[F.col(k) for k in groups], F.col(value)]
    for n in sums:
        columns += [F.col(n), F.col(f"{n}_below"), F.col(f"{n}_below_all").alias(f"{n}_all")]
    return scanned.select(*columns)


def row_positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Add the 1-based place of every row in ``order``: ranges are written with their number, so their bounds are drawn once."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = staged(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = ranges.withColumn("_inside", inside).join(offsets, "_range")
    return placed.withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_range", "_inside", "_before")


def midranks(df: DataFrame, value: str, groups: Sequence[str] = (), name: str = "midrank") -> DataFrame:
    """Average 1-based rank of each distinct value, with its row count ``n`` and ``n_all``."""
    prefix = prefix_totals(df, value, {"n": F.lit(1)}, groups)
    return prefix.select(
        *groups, value, "n", "n_all", (F.col("n_below") + (F.col("n") + 1) / 2).alias(name)
    )


def quantile_points(
    prefix: DataFrame,
    value: str,
    points: int,
    groups: Sequence[str] = (),
    weight: str = "n",
    payload: Sequence[str] = (),
    probabilities: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles of a table made by ``prefix_totals``.

    By default the ``points`` evenly spaced ones from 0 to 1, else those at the
    integer fractions ``probabilities``. Returns, per group and position ``j``,
    the quantile ``q``, the order statistics ``lo`` and ``hi`` it lies between
    and their ``payload`` columns (prefixed the same way).

    A distinct value covers the ranks [below, below + n). It works out by itself
    which positions ask for one of them and emits those, so a grid costs one pass
    and one aggregate of grid size, without pairing values and positions.
    """
    prefix, keys = _keys(prefix.where(F.col(weight) > 0), groups)
    whole = lambda c: F.col(c).cast("bigint")
    rows = prefix.select(
        *keys, F.struct(value, *payload).alias("_row"), whole(f"{weight}_all").alias("_n"),
        whole(f"{weight}_below").alias("_first"), (whole(f"{weight}_below") + whole(weight) - 1).alias("_last"),
    )
    if probabilities is None:
        if points < 2:
            raise ValueError("a grid needs at least two points")
        d = points - 1

        def asked(first: str, last: str) -> Column:
            """Grid positions whose rank floor((n - 1) j / d) lies in [first, last]."""
            start = F.expr(f"(greatest({first}, 0) * {d}L + greatest(_n - 2, 0)) div greatest(_n - 1, 1)")
            stop = F.expr(f"least(((({last}) + 1) * {d}L + greatest(_n - 2, 0)) div greatest(_n - 1, 1) - 1, {d}L)")
            stop = F.when(F.col("_n") == 1, F.lit(d).cast("bigint")).otherwise(stop)
            start = F.when(F.col("_n") == 1, F.lit(0).cast("bigint")).otherwise(start)
            return F.when((start <= stop) & F.expr(f"({last}) >= 0"), F.sequence(start, stop)).otherwise(F.array().cast("array<bigint>"))

        lo_at = asked("_first", "_last")
        # The neighbour above; the largest value is its own neighbour.
        hi_at = F.when(F.col("_last") == F.col("_n") - 1, asked("_first - 1", "_last")).otherwise(asked("_first - 1", "_last - 1"))
        fraction = F.expr(f"((_n - 1) * j) % {d}L") / F.lit(float(d))
    else:
        listed = F.array(*[F.struct(F.lit(j).cast("bigint").alias("j"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for j, (a, b) in enumerate(probabilities)])
        rank = lambda p: F.floor((F.col("_n") - 1) * p["a"] / p["b"])
        inside = lambda r: (r >= F.col("_first")) & (r <= F.col("_last"))
        lo_at = F.transform(F.filter(listed, lambda p: inside(rank(p))), lambda p: p["j"])
        hi_at = F.transform(F.filter(listed, lambda p: inside(F.least(rank(p) + 1, F.col("_n") - 1))), lambda p: p["j"])
        table = F.element_at(listed, (F.col("j") + 1).cast("int"))
        fraction = F.pmod((F.col("_n") - 1) * table["a"], table["b"]) / table["b"]

    mark = lambda at, side: F.transform(at, lambda j: F.struct(j.alias("j"), F.lit(side).alias("side")))
    hits = rows.withColumn("_hit", F.concat(mark(lo_at, "lo"), mark(hi_at, "hi"))).where(F.size("_hit") > 0)
    hits = hits.select(*keys, "_n", "_row", F.explode("_hit").alias("_hit")).select(
        *keys, "_n", "_row", F.col("_hit.j").alias("j"), F.col("_hit.side").alias("_side")
    )
    side = lambda s: F.max(F.when(F.col("_side") == s, F.col("_row"))).alias(f"_{s}")
    both = hits.groupBy(*keys, "j", "_n").agg(side("lo"), side("hi"))
    lo, hi = F.col(f"_lo.{value}"), F.col(f"_hi.{value}")
    return both.select(
        *groups,
        F.col("j").cast("int").alias("j"),
        (lo + (hi - lo) * fraction).alias("q"),
        lo.alias("lo"),
        hi.alias("hi"),
        *[F.col(f"_{s}.{p}").alias(f"{s}_{p}") for p in payload for s in ("lo", "hi")],
    )


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[tuple[int, int]], groups: Sequence[str] = ()
) -> DataFrame:
    """Exact interpolated quantiles at integer-fraction probabilities, per group."""
    prefix = prefix_totals(df, value, {"n": F.lit(1)}, groups)
    return quantile_points(prefix, value, 0, groups, probabilities=probabilities).select(*groups, "j", "q")


def quantile_edges(prefix: DataFrame, value: str, bins: int, groups: Sequence[str] = (), weight: str = "n") -> DataFrame:
    """Sorted distinct quantile edges of each group as one short array ``edges``."""
    points = quantile_points(prefix, value, bins + 1, groups, weight)
    points, keys = _keys(points, groups)
    edges = points.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.collect_list("q"))).alias("edges"))
    return edges.select(*groups, "edges")


def histogram(df: DataFrame, value: str, edges: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Counts on given edges: left-closed bins, the last one closed on both sides.

    Values outside the edges are not counted; empty bins are reported with 0, in
    every group of ``df``.
    """
    spark = df.sparkSession
    v = F.col(value)
    interior = [F.lit(float(e)) for e in edges[1:-1]]
    position = sum([(v >= e).cast("int") for e in interior], F.lit(0))
    counted = (
        df.where((v >= F.lit(float(edges[0]))) & (v <= F.lit(float(edges[-1]))))
        .groupBy(*groups, position.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = spark.createDataFrame(
        [(i, float(edges[i]), float(edges[i + 1])) for i in range(len(edges) - 1)], "bin int, low double, high double"
    )
    if groups:  # a row per bin for every group
        bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(edges[i])).alias("low"), F.lit(float(edges[i + 1])).alias("high")) for i in range(len(edges) - 1)])
        frame = df.select(*groups).distinct().withColumn("_bin", F.explode(bins)).select(*groups, "_bin.*")
    return match(frame, counted, [*groups, "bin"], "left").select(*groups, "bin", "low", "high", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
