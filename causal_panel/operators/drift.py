"""Distribution shift between a reference and a comparison population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import bin_of, right_closed_bin
from ..functions.tails import ks_p
from ..session import staged
from .ordered import prefix_totals, quantile_edges

REFERENCE, COMPARISON = 0, 1
EPSILON = 1e-6


def both_sides(reference: DataFrame, comparison: DataFrame, features: Sequence[str], side: str = "side") -> DataFrame:
    tagged = [
        df.select(F.lit(tag).alias(side), *[F.col(f).cast("double").alias(f) for f in features])
        for df, tag in ((reference, REFERENCE), (comparison, COMPARISON))
    ]
    return tagged[0].unionByName(tagged[1])


def drift_report(pair: DataFrame, features: Sequence[str], side: str = "side", bins: int = 10) -> DataFrame:
    """PSI and two-sample KS per feature over all rows.

    One long pass collapses rows to distinct values with a count per side;
    quantile edges, bin shares and the KS distance all come from that table.
    """
    doubles = [F.col(f).cast("double").alias(f) for f in features]
    is_ref = F.col(side) == REFERENCE
    profile = pair.select(side, *doubles).groupBy(side).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.struct(F.count(f).alias("n"), F.avg(f).alias("m")).alias(f) for f in features],
    )
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`.n").alias("n"), F.col(f"`{f}`.m").alias("m")) for f in features])
    profile = profile.select(side, "_rows", F.explode(entries).alias("e")).select(side, "_rows", "e.*")
    pick = lambda tag, c: F.max(F.when(F.col(side) == tag, c))
    gap = 1 - F.col("n") / F.col("_rows")
    sides = profile.groupBy("feature").agg(
        pick(REFERENCE, gap).alias("missing_ref"), pick(COMPARISON, gap).alias("missing_cmp"),
        pick(REFERENCE, F.col("m")).alias("mean_ref"), pick(COMPARISON, F.col("m")).alias("mean_cmp"),
        F.coalesce(pick(REFERENCE, F.col("n")), F.lit(0)).alias("n_ref"),
        F.coalesce(pick(COMPARISON, F.col("n")), F.lit(0)).alias("n_cmp"),
    )

    long = pair.select(side, *doubles).unpivot(side, list(features), "feature", "value")
    sums = {"n": is_ref.cast("bigint"), "c": (~is_ref).cast("bigint")}
    # Read three times below: for the distance, the edges and the bin counts.
    prefix = staged(prefix_totals(long, "value", sums, ["feature"]), "drift-prefix")
    gap_between = F.abs(
        F.try_divide(F.col("n_below") + F.col("n"), F.col("n_all")) - F.try_divide(F.col("c_below") + F.col("c"), F.col("c_all"))
    )
    ks = prefix.groupBy("feature").agg(F.max(gap_between).alias("_ks"))

    edges = quantile_edges(prefix, "value", bins, ["feature"])
    # At most bins + 1 edges per feature.
    binned = prefix.join(F.broadcast(edges), "feature").withColumn(
        "_bin", bin_of(F.col("value"), F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0))))
    )
    counts = binned.groupBy("feature", "_bin").agg(
        F.sum("n").alias("r"), F.sum("c").alias("k"), F.max("n_all").alias("nr"), F.max("c_all").alias("nk"),
        F.max(F.size("edges")).alias("n_edges"),
    )
    # Every interior edge is a reference quantile, but a bin may hold no row of
    # either side; such a bin has equal shares (epsilon each) and adds nothing.
    shares = counts.join(F.broadcast(sides.select("feature", "missing_ref", "missing_cmp")), "feature").select(
        "feature", "n_edges",
        (F.try_divide("r", "nr") * (1 - F.col("missing_ref")) + EPSILON).alias("p"),
        (F.try_divide("k", "nk") * (1 - F.col("missing_cmp")) + EPSILON).alias("q"),
    )
    shift = shares.groupBy("feature").agg(
        F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("_binned"), F.max("n_edges").alias("_edges")
    )
    table = sides.join(shift, "feature", "left").join(ks, "feature", "left")
    pm, qm = F.col("missing_ref") + EPSILON, F.col("missing_cmp") + EPSILON
    psi = (
        F.when((F.col("n_ref") < bins) | (F.col("n_cmp") == 0), F.lit(None))
        .when(F.col("_edges") < 3, F.abs(F.col("missing_cmp") - F.col("missing_ref")))
        .otherwise(F.col("_binned") + (qm - pm) * F.ln(qm / pm))
    )
    enough = (F.col("n_ref") > 10) & (F.col("n_cmp") > 10)
    table = table.withColumns({"psi": psi, "ks_stat": F.when(enough, F.col("_ks"))})
    return table.select(
        "feature", "psi", "missing_ref", "missing_cmp", "mean_ref", "mean_cmp", "ks_stat",
        ks_p("ks_stat", "n_ref", "n_cmp").alias("ks_p"),
        right_closed_bin("psi", [0.1, 0.25], ["stable", "moderate", "material"]).alias("severity"),
    )


def ranked(report: DataFrame) -> DataFrame:
    """Largest shift first, missing last."""
    return report.orderBy(F.desc_nulls_last("psi"), "feature")


def population_stability_index(reference: DataFrame, comparison: DataFrame, column: str, bins: int = 10) -> float | None:
    """PSI of one column."""
    pair = both_sides(reference, comparison, [column])
    return drift_report(pair, [column], bins=bins).first()["psi"]
