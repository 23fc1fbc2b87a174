"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 36-bit hash of its id. The words of each source are summed
by hash bucket (12 bits); the bucket in which the source's budget ends is split
by the next 12 bits, and once more. The three bucket numbers are a threshold,
and documents whose hash lies below it are taken: no sort of the documents, and
the same choice in every run. Thresholds are nested: a larger budget takes a
superset.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causal_panel.llm.text import words
from causal_panel.session import staged

BITS, LEVELS = 12, 3


@dataclass(frozen=True)
class MixRule:
    """Source weights (by rank of the source, repeating), words to take in percent of all, most copies of a document."""

    weights: tuple[int, ...] = (5, 2, 1)
    percent: int = 150
    most: int = 2


def _point(key: str) -> Column:
    """36-bit hash of an id; a null id counts as an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, point): words of a text (null: none) and the hash of the id.

    Rows with equal ids, repeated rows included, have the same hash and are taken or left together.
    """
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), _point("doc_id").alias("point"))


def targets(sized: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """(source, source_size, target) of every source, in double.

    Budgets are shared by weight; a source stops at ``most`` times its size and
    its excess is shared among the others. In the order of size over weight the
    sources that stop come first, so prefix sums tell where they end.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.get(F.array(*(F.lit(w) for w in rule.weights)), (F.col("rank") - 1) % len(rule.weights))
    ranked = ranked.withColumn("weight", weight.cast("long"))
    everything = W.partitionBy()
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("rank"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "budget": rule.percent * F.sum("source_size").over(everything),
        "stopped": F.coalesce(F.sum(100 * rule.most * F.col("source_size")).over(before), F.lit(0)),
        "open": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
    })
    # All in hundredths of a word, so the test is exact.
    stops = F.col("weight") * (F.col("budget") - F.col("stopped")) >= 100 * rule.most * F.col("source_size") * F.col("open")
    ranked = ranked.withColumn("stops", stops)
    ranked = ranked.withColumns({
        "rest": F.col("budget") - F.coalesce(F.sum(F.when(F.col("stops"), 100 * rule.most * F.col("source_size"))).over(everything), F.lit(0)),
        "shares": F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything),
    })
    shared = (F.col("weight") * F.col("rest")).cast("double") / (100.0 * F.col("shares"))
    target = F.when(F.col("stops"), (rule.most * F.col("source_size")).cast("double")).otherwise(shared)
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Add ``whole`` (copies of every document) and ``below`` (documents with a smaller hash get one more) to ``budgets``.

    Each level sums words by bucket inside the boundary bucket of the level
    above, so all but the first read a 4096th of the documents' words.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = budgets.withColumn("whole", whole.cast("long"))
    state = state.withColumns({"left": F.col("target") - F.col("whole") * F.col("source_size"), "prefix": F.lit(0).cast("long")})
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = sized.select("source", "size", F.shiftright("point", shift + BITS).alias("prefix"), F.shiftright("point", shift).alias("bucket"))
        if level > 1:
            edge = state.select(F.col("source").alias("edge"), F.col("prefix").alias("edge_prefix"))
            inside = inside.join(edge, F.col("source").eqNullSafe(F.col("edge")) & (F.col("prefix") == F.col("edge_prefix")), "left_semi")
        sums = inside.groupBy("source", "bucket").agg(F.sum("size").alias("tokens"))
        order = W.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("tokens").over(order))
        sums = sums.withColumnRenamed("source", "edge")
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("edge")), "left")
        ends = F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "upto", "tokens")))
        keys = ["source", "source_size", "target", "whole", "left", "prefix"]
        state = staged(joined.groupBy(*keys).agg(ends.alias("end"), F.max("bucket").alias("last")), f"mix-level-{level}")
        past = F.col("end.bucket").isNull()  # the budget covers all words of the level: the edge lies behind its last bucket
        taken = F.col("end.upto") - F.col("end.tokens")
        if level == LEVELS:  # the last bucket goes in if that ends nearer to the budget
            nearer = F.col("end.upto") - F.col("left") < F.col("left") - taken
            below = F.when(past, F.coalesce(F.col("last") + 1, F.col("prefix") * 2**BITS)).otherwise(F.col("end.bucket") + nearer.cast("long"))
            return state.select("source", "source_size", "target", "whole", below.alias("below"))
        state = state.select(
            "source", "source_size", "target", "whole",
            (F.col("left") - F.when(past, 0).otherwise(taken)).alias("left"),
            F.when(past, F.coalesce(F.col("last") + 1, F.lit(0))).otherwise(F.col("end.bucket")).alias("prefix"),
        )


def _copies(rows: DataFrame, point: Column, edges: DataFrame, rule: MixRule) -> DataFrame:
    """``rows`` with the columns of their source's budget and ``copies``; the table of sources is joined as its size allows."""
    joined = rows.join(edges.withColumnRenamed("source", "_edge"), F.col("source").eqNullSafe(F.col("_edge")), "left").drop("_edge")
    return joined.withColumn("copies", F.least(F.col("whole") + (point < F.col("below")).cast("long"), F.lit(rule.most)))


def mix_sources(docs: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document.

    ``taken`` is copies times size, copies at most ``most``. A null source is a
    source of its own, ranked last; texts without words have size 0; a source
    without words has target 0. Empty input gives an empty table. Extra columns
    of ``docs`` are ignored.
    """
    sized = staged(sizes(docs), "mix-sizes")
    mixed = _copies(sized, F.col("point"), thresholds(sized, targets(sized, rule)), rule)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    sized = staged(sizes(docs), "mix-sizes")
    edges = thresholds(sized, targets(sized, rule)).select("source", "whole", "below")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("source").alias("source"), _point("doc_id").alias("point"))
    mixed = _copies(rows, F.col("point"), edges, rule)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
