"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causal_panel.session import staged


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that is not the smallest of its component.

    ``links`` has long columns a and b; order, repeats, nulls and loops do not
    matter. Every round hangs neighbours on the smallest node next to them and
    is written to the shared folder; the number of rounds grows with the
    logarithm of the longest chain. Minima are summed up before the shuffle, and
    what is joined to them can be split where a node has very many links.
    """
    state = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = staged(state, "links")
    before = _print(state)
    for _ in range(rounds):
        if not before[0]:
            break
        state = staged(_small(_large(state)), "links")
        now = _print(state)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _print(state: DataFrame) -> tuple:
    """Count and hash of a table: equal tables have equal ones."""
    return tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 2**31)).first())


def _large(state: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small(state: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = state.groupBy("a").agg(F.min("b").alias("least"))
    moved = state.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).filter("a <> b").distinct()
