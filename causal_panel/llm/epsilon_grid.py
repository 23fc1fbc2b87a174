"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are turned onto the principal axes of all vectors and sorted by the
grid cells (of width epsilon) of their leading coordinates. The sorted sequence
is cut into blocks; blocks and intervals of blocks carry bounding boxes of the
coordinates. From the whole sequence down, pairs of intervals whose boxes lie
farther apart than epsilon are dropped and the others split; pairs of blocks
that are left go on splitting in tasks. Two vectors are compared by their
coordinates first, a lower bound of their distance, and linked by their cosine
in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causal_panel.llm.components import connected_components
from causal_panel.llm.text import spread
from causal_panel.session import staged


@dataclass(frozen=True)
class GridRule:
    """Least cosine of a link, coordinates on the grid, coordinates kept for lower bounds, vectors in a block, branches of an interval."""

    cosine: float = 0.95
    grid: int = 4
    kept: int = 16
    block: int = 4096
    leaf: int = 1024
    branches: int = 8

    @property
    def epsilon(self) -> float:
        """Distance of unit vectors at the least cosine, with room for rounding."""
        return math.sqrt(2 - 2 * self.cosine) + 1e-4


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the second moments of all unit vectors, largest first; moments are summed on the executors."""

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for frame in frames:
            unit = _units(frame["vector"], width)
            total += unit.T @ unit
        yield pd.DataFrame({"cell": np.arange(width * width), "value": total.ravel()})

    summed = vectors.select("vector").mapInPandas(moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    matrix = np.zeros(width * width)
    for row in summed.collect():  # width x width
        matrix[row.cell] = row.value
    values, axes = np.linalg.eigh(matrix.reshape(width, width))
    return axes[:, ::-1]


def _units(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of unit length; shorter vectors are filled with zeros, which keeps their length."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    largest = np.abs(out).max(axis=1, keepdims=True)
    out /= np.where(largest > 0, largest, 1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


BLOCKS = "part int, at int, size int, ids binary, weights binary, widths binary, vectors binary, points binary, low array<double>, high array<double>"


def _cut(width: int, dtype: str, rule: GridRule):
    """Sorted rows of a partition to blocks: ids, copies, original vectors and coordinates as matrices, and the box."""

    def block(rows: pd.DataFrame, at: int) -> pd.DataFrame:
        vectors = np.zeros((len(rows), width), dtype=dtype)
        for i, v in enumerate(rows["vector"]):
            vectors[i, : len(v)] = v
        points = np.stack(rows["point"].to_numpy())
        return pd.DataFrame([{
            "part": int(rows["part"].iloc[0]), "at": at, "size": len(rows), "ids": rows["vec_id"].to_numpy(np.int64).tobytes(),
            "weights": rows["weight"].to_numpy(np.int64).tobytes(), "widths": rows["width"].to_numpy(np.int32).tobytes(),
            "vectors": vectors.tobytes(), "points": points.astype(np.float32).tobytes(),
            "low": points.min(axis=0).tolist(), "high": points.max(axis=0).tolist(),
        }])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = None, 0
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            while len(held) >= rule.block:
                yield block(held.iloc[: rule.block], at)
                held, at = held.iloc[rule.block:].reset_index(drop=True), at + 1
        if held is not None and len(held):
            yield block(held, at)

    return run


def sequence_blocks(vectors: DataFrame, width: int, dtype: str, rule: GridRule) -> DataFrame:
    """Blocks of the epsilon grid order of (vec_id, weight, vector), numbered from 0 in that order."""
    kept = min(rule.kept, width)
    axes = principal_axes(vectors, width)[:, :kept]

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = _units(frame["vector"], width) @ axes
            cells = np.floor(points[:, : rule.grid] / rule.epsilon).astype(np.int32)
            yield frame.assign(width=frame["vector"].map(len), point=list(points), cells=list(cells))

    element = vectors.schema["vector"].dataType.elementType.simpleString()
    placed = vectors.select("vec_id", "weight", "vector").mapInPandas(
        project, f"vec_id long, weight long, vector array<{element}>, width int, point array<double>, cells array<int>")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["width", "cells", "point", "vec_id"]
    ordered = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    blocks = staged(ordered.mapInPandas(_cut(width, dtype, rule), BLOCKS), "grid-blocks")
    counts = {r.part: r.n for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a number per partition
    bases, total = [], 0
    for part in range(max(counts, default=0) + 1):
        bases.append(total)
        total += counts.get(part, 0)
    base = F.get(F.array(*(F.lit(b) for b in bases)), F.col("part"))
    return blocks.withColumn("block", (base + F.col("at")).cast("long"))


def _apart(low_a, high_a, low_b, high_b):
    """Squared least distance of two boxes, as a column."""
    gap = lambda la, ha, lb, hb: F.greatest(la - hb, lb - ha, F.lit(0.0))
    ends = F.arrays_zip(low_a.alias("la"), high_a.alias("ha"), low_b.alias("lb"), high_b.alias("hb"))
    return F.aggregate(ends, F.lit(0.0), lambda s, x: s + F.pow(gap(x["la"], x["ha"], x["lb"], x["hb"]), 2))


def near_blocks(blocks: DataFrame, kept: int, rule: GridRule) -> DataFrame:
    """(block_a, block_b), block_a <= block_b, whose boxes are within epsilon: intervals are joined level by level."""
    boxes = staged(blocks.select(F.col("block").alias("id"), "low", "high"), "grid-boxes")
    levels, top = [boxes], boxes.agg(F.max("id")).first()[0] or 0
    edge = lambda pick, column: F.array(*(pick(F.get(column, k)) for k in range(kept)))
    while top:
        parent = F.floor(F.col("id") / rule.branches).cast("long")
        levels.append(levels[-1].groupBy(parent.alias("id")).agg(edge(F.min, "low").alias("low"), edge(F.max, "high").alias("high")))
        top //= rule.branches
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(levels[:-1]):
        side = lambda name: level.select(
            F.floor(F.col("id") / rule.branches).cast("long").alias(name), F.col("id").alias(f"{name}_id"), F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))
        split = pairs.join(side("a"), "a").join(side("b"), "b").filter("a_id <= b_id")
        close = _apart(F.col("a_low"), F.col("a_high"), F.col("b_low"), F.col("b_high")) <= rule.epsilon**2
        pairs = staged(split.filter(close).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "grid-pairs")
    return pairs.select(F.col("a").alias("block_a"), F.col("b").alias("block_b"))


class Side:
    """A block in a task."""

    def __init__(self, row: dict, prefix: str, width: int, kept: int, dtype: str):
        get = lambda name, kind: np.frombuffer(row[f"{prefix}_{name}"], dtype=kind)
        self.ids, self.weights, self.widths = get("ids", np.int64), get("weights", np.int64), get("widths", np.int32)
        self.vectors, self.points = get("vectors", dtype).reshape(-1, width), get("points", np.float32).reshape(-1, kept)

    def cosines(self, at: np.ndarray, other: Side, there: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        for k in range(0, len(at), 65536):
            a, b = (_plain(s.vectors[i[k:k + 65536]]) for s, i in ((self, at), (other, there)))
            out[k:k + 65536] = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
        return out


def _plain(vectors: np.ndarray) -> np.ndarray:
    """Double precision, scaled so that squares neither overflow nor vanish; cosines do not change."""
    out = vectors.astype(np.float64)
    return out / np.abs(out).max(axis=1, keepdims=True)


def links_between(a: Side, b: Side, same: bool, rule: GridRule) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all links; of a block with itself each pair once."""
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    limit, todo = rule.epsilon**2, [(0, len(a.ids), 0, len(b.ids))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0 + 1:
            continue
        p, q = a.points[a0:a1], b.points[b0:b1]
        gap = np.maximum(np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)), 0)
        if float(gap @ gap) > limit:
            continue
        if max(a1 - a0, b1 - b0) > rule.leaf:
            a2, b2 = (a0 + a1) // 2, (b0 + b1) // 2
            todo += [(x0, x1, y0, y1) for x0, x1 in ((a0, a2), (a2, a1)) for y0, y1 in ((b0, b2), (b2, b1)) if x0 < x1 and y0 < y1]
            continue
        distance = np.einsum("ij,ij->i", p, p)[:, None] + np.einsum("ij,ij->i", q, q)[None] - 2 * (p @ q.T)
        i, j = np.nonzero(distance <= limit)
        i, j = i + a0, j + b0
        keep = a.widths[i] == b.widths[j]
        if same:
            keep &= i < j
        i, j = i[keep], j[keep]
        keep = a.cosines(i, b, j) >= rule.cosine
        found_a.append(i[keep])
        found_b.append(j[keep])
    return np.concatenate(found_a), np.concatenate(found_b)


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of links u-v that are not the smallest of their component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = ends[: len(u)], ends[len(u):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def similar_vectors(vectors: DataFrame, rule: GridRule = GridRule()) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of ``vectors`` (vec_id, embedding).

    Links join vectors of one length with a cosine of at least ``rule.cosine``.
    Null or zero vectors and those with null or non-finite components have
    none, and neither do vectors of another length. Equal vectors are joined
    once, with their number as weight, so a vector that many rows share costs no
    pairs. Every link is counted; what leaves a task are counts and one
    link per vector towards the smallest id of its group there.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(usable, F.col("embedding")).alias("vector"))
    groups = staged(rows.filter("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")), "vectors")
    width = groups.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    dtype = "float32" if isinstance(groups.schema["vector"].dataType.elementType, T.FloatType) else "float64"
    kept = min(rule.kept, width)
    blocks = sequence_blocks(groups, width, dtype, rule)
    data = ("ids", "weights", "widths", "vectors", "points")
    side = lambda s: blocks.select(F.col("block").alias(f"block_{s}"), *(F.col(c).alias(f"{s}_{c}") for c in data))
    pairs = near_blocks(blocks, kept, rule).join(side("a"), "block_a").join(side("b"), "block_b")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                same = row["block_a"] == row["block_b"]
                a, b = (Side(row, s, width, kept, dtype) for s in ("a", "b"))
                i, j = links_between(a, b, same, rule)
                node, root = local_roots(a.ids[i], b.ids[j])
                ids = np.concatenate([a.ids[i], b.ids[j]])
                linked, at = np.unique(ids, return_inverse=True)
                count = np.bincount(at, np.concatenate([b.weights[j], a.weights[i]]), len(linked)).astype(np.int64)
                roots = dict(zip(node.tolist(), root.tolist()))
                yield pd.DataFrame({"a": linked, "b": [roots.get(x, x) for x in linked.tolist()], "n": count})

    # Pairs hold two blocks: a batch of a few keeps a task's memory to some megabytes.
    spark = vectors.sparkSession
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = staged(spread(pairs).mapInPandas(compare, "a long, b long, n long"), "vector-links")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    counts = found.groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "rep")
    classes = connected_components(found.select("a", "b")).withColumnRenamed("node", "rep")
    groups = groups.withColumnRenamed("vec_id", "rep").join(counts, "rep", "left").join(classes, "rep", "left")
    linked = rows.join(groups, "vector", "left")
    n_links = F.coalesce(F.col("weight") - 1 + F.coalesce("others", F.lit(0)), F.lit(0))
    return linked.select("vec_id", n_links.alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
