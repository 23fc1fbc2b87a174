"""Near-duplicate documents by a MinHash LSH forest.

Documents are sets of word shingles; equal sets are one node. Every tree of the
forest sorts the nodes by another stretch of their MinHash signature, in ranges
over the tasks. Each node is compared with its neighbours in that order: the
longest prefix it has in common with one of them says how deep the region is
that it shares. A node that shares fewer than ``shallow`` values with both is
alone in the tree. The others are candidates within regions as shallow as can
be: runs with ``shallow`` values in common are taken whole if they are small,
else they are cut at ``deep`` values, the depth at which the forest finds every
similar pair almost surely. Larger regions are compared in tiles, not cut
deeper, so density costs no links.

Candidates whose signatures agree enough are joined to clusters; only spanning
links leave a task. Then each cluster is compared on the full shingle sets, in
blocks, and the links that hold make the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causal_panel.llm.components import connected_components
from causal_panel.llm.epsilon_grid import local_roots
from causal_panel.llm.text import as_text, spread
from causal_panel.session import staged


@dataclass(frozen=True)
class ForestRule:
    """Shingle words; least similarity in percent; hashes; trees and their depths; nodes in a tile and in a block.

    With similarity 0.85, depth 4 and 24 trees a pair is in no common region with
    probability (1 - 0.85**4)**24 = 2e-8. Its signatures agree in fewer than
    ``screen`` of all hashes, 5 standard deviations below, with 1e-7.
    """

    words: int = 5
    percent: int = 85
    hashes: int = 128
    trees: int = 24
    shallow: int = 3
    deep: int = 4
    screen: float = 0.68
    tile: int = 1024
    block: int = 256


_rng = np.random.default_rng(20)
_letters = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_multipliers = _rng.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_gap = np.zeros(256, dtype=bool)
_gap[[9, 10, 11, 12, 13, 32]] = True
_base = int(_rng.integers(1, 2**62)) * 4 + 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(32)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lowered: differences of prefix sums of letter values times powers."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if len(data) > len(_powers[0]):
        for k, base in enumerate((_base, pow(_base, -1, 1 << 64))):
            steps = np.full(2 * len(data), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    edge = np.diff(np.concatenate([[True], _gap[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letters[data] * _powers[0][: len(data)], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; of a shorter text, of all its words; none without words."""
    hashes = word_hashes(text or "")
    width = min(words, len(hashes))
    if not width:
        return hashes
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k: k + len(out)]
    return np.unique(_mix(out + np.uint64(width)))


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash values of a set, 16 bits of each."""
    least = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    multipliers = _multipliers[:hashes, None]
    for at in range(0, len(shingles), 512):
        np.minimum(least, (multipliers * shingles[None, at: at + 512]).min(axis=1), out=least)
    return (_mix(least) >> np.uint64(48)).astype(np.uint16)


def _sign(rule: ForestRule):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                found = shingle_set(text, rule.words)
                digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                rows.append((len(found), digest, signature(found, rule.hashes).tobytes() if len(found) else None))
            out = pd.DataFrame(rows, columns=["n_shingles", "digest", "signature"], index=frame.index)
            yield pd.concat([frame[["doc_id"]], out], axis=1)

    return run


def _runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames with all rows of a key, from sorted rows; memory is one key and a batch."""
    held = []
    for frame in frames:
        values = frame[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(frame)]
        for a, b in zip(cuts, cuts[1:]):
            part = frame.iloc[a:b]
            if held and (held[-1][keys].iloc[-1].to_numpy() != part[keys].iloc[0].to_numpy()).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _agreeing(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, rule: ForestRule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature matrices that may be similar: enough equal hashes, and sizes that allow it."""
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(a), 64):
        part, sizes = a[at: at + 64], size_a[at: at + 64, None]
        i, j = np.nonzero(100 * np.minimum(sizes, size_b[None]) >= rule.percent * np.maximum(sizes, size_b[None]))
        for k in range(0, len(i), 1 << 15):
            x, y = i[k: k + (1 << 15)], j[k: k + (1 << 15)]
            keep = (part[x] == b[y]).sum(axis=1) >= rule.screen * rule.hashes
            found_a.append(x[keep] + at)
            found_b.append(y[keep])
    return np.concatenate(found_a), np.concatenate(found_b)


GROUP = ["tree", "region", "low", "high"]


def _compared(rule: ForestRule):
    """Rows sorted by GROUP to the spanning links of each group: pairs of its tile ``low`` with its tile ``high``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for frame in _runs(frames, GROUP):
            ids, sizes = (frame[c].to_numpy(np.int64) for c in ("rep", "n_shingles"))
            signs = np.frombuffer(b"".join(frame["signature"]), np.uint16).reshape(len(frame), rule.hashes)
            x, y = (np.flatnonzero(frame["tile"].to_numpy() == frame[c].iloc[0]) for c in ("low", "high"))
            i, j = _agreeing(signs[x], signs[y], sizes[x], sizes[y], rule)
            node, root = local_roots(ids[x[i]], ids[y[j]])
            out.append(pd.DataFrame({"a": node, "b": root}))
            if len(out) > 500:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    return run


def _common(keys: np.ndarray) -> np.ndarray:
    """How many leading values each row of a matrix of values has in common with the row after it."""
    return np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1)


def _neighbours(rule: ForestRule):
    """Sorted (tree, key, rep) to (tree, rep, shared, key): the longest prefix in common with a neighbour, where it is long enough.

    What lies beyond the ends of a range is not known there; its first and last
    row count as sharing all, and prove alone when regions are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose next neighbour comes with the next batch
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if held is None:
                if batch is None:
                    return
                rows, before = pa.Table.from_batches([batch]), rule.deep
            else:
                rows, before = pa.Table.from_batches([held, batch] if batch is not None else [held]), held_before
            values = np.frombuffer(b"".join(rows["key"].to_pylist()), np.uint16).reshape(rows.num_rows, rule.deep)
            trees = rows["tree"].to_numpy()
            common = np.where(trees[1:] == trees[:-1], _common(values), 0)
            last = rows.num_rows if batch is None else rows.num_rows - 1
            shared = np.maximum(np.concatenate([[before], common]), np.concatenate([common, [rule.deep]]))[:last]
            keep = np.flatnonzero(shared >= rule.shallow)
            yield from rows.select(["tree", "rep", "key"]).take(pa.array(keep)).combine_chunks().to_batches()
            if batch is not None:
                held_before = int(common[-1]) if len(common) else before
                held = rows.slice(rows.num_rows - 1).combine_chunks().to_batches()[0]

    return run


def forest_leaves(nodes: DataFrame, rule: ForestRule) -> DataFrame:
    """(tree, rep, key): in every tree the nodes that share ``shallow`` values or more with a neighbour in the order of their keys."""
    if rule.trees * rule.deep > rule.hashes:
        raise ValueError("trees times depth must not exceed the hashes of a signature")
    key = lambda t: F.substring("signature", 2 * rule.deep * t + 1, 2 * rule.deep)
    trees = F.array(*(F.struct(F.lit(t).alias("tree"), key(t).alias("key")) for t in range(rule.trees)))
    orders = nodes.select("rep", F.explode(trees).alias("leaf")).select("leaf.tree", "rep", "leaf.key")
    order = ("tree", "key", "rep")
    return orders.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(rule), "tree int, rep long, key binary")


def dealt_leaves(nodes: DataFrame, rule: ForestRule) -> DataFrame:
    """(rep, tree, region, tile, low, high): the regions of all trees, those of more than ``tile`` nodes in pairs of tiles.

    The tile of a node is a hash of it, so no region is ever in one place; two
    nodes of a region meet in the group (low, high) of their tiles. Only ids are
    dealt here, signatures are joined to them afterwards.
    """
    leaves = staged(forest_leaves(nodes, rule), "forest-neighbours")
    label = lambda depth: F.xxhash64("tree", F.substring("key", 1, 2 * depth))
    leaves = leaves.select("rep", "tree", label(rule.shallow).alias("shallow"), label(rule.deep).alias("deep"))
    shared = leaves.groupBy("tree", "shallow").agg(F.count("*").alias("n")).filter("n > 1")
    region = F.when(F.col("n") > rule.tile, F.col("deep")).otherwise(F.col("shallow"))  # the depth of each region
    leaves = leaves.join(shared, ["tree", "shallow"]).select("rep", "tree", region.alias("region"))
    leaves = staged(leaves, "forest-leaves")  # nodes that are alone in their region are gone
    tiles = leaves.groupBy("tree", "region").agg(F.count("*").alias("n")).filter("n > 1").select("tree", "region", F.ceil(F.col("n") / rule.tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    tiled = leaves.join(tiles, ["tree", "region"]).withColumn("tile", own)
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("tile")).alias("low"), F.greatest(k, F.col("tile")).alias("high")))
    return tiled.select("rep", "tree", "region", "tile", F.explode(pair).alias("pair")).select("rep", "tree", "region", "tile", "pair.*")


def candidate_clusters(nodes: DataFrame, rule: ForestRule) -> DataFrame:
    """(node, component): clusters that hold every pair of similar nodes, from (rep, n_shingles, signature)."""
    rows = spread(dealt_leaves(nodes, rule).join(nodes, "rep"), *GROUP).sortWithinPartitions(*GROUP)
    return connected_components(rows.mapInPandas(_compared(rule), "a long, b long"))


def similar_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with enough in common: shingles of two sets or more make the columns of 0/1 matrices, which are multiplied."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shingles, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    owner, column = owner[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        matrix = np.zeros((len(sets), 4096), np.float32)
        matrix[owner[a:b], column[a:b] - first] = 1
        both += matrix @ matrix.T
    common = np.rint(both).astype(np.int64)
    i, j = np.nonzero(100 * common >= percent * (sizes[:, None] + sizes[None] - common))
    return i[i < j], j[i < j]


def confirmed_links(docs: DataFrame, clusters: DataFrame, rule: ForestRule) -> DataFrame:
    """Spanning links (a, b) of the similar pairs inside each cluster, on full shingle sets made anew from the texts.

    A cluster of more than ``block`` nodes is cut into blocks by a hash of the
    node, and every two blocks are compared by a task.
    """
    roots = clusters.select(F.col("component").alias("rep"), "component").distinct()
    members = staged(clusters.select(F.col("node").alias("rep"), "component").unionByName(roots), "clusters")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / rule.block).cast("int").alias("blocks"))
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(members, "rep")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, own).alias("low"), F.greatest(k, own).alias("high")))
    dealt = texts.join(sizes, "component").select("rep", "text", "component", F.explode(pair).alias("pair")).select("rep", "text", "component", "pair.*")
    keys = ["component", "low", "high"]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = [], 0
        for rows in _runs(frames, keys):
            ids = rows["rep"].to_numpy(np.int64)
            i, j = similar_pairs([shingle_set(t, rule.words) for t in rows["text"]], rule.percent)
            node, root = local_roots(ids[i], ids[j])
            if len(node):
                out.append(pd.DataFrame({"a": node, "b": root}))
                n += len(node)
            if n > 10_000:
                yield pd.concat(out)
                out, n = [], 0
        if out:
            yield pd.concat(out)

    return spread(dealt, *keys).sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, rule: ForestRule = ForestRule()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Documents are linked if 100 times the shingles in common is at least
    ``rule.percent`` times those of both. A text without words is linked with
    nothing. Rows of one id are one document; a null id stays alone with a null
    component. Empty input gives an empty table; other columns are ignored.
    """
    signed = staged(docs.select(as_text("doc_id"), "text").mapInPandas(_sign(rule), "doc_id string, n_shingles long, digest binary, signature binary").withColumn("doc_id", F.col("doc_id").cast("long")), "signatures")
    known = signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    nodes = staged(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "nodes")
    clusters = candidate_clusters(nodes.select("rep", "n_shingles", "signature"), rule)
    classes = connected_components(confirmed_links(docs, clusters, rule)).select(F.col("node").alias("rep"), "component")
    named = nodes.select("digest", "rep").join(classes, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    return signed.join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
