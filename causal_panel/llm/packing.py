"""Best-fit packing by the linear grouping scheme.

Documents become pieces of at most ``capacity`` tokens. The packing is planned on
the histogram of piece lengths, which has at most ``capacity`` entries whatever
the corpus:

1. Large lengths are cut into groups of equal cardinality and rounded up to the
   longest of their group, which leaves a few sizes.
2. Configurations of these sizes are chosen one after the other: the largest
   size left, completed by the combination that fills a sequence best, used as
   often as the sizes last.
3. The actual lengths are put into the places of their group, which gives back
   what rounding took.
4. Small lengths, longest first, go where the least room that holds them is.

The plan says for every rank within a length in which sequence and where it
lies, as runs of consecutive ranks. Tasks look the pieces up in it.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causal_panel.llm.text import as_text
from causal_panel.session import staged


@dataclass(frozen=True)
class PackRule:
    """Tokens of a sequence, groups of large lengths, largest small length, id that ends a document."""

    capacity: int = 2048
    groups: int = 512
    small: int = 400
    end_id: int = 0


def segments(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments ``which`` of ``ids``, which has segments of these sizes, one after the other, and how long each is."""
    counts = sizes[which]
    ends, total = np.cumsum(counts), int(counts.sum())
    narrow = np.int32 if max(len(ids), total) < 1 << 31 else np.int64
    shifts = ((np.cumsum(sizes) - sizes)[which] - (ends - counts)).astype(narrow)
    return ids[np.repeat(shifts, counts) + np.arange(total, dtype=narrow)], counts


class WordTokenizer:
    """Token ids of texts by a tokenizer that never joins across ASCII white space, through a bounded cache of word cores.

    The distinct words of a batch of texts are encoded and put in their places
    as arrays. A word that is letters and then punctuation is two pre-tokens,
    each encoded by the model alone, so the cache holds cores and not every form
    of them. Anything else is encoded as it is. The cache has two generations:
    what is used moves to the younger one, and when that is full it becomes the
    older one, whose place it takes.
    """

    LIMIT = 250_000  # cores in a generation, but for those of one batch
    BATCH = 4_000_000  # bytes whose words are put together at a time
    CORES = 10_000  # new cores in one call of the model
    PUNCTUATION = ".,!?*#%&$|;:()\"-"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spelled = Tokenizer(self.model)  # the model alone, on spelled cores
        self.spelled.pre_tokenizer = WhitespaceSplit()
        # Tokens that end a word, by which the ids of many cores are told apart.
        suffix, vocabulary = self.model.end_of_word_suffix, self.spelled.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[k for token, k in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # How the model spells each letter below U+0130, upper case as lower case.
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spell(chr(c).lower())[0][0] for c in range(0x130) if chr(c).isalpha()}

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some texts after the other, and the number of ids of each; a null text has none."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            some = texts.slice(at, int(np.searchsorted(ends, before + self.BATCH)) + 1 - at)
            at += len(some)
            split = pc.ascii_split_whitespace(pc.fill_null(some, ""))
            places = split.flatten().dictionary_encode()
            ids, counts = segments(*self._encoded(places.dictionary), places.indices.to_numpy())
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])  # the first word of each text
            yield ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[bounds])

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every word, one after the other, and the number of ids of each."""
        if len(self.young) > self.LIMIT:
            self.old, self.young = self.young, {}
        trimmed = pc.utf8_rtrim(words, self.PUNCTUATION)
        cores = pc.ascii_lower(trimmed).dictionary_encode()
        names, core = cores.dictionary.to_numpy(zero_copy_only=False).tolist(), cores.indices.to_numpy()
        encoded = list(map(self.young.get, names))
        self._learn(names, encoded)

        # What is not a core alone: tails are encoded apart, other words whole.
        known = np.fromiter(map(bool, encoded), bool, len(encoded))[core]
        sizes = pc.binary_length(trimmed).to_numpy()
        rest = np.flatnonzero(~known | (pc.binary_length(words).to_numpy() > sizes))
        lengths = [len(name) for name in trimmed.take(pa.array(rest)).to_numpy(zero_copy_only=False)]
        texts = [word[n:] if k else word for word, n, k in zip(words.take(pa.array(rest)).to_numpy(zero_copy_only=False), lengths, known[rest].tolist())]
        index: dict[str, int] = {"": 0}
        tail = np.zeros(len(words), dtype=np.int64)
        tail[rest] = [index.setdefault(text, len(index)) for text in texts]
        encoded += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(list(index), add_special_tokens=False)]

        parts = np.column_stack([core, tail + len(names)]).ravel()
        ids, counts = segments(np.frombuffer(b"".join(encoded), "<u4"), np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4, parts)
        return ids, counts[::2] + counts[1::2]

    def _learn(self, cores: list[str], encoded: list[bytes | None]) -> None:
        """Fill in what is missing: the ids of cores that are letters, which go to the cache, and none for others."""
        new, spelled, young, old = [], [], self.young, self.old
        for k in [k for k, ids in enumerate(encoded) if ids is None]:
            core = cores[k]
            encoded[k] = ids = old.get(core, b"")
            if ids:
                young[core] = ids
            # Up to U+012F every letter is lowered alike by Python and by the tokenizer.
            elif core.isalpha() and (core.isascii() or max(core) < "\u0130"):
                new.append(k)
                spelled.append(core if core.isascii() else core.translate(self.spelling))
        for at in range(0, len(new), self.CORES):
            for k, ids in zip(new[at:at + self.CORES], self._modelled(spelled[at:at + self.CORES])):
                encoded[k] = young[cores[k]] = ids

    def _modelled(self, spelled: list[str]) -> list[bytes]:
        """What the model makes of spelled cores: all in one call, or one by one should their ids not tell them apart."""
        ids = np.array(self.spelled.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
        if len(ends) != len(spelled):
            return [array("I", [t.id for t in self.model.tokenize(core)]).tobytes() for core in spelled]
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


_tokenizers: dict[str, WordTokenizer] = {}  # one per worker process

PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, rule: PackRule = PackRule(), with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row of ``docs``.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone.
    Only documents longer than a sequence are cut. ``tokenizer_path`` must be
    readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
        for batch in batches:
            docs, seen = batch.column("doc_id"), 0
            for ids, counts in _tokenizers[tokenizer_path].encode(batch.column("text")):
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, np.uint32(rule.end_id))
                counts, begins = counts + 1, ends - counts + np.arange(len(counts))
                pieces = -(-counts // rule.capacity)
                doc = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * rule.capacity
                length = np.minimum(counts[doc] - start, rule.capacity)
                raw, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), 4 * (begins[doc] + start)
                columns = {
                    "doc_id": docs.take(pa.array(seen + doc)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)
                seen += len(counts)

    pieces = docs.select(as_text("doc_id"), "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))


@dataclass
class Run:
    """``count`` sequences from number ``first`` on, filled alike up to ``used``."""

    first: int
    count: int
    used: int


class Plan:
    """Where the pieces of a histogram of lengths go.

    ``placed`` has rows (length, first rank, first sequence, offset, pieces per
    sequence): rank r lies in sequence first + i // per at offset + i % per * length, with i = r - first rank.
    """

    def __init__(self, histogram: dict[int, int], rule: PackRule):
        self.rule, self.sequences, self.placed = rule, 0, []
        self.ranks: dict[int, int] = defaultdict(int)
        self.room: dict[int, list[Run]] = defaultdict(list)
        self.rooms: list[int] = []  # room left, ascending, of the runs in self.room
        self.large({n: c for n, c in histogram.items() if n > rule.small})
        for length in sorted((n for n in histogram if n <= rule.small), reverse=True):
            self.best_fit(length, histogram[length])

    def put(self, length: int, first: int, count: int, offset: int, per: int = 1) -> None:
        """``count`` pieces of a length, ``per`` in each sequence from ``first`` on."""
        self.placed.append((length, self.ranks[length], first, offset, per))
        self.ranks[length] += count

    def leave(self, run: Run) -> None:
        left = self.rule.capacity - run.used
        if run.count and left:
            if not self.room[left]:
                bisect.insort(self.rooms, left)
            self.room[left].append(run)

    def large(self, histogram: dict[int, int]) -> None:
        groups = self.grouped(histogram)
        need = {size: sum(c for _, c in items) for size, items in groups.items()}
        items = {size: list(reversed(group)) for size, group in groups.items()}  # longest last, to be taken from the end
        while need:
            pattern = self.configuration(need)
            uses = {s: pattern.count(s) for s in set(pattern)}
            times = min(need[s] // n for s, n in uses.items())
            self.substitute(pattern, times, items)
            for s, n in uses.items():
                need[s] -= n * times
                if not need[s]:
                    del need[s]

    def grouped(self, histogram: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
        """Rounded size -> (length, count) from the longest on; a length may be shared by two groups."""
        each = max(1, -(-sum(histogram.values()) // self.rule.groups))
        groups: dict[int, list[tuple[int, int]]] = {}
        size, free = 0, 0
        for length in sorted(histogram, reverse=True):
            left = histogram[length]
            while left:
                if not free:
                    size, free = length, each
                    if size in groups:  # one length fills several groups
                        free = left
                took = min(left, free)
                groups.setdefault(size, []).append((length, took))
                left, free = left - took, free - took
        return groups

    def configuration(self, need: dict[int, int]) -> list[int]:
        """The largest size needed and the sizes that fill the rest of its sequence best; few sizes win ties."""
        largest = max(need)
        rest = self.rule.capacity - largest
        taken: dict[int, list[int]] = {0: []}
        for size in sorted((s for s in need if s <= rest), reverse=True):
            most = need[size] - (size == largest)
            for total, sizes in sorted(taken.items()):
                for k in range(1, min(most, (rest - total) // size) + 1):
                    taken.setdefault(total + k * size, sizes + [size] * k)
            if rest in taken:
                break
        return [largest, *taken[max(taken)]]

    def substitute(self, pattern: list[int], times: int, items: dict[int, list[tuple[int, int]]]) -> None:
        """Put actual lengths into ``times`` sequences of a pattern, as runs of sequences that are filled alike."""
        while times:
            # The runs of lengths that stand next at each place of the pattern; equal sizes take from the same run.
            heads, count = {s: items[s][-1] for s in pattern}, times
            for size, (_, there) in heads.items():
                count = min(count, there // pattern.count(size) or 1)
            run, lone = Run(self.sequences, count, 0), any(heads[s][1] < pattern.count(s) for s in heads)
            run.count = 1 if lone else count
            for size in pattern:
                length, there = items[size].pop()
                self.put(length, run.first, run.count, run.used)
                run.used += length
                if there > run.count:
                    items[size].append((length, there - run.count))
            self.sequences += run.count
            times -= run.count
            self.leave(run)

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                fits = self.rule.capacity // length
                run = Run(self.sequences, -(-count // fits), 0)
                self.sequences += run.count
            else:
                left = self.rooms[at]
                fits, run = left // length, self.room[left].pop()
                if not self.room[left]:
                    self.rooms.pop(at)
            whole = min(run.count, count // fits)
            if whole:
                self.put(length, run.first, whole * fits, run.used, fits)
                self.leave(Run(run.first, whole, run.used + fits * length))
                count -= whole * fits
                run = Run(run.first + whole, run.count - whole, run.used)
            if run.count and count and count < fits:
                self.put(length, run.first, count, run.used, count)
                self.leave(Run(run.first, 1, run.used + count * length))
                count, run = 0, Run(run.first + 1, run.count - 1, run.used)
            self.leave(run)


PACKED = PIECES + ", sequence_id long, offset long"


def pack(pieces: DataFrame, rule: PackRule = PackRule()) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Pieces of one length are numbered within 2**k hash buckets and the buckets'
    counts are added up, so a length that a third of all pieces have is spread
    over tasks. Repeated rows are pieces of their own. Sequences are gapless
    from offset 0; empty input gives an empty table.
    """
    parts = 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts))), "pieces")
    counts = staged(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = sorted(Plan(histogram, rule).placed)
    lengths, ranks, firsts, offsets, pers = (np.array(column, dtype=np.int64) for column in (zip(*plan) if plan else ([],) * 5))
    keys = lengths << 44 | ranks

    before = F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    bases = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    ranked = dealt.withColumn("within", within).join(bases, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("within") - 1)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.searchsorted(keys, frame["length"].to_numpy() << 44 | frame["rank"].to_numpy(), side="right") - 1
            i = frame["rank"].to_numpy() - ranks[at]
            frame["sequence_id"] = firsts[at] + i // pers[at]
            frame["offset"] = offsets[at] + i % pers[at] * lengths[at]
            yield frame.drop(columns="rank")

    placed = ranked.select(as_text("doc_id"), "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, PACKED)
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, rule: PackRule = PackRule()) -> DataFrame:
    """Tokenize, cut and pack all documents: one row per piece."""
    return pack(token_pieces(docs, tokenizer_path, rule), rule)
