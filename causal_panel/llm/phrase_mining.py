"""Collocations by sampling first: frequent phrases of 2 to 4 words, exactly counted, and what binds their words.

A sample proposes phrases, mined level by level with a lowered threshold. A pass
over all documents then counts every proposed phrase and the negative border:
phrases that are not proposed although what is left without their first and
without their last word is (every word is, for the empty phrase is). If the
border holds no frequent phrase, no longer one can be frequent either, and the
frequent phrases are known. Otherwise those found are proposed too, and another
pass counts what has come inside the border by them, until a pass adds nothing.
The sample decides how many passes there are, never what is found.

These passes count 64-bit hashes of language and words, which is what there are
many of; two phrases of one hash can only make both look frequent. A last pass
counts the phrases that look frequent by their words, exactly. Which hashes are
proposed, or look frequent, is kept as a bitmap of fixed size, so the phrases of
the corpus need not fit one machine; hashes that share a bit are counted for
nothing, which costs work but changes no result. The border is never listed;
only phrases that occur are met and counted.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causal_panel.session import staged


@dataclass(frozen=True)
class PhraseRule:
    """Occurrences a phrase needs, its longest length in words (7 at most), share of documents in the sample (one of so
    many), occurrences needed there, size of the bitmaps (two to the power of), share of a phrase's occurrences inside a
    longer one that drops it (percent), phrases reported per language."""

    support: int = 30
    longest: int = 4
    sample: int = 8
    sample_support: int = 3
    bits: int = 27
    inside_percent: int = 80
    top: int = 2000


CHUNK = 4_000_000  # bytes of text counted at a time
BLOCK_BITS = 16  # of a bitmap, collected as one value
LENGTH_BITS = 3  # the last bits of a phrase's hash are its length
COUNTS = "lang string, phrase string, n long"
_SPACE, _STOP = 32, 46
#: A to Z in lower case, tabs as spaces, what ends a piece as a full stop.
_FIXED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 10)
_chance = np.random.default_rng(12)
_letters, _places = (_chance.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of texts of one language: where they are, which piece each is in, and their hashes."""

    def __init__(self, lang: str, texts: list[bytes]):
        self.data = b".".join(texts).translate(_FIXED)
        raw = np.frombuffer(self.data, np.uint8)
        solid = (raw != _SPACE) & (raw != _STOP)
        edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        self.starts, self.sizes = edges[::2], edges[1::2] - edges[::2]
        self.pieces = np.cumsum(raw == _STOP, dtype=np.int32)[self.starts]
        self.letters, self.offsets = raw[solid], np.cumsum(self.sizes) - self.sizes
        salt = np.frombuffer(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "<u8")
        if len(self.starts):
            self.place = np.arange(len(self.letters)) - np.repeat(self.offsets, self.sizes)
            sums = np.add.reduceat(_letters[self.letters] * _places[self.place & 255], self.offsets)
            self.hashes = _mix(sums + self.sizes.astype(np.uint64) * _places[0] + salt)
        else:
            self.hashes = np.zeros(0, np.uint64)

    def phrases(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per length: hashes of the phrases that begin at each word, and whether they lie in one piece."""
        hashes = self.hashes
        for length in range(1, longest + 1):
            if length > 1:
                hashes = _mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[length - 1:])
            whole = self.pieces[length - 1:] == self.pieces[:len(self.pieces) - length + 1]
            yield (hashes & ~np.uint64((1 << LENGTH_BITS) - 1)) | np.uint64(length), whole

    def ids(self) -> tuple[np.ndarray, list[bytes]]:
        """Which of the distinct words stands at each place. Words of one hash are compared byte by byte."""
        _, first, which = np.unique(self.hashes, return_index=True, return_inverse=True)
        alike = first[which]
        if (self.sizes == self.sizes[alike]).all() and (self.letters == self.letters[np.repeat(self.offsets[alike], self.sizes) + self.place]).all():
            return which, [self.data[s:s + n] for s, n in zip(self.starts[first].tolist(), self.sizes[first].tolist())]
        index: dict[bytes, int] = {}  # next to impossible: two words of one hash
        words = [self.data[s:s + n] for s, n in zip(self.starts.tolist(), self.sizes.tolist())]
        return np.array([index.setdefault(w, len(index)) for w in words]), list(index)


class Proposed:
    """A set of phrase hashes as a bitmap. Its size is a parameter, whatever the corpus."""

    def __init__(self, bits: int, bitmap: np.ndarray | None = None):
        self.bits = bits
        self.bitmap = np.zeros(1 << (bits - 3), np.uint8) if bitmap is None else bitmap

    def __getstate__(self) -> tuple[int, bytes]:
        return self.bits, zlib.compress(self.bitmap.tobytes(), 1)  # what is sent grows with the phrases, up to the bitmap's size

    def __setstate__(self, state: tuple[int, bytes]) -> None:
        self.bits, self.bitmap = state[0], np.frombuffer(zlib.decompress(state[1]), np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = places(hashes, self.bits)
        return (self.bitmap[at >> 3] >> (at & 7) & 1).astype(bool)

    def with_hashes(self, found: DataFrame) -> Proposed:
        """This set and the hashes ``h`` of a table; blocks of the bitmap are filled in tasks."""
        bits, size = self.bits, 1 << (BLOCK_BITS - 3)

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                at = places(frame["h"].to_numpy().view(np.uint64), bits)
                yield pd.DataFrame({"block": at >> BLOCK_BITS, "at": at & ((1 << BLOCK_BITS) - 1)})

        def fill(frame: pd.DataFrame) -> pd.DataFrame:
            block, at = np.zeros(size, np.uint8), frame["at"].to_numpy()
            np.bitwise_or.at(block, at >> 3, (1 << (at & 7)).astype(np.uint8))
            return pd.DataFrame({"block": frame["block"].iloc[:1], "bits": [block.tobytes()]})

        blocks = found.select("h").mapInPandas(place, "block long, at long").distinct().groupBy("block").applyInPandas(fill, "block long, bits binary")
        bitmap = self.bitmap.copy()
        for row in blocks.collect():  # 2 ** (bits - 3) bytes at most
            bitmap[row.block * size:(row.block + 1) * size] |= np.frombuffer(row.bits, np.uint8)
        return Proposed(bits, bitmap)


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def phrase_hash(lang: str, phrase: str) -> np.ndarray:
    """The hash of one phrase, as an array."""
    words = Words(lang, [phrase.encode("utf-8", "surrogatepass")])
    *_, (hashes, _) = words.phrases(len(words.starts))
    return hashes


def _chunks(batches: Iterator[pa.RecordBatch], function: Callable[[str, Words], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Apply a function to the words of about CHUNK bytes of texts at a time, language by language."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            held[lang].append(text.as_py())
            size += len(held[lang][-1])
            if size > CHUNK:
                for name in list(held):
                    yield from function(name, Words(name, held.pop(name)))
                size = 0
    for name in list(held):
        yield from function(name, Words(name, held.pop(name)))


def count_hashes(docs: DataFrame, old: Broadcast | None, new: Broadcast, longest: int) -> DataFrame:
    """(h, n): how often the phrases occur that the set ``new`` puts into itself or its border and ``old`` did not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, proposed = old.value if old else None, new.value

        def inside(held: Proposed, hashes: np.ndarray, where: np.ndarray) -> np.ndarray:
            out, at = np.zeros(len(hashes), bool), np.flatnonzero(where)
            out[at] = held.holds(hashes[at])
            return out

        def count(lang: str, words: Words) -> Iterator[pa.RecordBatch]:
            gate = old_gate = np.ones(len(words.starts), bool)
            for length, (hashes, whole) in enumerate(words.phrases(longest), 1):
                if length > 1:
                    gate = held[:-1] & held[1:] & whole
                    old_gate = was_held[:-1] & was_held[1:] & whole if before else None
                fresh = gate if before is None else gate & ~old_gate
                h, n = np.unique(hashes[fresh], return_counts=True)
                if len(h):
                    yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])
                if length == longest or not gate.any():
                    return
                held = inside(proposed, hashes, gate)
                if before:
                    was_held = inside(before, hashes, old_gate)

        yield from _chunks(batches, count)

    return docs.select("lang", "text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def count_phrases(docs: DataFrame, looked: Broadcast, longest: int) -> DataFrame:
    """(lang, phrase, n): exact counts of the phrases with a hash in the set ``looked``, and of the empty phrase, which stands for all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(lang: str, phrases: list[bytes], n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(phrases), 100_000):
                some = pa.array(phrases[k:k + 100_000], pa.binary()).cast(pa.string())
                yield pa.record_batch([pa.array([lang] * len(some), pa.string()), some, pa.array(n[k:k + 100_000], pa.int64())], ["lang", "phrase", "n"])

        def count(lang: str, words: Words) -> Iterator[pa.RecordBatch]:
            yield from record(lang, [b""], np.array([len(words.starts)]))
            if not len(words.starts):
                return
            ids, names = words.ids()
            for length, (hashes, whole) in enumerate(words.phrases(longest), 1):
                at = np.flatnonzero(whole)
                at = at[looked.value.holds(hashes[at])]
                keys = ids[at]
                for k in range(1, length):  # equal words, not equal hashes, make phrases one
                    _, keys = np.unique(keys, return_inverse=True)
                    keys = keys << 32 | ids[at + k]
                _, first, n = np.unique(keys, return_index=True, return_counts=True)
                columns = [ids[at[first] + k].tolist() for k in range(length)]
                yield from record(lang, [b" ".join([names[i] for i in phrase]) for phrase in zip(*columns)], n)

        yield from _chunks(batches, count)

    return docs.select("lang", "text").mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def close(docs: DataFrame, support: int, proposed: Proposed, longest: int, gate: int) -> tuple[Proposed, Proposed]:
    """The set that closes over the frequent phrases of up to ``longest`` words, and the set of those that look frequent.

    Passes go on until none finds a frequent phrase of fewer than ``longest``
    words that is not proposed; phrases of fewer than ``gate`` words are.
    """
    share = docs.sparkSession.sparkContext.broadcast  # bitmaps, once each
    frequent, old, new = Proposed(proposed.bits), None, share(proposed)
    while True:
        # Hashes that look frequent only; their number grows with the corpus, and stays in a table.
        counts = staged(count_hashes(docs, old, new, longest).where(F.col("n") >= support), "phrase-hashes")
        frequent = frequent.with_hashes(counts)
        length = F.col("h").bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))
        news = staged(_not_held(counts.where(length < gate), new), "proposed")
        proposed = proposed.with_hashes(news)
        if old is not None:
            old.destroy()  # no later table reads it: counts and news are written
        if news.where(length < longest).isEmpty():
            new.destroy()
            return proposed, frequent
        old, new = new, share(proposed)


def _not_held(found: DataFrame, shared: Broadcast) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[~shared.value.holds(frame["h"].to_numpy().view(np.uint64))]

    return found.select("h").mapInPandas(run, "h long")


def frequent_phrases(docs: DataFrame, rule: PhraseRule = PhraseRule()) -> DataFrame:
    """(lang, phrase, n) of every phrase of up to ``longest`` words that occurs ``support`` times in a language, and of the empty phrase: all words.

    A null language is ``und``, a null text empty. Repeated rows count as often
    as they stand there; an empty table has no phrases. Other columns are ignored.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    drawn = F.pmod(F.xxhash64(*[F.col(c) for c in ("doc_id", "text") if c in docs.columns]), F.lit(rule.sample)) == 0
    sample = docs.where(drawn).select(*[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("lang", "und"), ("text", ""))])
    proposed, _ = close(sample, rule.sample_support, Proposed(rule.bits), rule.longest - 1, rule.longest)
    _, frequent = close(texts, rule.support, proposed, rule.longest, rule.longest)
    counts = count_phrases(texts, docs.sparkSession.sparkContext.broadcast(frequent), rule.longest)
    return staged(counts.where((F.col("n") >= rule.support) | (F.col("phrase") == "")), "phrases")


def collocations(frequent: DataFrame, rule: PhraseRule = PhraseRule()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of two words or more whose parts occur together most, per language.

    A phrase is cut after each of its words; its lowest score counts, of equal
    ones that of the earliest cut. Phrases that mostly occur inside one longer
    phrase are left out.
    """
    words = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    sizes = frequent.where("phrase = ''").select("lang", F.col("n").alias("all_words"))
    sizes = sizes.groupBy("lang").agg(F.sum("all_words").alias("n"))
    named = frequent.where("phrase <> ''").withColumn("words", words)
    candidates = named.where(F.size("words") > 1).withColumnRenamed("n", "a")

    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    lefts = frequent.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rights = frequent.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cuts.join(lefts, ["lang", "first"]).join(rights, ["lang", "rest"])
    # Exact whatever the counts: decimals of 28 digits.
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    lowest = scored.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    subs = F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("words") - 1),
        lambda size: F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda at: F.array_join(F.slice("words", at, size), " ")),
    ))
    inside = candidates.where(F.size("words") > 2).select("lang", F.explode(F.array_distinct(subs)).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = F.col("longer").cast("decimal(20, 0)") * 100 >= F.col("a").cast("decimal(20, 0)") * rule.inside_percent
    left = lowest.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(held, F.lit(False)))

    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", place).where(F.col("rank") <= rule.top).join(sizes, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
