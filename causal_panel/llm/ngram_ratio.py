"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and word pairs are hashed to ``buckets`` cells. Two multinomials over the
cells are counted, one over the trusted documents and one over every document;
a document's score is the mean log ratio of its cells. Counting and scoring are
built-in functions only. The ratios are whole millionths, so sums do not depend
on the order of addition and reruns agree to the last bit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causal_panel.llm.text import GAP, fresh, words

WINDOW = 5


@dataclass(frozen=True)
class RatioRule:
    """Parameters: hash cells, and the least mean log ratio (in millionths) a kept document has."""

    buckets: int = 16_384
    threshold: int = -250_000
    smoothing: int = 1


def word_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null or empty text has zero everywhere and fails. Columns of these names
    that ``docs`` already has are replaced. Windows of five words are compared
    by a 64-bit hash; the work per document is a sort of its windows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.regexp_replace(x, GAP, "") != "")
    duplicates = lambda found: F.size(found) - F.size(F.array_distinct(found))
    split = words(F.col(text))
    docs = docs.withColumns({
        "n_words": F.size(split).cast("long"),
        "word_chars": F.length(F.regexp_replace(body, GAP, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": _let(lines, duplicates).cast("long"),
        "n_repeat_words": _let(F.transform(split, lambda w: F.xxhash64(w)), _repeat_words).cast("long"),
    })
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return docs.withColumn("base_failed", failed)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, by binding it to a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur at least twice: sort the windows, keep equal neighbours, add up what they cover.

    Texts whose windows all differ, the most, are told by a hash set and need no sort.
    """
    key = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))

    def repeated(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(ordered, i)["key"] == x["key"], F.lit(False))
        found = F.filter(ordered, lambda x, i: same(x, i + 1) | same(x, i - 1))
        return F.sort_array(F.transform(found, lambda x: x["at"]))

    def covered(starts: Column) -> Column:
        step = lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - at, F.lit(WINDOW)))
        return F.aggregate(F.transform(starts, step), F.lit(0), lambda total, x: total + x)

    def count(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), _let(_let(ordered, repeated), covered)).otherwise(0)

    return F.when(F.size(hashes) > WINDOW, _let(F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), key), count)).otherwise(0)


def cells(text: Column, buckets: int) -> Column:
    """Hash cells of all words and all pairs of neighbouring words of a text."""
    hashes = F.transform(words(text), lambda w: F.crc32(w.cast("binary")))

    def both(h: Column) -> Column:
        pair = lambda a, i: (a * 31 + F.get(h, i + 1) * 17 + 7) % F.lit(buckets)
        return F.concat(F.transform(h, lambda a: a % F.lit(buckets)), F.filter(F.transform(h, pair), lambda c: c.isNotNull()))

    return _let(hashes, both)


def log_ratios(docs: DataFrame, trusted: Column, rule: RatioRule = RatioRule(), text: str = "text") -> list[int]:
    """ln(target / raw) of every cell in millionths, counted over all of ``docs``.

    ``trusted`` is true for documents of the target. The table has ``buckets``
    entries whatever the corpus, so it is collected as the model of the rule.
    """
    counted = (
        docs.select(F.coalesce(trusted, F.lit(False)).cast("long").alias("target"), F.explode(cells(F.col(text), rule.buckets)).alias("cell"))
        .groupBy("cell").agg(F.sum("target").alias("target"), F.count("*").alias("raw"))
    )
    cells_of = {r.cell: (r.target, r.raw) for r in counted.collect()}
    target, raw = (sum(c[k] for c in cells_of.values()) + rule.smoothing * rule.buckets for k in (0, 1))

    def ratio(t: int, r: int) -> int:
        return math.floor((math.log((t + rule.smoothing) / target) - math.log((r + rule.smoothing) / raw)) * 1e6 + 0.5)

    return [ratio(*cells_of.get(cell, (0, 0))) for cell in range(rule.buckets)]


def score(docs: DataFrame, ratios: list[int], text: str = "text") -> DataFrame:
    """Add n_grams and ratio_sum (millionths); a document without words has zero in both.

    Columns of these names that ``docs`` already has are replaced; all others stay.
    """
    model = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")  # folded to one constant
    add = lambda total, cell: total + F.get(model, cell.cast("int"))
    sums = lambda found: F.struct(F.size(found).cast("long").alias("n_grams"), F.aggregate(found, F.lit(0).cast("long"), add).alias("ratio_sum"))
    both = fresh(docs, "ratio")
    scored = docs.withColumn(both, _let(cells(F.col(text), len(ratios)), sums))
    return scored.withColumns({name: F.col(both)[name] for name in ("n_grams", "ratio_sum")}).drop(both)


def quality_rules(docs: DataFrame, trusted: Column, rule: RatioRule = RatioRule()) -> DataFrame:
    """Word statistics, ratio_sum, n_grams and the verdict ``kept`` of every document.

    A document is kept if it passes the base rules and its mean log ratio is at
    least the threshold: ratio_sum >= threshold * n_grams, in whole numbers.
    Without any trusted document all ratios favour nothing in particular, and
    the base rules decide nearly alone. Empty input gives an empty table; nulls
    in other columns and repeated rows are carried through. Columns that ``docs``
    already has under the names of results are replaced.
    """
    scored = score(word_statistics(docs), log_ratios(docs, trusted, rule))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("ratio_sum") >= rule.threshold * F.col("n_grams")))
