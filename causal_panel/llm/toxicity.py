"""Toxicity by weak supervision.

Many cheap voters look at a text: a seed lexicon of insults, lexicons of words and
of word beginnings mined from labelled rows, and patterns. A generative label
model learns from the votes of all documents how often each voter fires on
toxic and on clean texts, and how far voters repeat each other beyond that; its
posteriors, not the labels, train a linear classifier that scores every text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causal_panel.llm.lsh_forest import shingle_set
from causal_panel.session import staged

#: Insults that any corpus may have; everything else is mined.
SEEDS = frozenset(
    "bastard clown creep disgusting dumb filth fool freak garbage hateful idiot idiotic imbecile jerk loser moron moronic pathetic pig "
    "scum scumbag stupid trash ugly vermin worthless".split()
)
WORD_LEXICONS = 4
STEMS = (4, 5, 6, 7)
SEVERAL = (2, 4)  # different marked words
PATTERNS = ("shouting", "exclamations", "masked", "addressed")
VOTERS = ("seeds", *(f"words{k}" for k in range(WORD_LEXICONS)), *(f"stems{n}" for n in STEMS), *(f"several{n}" for n in SEVERAL), *PATTERNS)

_word = re.compile(r"[^\W\d_]+")
_capitals = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
_masked = re.compile(r"\b\w+\*+\w+\b")
_addressed = re.compile(rf"\byou(?:r|'re| are)?\b(?:\W+\w+){{0,3}}?\W+(?:{'|'.join(sorted(SEEDS))})\b")


@dataclass(frozen=True)
class ToxicityRule:
    """Labelled rows to learn from at most, documents a marker is in at least, least log odds, markers of a kind at most, and the cut of the score."""

    labelled: int = 12_000
    support: int = 4
    log_odds: float = 2.5
    markers: int = 300
    cut: float = 0.7


@dataclass
class Markers:
    """Mined words and word beginnings; ``places`` numbers them and the voters for the classifier."""

    words: dict[str, int] = field(default_factory=dict)  # -> lexicon
    stems: dict[str, int] = field(default_factory=dict)  # -> length

    def __post_init__(self) -> None:
        names = [("word", w) for w in sorted(self.words)] + [("stem", s) for s in sorted(self.stems)] + [("voter", v) for v in VOTERS]
        self.places = {name: k for k, name in enumerate(names)}

    def look(self, text: str) -> tuple[int, list[int]]:
        """Votes of a text as bits, and the features that it has."""
        low = text.lower()
        found = set(_word.findall(low))
        votes, features, marked = set(), [], 0
        if found & SEEDS:
            votes.add("seeds")
        for word in found:
            before = len(features)
            if word in self.words:
                votes.add(f"words{self.words[word]}")
                features.append(self.places["word", word])
            if len(word) >= STEMS[0]:
                for n in STEMS:
                    stem = word[:n]
                    if stem in self.stems and len(stem) == n:
                        votes.add(f"stems{n}")
                        features.append(self.places["stem", stem])
            marked += len(features) > before
        votes.update(f"several{n}" for n in SEVERAL if marked >= n)
        capitals = len(_capitals.findall(text)) if low != text else 0
        if capitals >= 5 and 2 * capitals > len(_word.findall(text)):
            votes.add("shouting")
        if text.count("!!") >= 3:
            votes.add("exclamations")
        if "*" in text and _masked.search(text):
            votes.add("masked")
        if "seeds" in votes and "you" in found and _addressed.search(low):
            votes.add("addressed")
        features += [self.places["voter", v] for v in votes]
        return sum(1 << k for k, v in enumerate(VOTERS) if v in votes), sorted(set(features))


def learning_rows(docs: DataFrame, labels: DataFrame, rule: ToxicityRule) -> DataFrame:
    """(text, toxic) of at most ``rule.labelled`` labelled documents outside the held-out third, chosen by a hash of the id.

    Of several rows of one id the least text teaches, so there are never more rows than ids.
    """
    open_ids = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    chosen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & open_ids).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rule.labelled)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = staged(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-rows")

    # Copies would make chance words look like markers: of rows that share the least or the largest shingle hash the first id stays.
    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ends = [tuple(s[[0, -1]].view("int64").tolist()) if len(s := shingle_set(t, 3)) else (0, 0) for t in frame["text"]]
            yield frame[["doc_id", "toxic"]].assign(one=[x for x, _ in ends], two=[x for _, x in ends])

    ids = rows.mapInPandas(sketch, "doc_id long, toxic int, one long, two long")
    for key in ("one", "two"):
        ids = ids.groupBy(key, "toxic").agg(F.min_by(F.struct("doc_id", "one", "two"), "doc_id").alias("row")).select("toxic", "row.*")
    return rows.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").select("text", "toxic")


def mine_markers(rows: DataFrame, rule: ToxicityRule) -> Markers:
    """Words and word beginnings that toxic labelled documents have far more often than clean ones; the top of each kind."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {0: Counter(), 1: Counter()}
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"]):
                words = set(_word.findall(text.lower()))
                names = {(0, w) for w in words} | {(n, w[:n]) for n in STEMS for w in words if len(w) >= n}
                seen[int(toxic > 0)].update(names)
        for toxic, counter in seen.items():
            if counter:
                yield pd.DataFrame([(n, name, toxic * c, (1 - toxic) * c) for (n, name), c in counter.items()], columns=["size", "name", "toxic", "clean"])

    totals = {r.toxic: r.n for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    all_toxic, all_clean = totals.get(True, 0), totals.get(False, 0)
    counted = rows.mapInPandas(count, "size int, name string, toxic long, clean long").groupBy("size", "name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (all_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (all_clean + 1.0))
    counted = staged(counted.filter(F.col("toxic") >= rule.support), "toxicity-names")
    mined = counted.withColumn("odds", odds).filter(F.col("odds") >= rule.log_odds)
    # Among names that say the same, long ones are the least likely to be chance.
    order = (F.col("odds").desc(), F.col("toxic").desc(), F.length("name").desc(), "name")
    top = [r for size in (0, *STEMS) for r in mined.filter(F.col("size") == size).orderBy(*order).limit(rule.markers).collect()]
    words = {r.name: zlib.crc32(r.name.encode()) % WORD_LEXICONS for r in top if r["size"] == 0}
    return Markers(words, {r.name: r["size"] for r in top if r["size"] > 0})


#: How often a label says toxic of toxic and of clean texts before any is seen, and how many rows that counts for.
LABEL_PRIOR, LABELLED = (0.97, 0.02), 100


class LabelModel:
    """Latent class model of votes: firing rates of every voter on toxic and clean texts, and weights that discount repeated evidence."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 40):
        votes = (patterns[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)
        self.prior = 0.1
        self.rates = np.array([[0.3], [0.01]]) * np.ones((2, len(VOTERS)))
        self.rates[:, -len(PATTERNS):] = 0.05  # patterns: nothing is assumed
        self.weights = np.ones(len(VOTERS))
        self.correlations = np.eye(len(VOTERS))
        for step in range(rounds):
            toxic = self._posterior(votes)
            for k, share in enumerate((toxic, 1 - toxic)):
                mass = counts * share
                self.rates[k] = (mass @ votes + 0.5 * self.rates[k] + 1e-3) / (mass.sum() + 0.5 + 2e-3)
            self.prior = float(np.clip((counts @ toxic + 0.1) / (counts.sum() + 1), 1e-4, 0.5))
            if step % 10 == 9:
                self._correlate(votes, counts, toxic)

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        fired, quiet = np.log(self.rates[0] / self.rates[1]), np.log((1 - self.rates[0]) / (1 - self.rates[1]))
        evidence = (votes * fired + (1 - votes) * quiet) @ self.weights
        return 1 / (1 + np.exp(-np.clip(evidence + np.log(self.prior / (1 - self.prior)), -40, 40)))

    def _correlate(self, votes: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> None:
        """Correlations of the voters within the classes; a voter weighs as much as it says alone."""
        within = np.zeros((len(VOTERS), len(VOTERS)))
        for rate, share in zip(self.rates, (toxic, 1 - toxic)):
            left = votes - rate
            within += (left * (counts * share)[:, None]).T @ left
        scale = np.sqrt(np.maximum(np.diag(within), 1e-9))
        self.correlations = within / scale / scale[:, None]
        np.fill_diagonal(self.correlations, 1)
        self.weights = 1 / (self.correlations**2).sum(axis=1)

    def posterior(self, patterns: np.ndarray, labels: np.ndarray, rounds: int = 20) -> np.ndarray:
        """Posteriors of learning rows, whose label is one more voter.

        How often a label says toxic of toxic and of clean rows is estimated by
        the same rounds of expectation and maximisation, the other voters' rates
        held; ``LABELLED`` rows that it is right for, all but a few, come before the data.
        """
        voted = self._posterior((patterns[:, None] >> np.arange(len(VOTERS)) & 1).astype(float))
        said, toxic = labels > 0, voted
        self.label_rates = LABEL_PRIOR
        for _ in range(rounds):
            odds = [np.where(said, rate, 1 - rate) for rate in self.label_rates]
            toxic = voted * odds[0] / np.maximum(voted * odds[0] + (1 - voted) * odds[1], 1e-300)
            self.label_rates = tuple(
                float((share[said].sum() + LABELLED * prior) / (share.sum() + LABELLED)) for share, prior in zip((toxic, 1 - toxic), LABEL_PRIOR))
        return toxic


def fit_linear(features: list[list[int]], soft: np.ndarray, width: int, steps: int = 400, ridge: float = 2e-4) -> np.ndarray:
    """Weights and bias of a logistic regression on sparse 0/1 features and soft labels, by Nesterov steps."""
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    column = np.array([k for f in features for k in f], dtype=np.int64)
    norm = max((len(f) for f in features), default=0) + 1
    weights = ahead = np.zeros(width + 1)
    for step in range(steps):
        z = np.bincount(row, ahead[column], len(features)) + ahead[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - soft
        gradient = np.append(np.bincount(column, error[row], width), error.sum()) / max(len(features), 1)
        gradient[:-1] += ridge * ahead[:-1]
        new = ahead - gradient * 4 / min(norm, 12)
        ahead = new + step / (step + 3) * (new - weights)
        weights = new
    return weights


@dataclass
class ToxicityModel:
    markers: Markers
    labels: LabelModel
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, rule: ToxicityRule = ToxicityRule()) -> ToxicityModel:
    """Mine markers, fit the label model to the votes on all documents, and the classifier to its posteriors on the learning rows."""
    rows = learning_rows(docs, labels, rule)
    markers = mine_markers(rows, rule)

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for frame in frames:
            seen.update(markers.look(t or "")[0] for t in frame["text"])
        if seen:
            yield pd.DataFrame(list(seen.items()), columns=["votes", "n"])

    # At most 2**voters rows, whatever the corpus.
    tally = docs.select("text").mapInPandas(vote, "votes int, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    patterns, counts = np.array([r.votes for r in tally], np.int64), np.array([r.n for r in tally], float)
    model = LabelModel(patterns, counts)

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            looked = pd.DataFrame([markers.look(t) for t in frame["text"]], columns=["votes", "features"], index=frame.index)
            yield looked.assign(toxic=frame["toxic"])

    sample = sorted(rows.mapInPandas(look, "votes int, features array<int>, toxic int").collect())  # at most ``labelled`` rows
    votes, labelled = np.array([r.votes for r in sample], np.int64), np.array([r.toxic for r in sample], np.int64)
    return ToxicityModel(markers, model, fit_linear([r.features for r in sample], model.posterior(votes, labelled), len(markers.places)))


def scorer(model: ToxicityModel):
    """A column function from texts to scores between 0 and 1; a null text scores as an empty one."""
    markers, weights = model.markers, model.weights

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        z = np.array([weights[markers.look(t or "")[1]].sum() for t in texts]) + weights[-1]
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, rule: ToxicityRule = ToxicityRule()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Labels teach only from ids whose crc32 modulo 3 is not 1; several labels of
    one id count as toxic if one of them does, null labels not at all. Without labels the
    seeds and patterns vote alone. Repeated rows score alike; empty input gives
    an empty table; other columns are ignored.
    """
    score = scorer(train(docs, labels, rule))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= rule.cut).cast("int"))
