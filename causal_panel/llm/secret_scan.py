"""Secret scans: wide candidate patterns, and a random forest that removes false positives.

Candidates are blocks with a private key, passwords in addresses (user:password@host),
values assigned to a credential name, keys with a known head, and
long runs that mix letters and digits or are all digits. Each is described by its length, its
character classes and their transitions, how far a dictionary of the corpus
covers it, what path or address it is part of, and the words around it. A forest
trained on labelled findings tells secrets from ids, digests, paths, addresses
and numbers. A key block or a password in an address is a secret by its syntax,
unless it is a placeholder; such findings do not train the forest.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causal_panel.llm.text import as_text, fresh, words
from causal_panel.session import staged

NAMES = "token|secret|password|passwd|passphrase|pwd|apikey|api_key|api-key|access_key|access-key|private_key|auth|authorization|bearer|credential|credentials|key"
HEADS = r"AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[\w-]{30,}|sk-[A-Za-z0-9_-]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{6,}"
SCHEMES = r"(?:Bearer|Basic|Token|Digest)\s{1,3}"  # before the value of an authorization
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "your", "xxxx", "test", "todo", "redacted")

_assigned = re.compile(rf"(?<![A-Za-z])((?:[A-Za-z]+[_-])?(?:{NAMES}))[\"']?\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}([\"']?)(?:{SCHEMES})?([^\s\"'<>]{{6,}})", re.I)
_scheme = re.compile(r"(?<![A-Za-z])(?:Bearer|Basic)\s{1,3}([A-Za-z0-9._~+/=-]{12,})")
_login = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s:/?#@\"'<>]*:([^\s/?#\"'<>]+)@(?=[A-Za-z0-9\[])")
_begin = re.compile(r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----")
_finish = re.compile(r"-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----")
# Of a block whose END is missing: headers, lines of the key, and a shorter last one.
_body = re.compile(r"(?:[ \t]*\r?\n[A-Za-z][A-Za-z0-9-]*:[^\n]*)*(?:(?:\s+[A-Za-z0-9+/=]{24,})+(?:\s+[A-Za-z0-9+/]*[0-9+/=][A-Za-z0-9+/=]*(?=\s|\Z))?)?")
_blank = re.compile(r"\$?\{.*\}|\$[A-Z_]+|%\w+%|\[.*\]|\(.*\)|\*+|x+|\.+|your[_-]?\w*|pass|password|passwd|pwd|pw|secret|token|" + "|".join(PLACEHOLDERS), re.I)  # whole values
_assigns = re.compile(rf"(?:[:=]|=>)[\s\"']*(?:{SCHEMES})?$|\b(?:Bearer|Basic)\s{{1,3}}$", re.I)  # what stands before an assigned value
_headed = re.compile(rf"(?<![A-Za-z0-9])(?:{HEADS})")
_run = re.compile(r"[A-Za-z0-9+/_=.@:-]*\d[A-Za-z0-9+/_=.@:-]*")
_edge = ".,;:!?)(]["
_letters = re.compile(r"[a-z]+")
_neighbour = re.compile(r"[^\W_]+")
_name = re.compile(rf"(?:{NAMES})", re.I)
_kinds = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))

PROVED = ("login", "block")  # kinds whose syntax says that they are secrets

FEATURES = (
    "length", "digits", "upper", "other", "transitions", "distinct", "entropy", "hex", "dictionary", "assigned", "quoted", "headed",
    "named_before", "words_before", "slashes", "dots", "address", "mail", "placeholder", "groups",
)


@dataclass(frozen=True)
class SecretRule:
    """Dictionary: documents a word is in at least and words at most. Training: labelled findings at most, trees, depth. Cut of the probability."""

    common: int = 20
    dictionary: int = 5_000
    labelled: int = 20_000
    trees: int = 40
    depth: int = 8
    cut: float = 0.5


def common_words(docs: DataFrame, rule: SecretRule = SecretRule()) -> frozenset[str]:
    """The words of 3 to 14 plain letters that most documents have; counted over all of them."""
    plain = F.filter(F.array_distinct(words(F.lower("text"))), lambda w: w.rlike("^[a-z]{3,14}$"))
    counted = docs.select(F.explode(plain).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= rule.common)
    return frozenset(r.word for r in counted.orderBy(F.col("n").desc(), "word").limit(rule.dictionary).collect())


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every private key from its BEGIN to its END line, or to the last line of its body."""
    begun = list(_begin.finditer(text))
    for m, after in zip(begun, [*(b.start() for b in begun[1:]), len(text)]):
        end = _finish.search(text, m.end(), after)
        yield m.start(), end.end() if end else _body.match(text, m.end(), after).end()


def candidates_in(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every candidate; where patterns overlap the first kind wins.

    Candidates are key blocks and passwords in addresses of any length, keys with a
    known head, values of 6 characters and more under a credential's name (after the
    word Bearer or Basic, if one stands there), 12 and more after Bearer or Basic
    alone, and runs of 12 and more that hold a digit. Shorter values are none.
    """
    found: list[tuple[int, int, str]] = []
    if "=" in text or ":" in text:
        found += [(m.start(3), m.start(3) + len(m[3].rstrip(_edge)), "assigned") for m in _assigned.finditer(text) if len(m[3].rstrip(_edge)) >= 6]
    if "Bearer" in text or "Basic" in text:
        found += [(*m.span(1), "assigned") for m in _scheme.finditer(text)]
    if "://" in text and "@" in text:
        found += [(*m.span(1), "login") for m in _login.finditer(text)]
    if "PRIVATE KEY" in text:
        found += [(start, end, "block") for start, end in key_blocks(text)]
    found += [(*m.span(), "headed") for m in _headed.finditer(text)]
    for m in _run.finditer(text):
        value = m[0].strip(_edge)
        start = m.start() + m[0].find(value)
        if len(value) >= 12 and (value.isdigit() or any(c.isalpha() for c in value)):
            found.append((start, start + len(value), "run"))
    rank = {"block": 0, "login": 1, "headed": 2, "assigned": 3, "run": 4}
    kept: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))
    for start, end, kind in sorted(found, key=lambda x: (rank[x[2]], x[0])):
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            kept.append((start, end, kind))
    return sorted(kept)


def coverage(value: str, dictionary: frozenset[str]) -> float:
    """Share of the characters that the longest dictionary words cover, read from the left."""
    covered = 0
    for run in _letters.findall(value.lower()):
        at = 0
        while at < len(run):
            size = next((n for n in range(min(14, len(run) - at), 2, -1) if run[at: at + n] in dictionary), 0)
            covered += size
            at += size or 1
    return covered / len(value)


def describe(text: str, start: int, end: int, kind: str, dictionary: frozenset[str]) -> list[float]:
    """The FEATURES of a candidate."""
    value, n = text[start:end], end - start
    classes = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in value)
    before, after = text[max(0, start - 60): start], text[end: end + 20]
    joined = re.split(r"\s", before)[-1] + value
    near = _neighbour.findall(before)[-3:]
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return [float(x) for x in (
        n, classes.count("0") / n, classes.count("A") / n, classes.count("-") / n, sum(a != b for a, b in zip(classes, classes[1:])) / n,
        len(set(value)) / n, entropy, all(c in "0123456789abcdefABCDEF" for c in value), coverage(value, dictionary),
        bool(_assigns.search(before)), before[-1:] in ("\"", "'") and after[:1] == before[-1:], kind == "headed",
        any(_name.fullmatch(w) for w in near), sum(w.lower() in dictionary for w in near), value.count("/"), value.count("."),
        "://" in joined or "www." in joined, "@" in value or after[:1] == "@" or before[-1:] == "@",
        bool(_blank.fullmatch(value)) if kind in PROVED else any(p in value.lower() for p in PLACEHOLDERS), len(re.split(r"[-_.:/]", value)),
    )]


FOUND = "row_key long, doc_id string, start int, end int, kind string, digest string, features array<double>"


def candidates(docs: DataFrame, dictionary: frozenset[str]) -> DataFrame:
    """One row per candidate: where it is (characters), its kind, a digest of its value, and its features."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, doc, text in zip(frame["row_key"], frame["doc_id"], frame["text"]):
                for start, end, kind in candidates_in(text or ""):
                    sha = hashlib.sha256(text[start:end].encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((key, doc, start, end, kind, sha, describe(text, start, end, kind, dictionary)))
            yield pd.DataFrame(rows, columns=["row_key", "doc_id", "start", "end", "kind", "digest", "features"]).astype({"row_key": "int64"})

    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), as_text("doc_id"), "text")
    return rows.mapInPandas(run, FOUND).withColumn("doc_id", F.col("doc_id").cast("long"))


def reviewed(found: DataFrame) -> DataFrame:
    """Label the findings that need no second look: (digest, features, label).

    A secret is a key with a known head, or a value of 16 characters and more,
    rich in digits or mixed in case, that stands under a credential's name. No secret is an
    address, a path, a number, a placeholder or what dictionary words make up. Others stay unlabelled, and so do
    passwords in addresses and key blocks: the signs of an address say nothing about them.
    """
    f = {name: F.get("features", k) for k, name in enumerate(FEATURES)}
    rich = (f["length"] >= 16) & (f["entropy"] >= 3) & (f["dictionary"] < 0.4) & (f["digits"] < 1)
    secret = ((f["headed"] == 1) | (rich & (f["named_before"] == 1) & (f["assigned"] == 1))) & (f["placeholder"] == 0)
    harmless = (f["mail"] == 1) | (f["address"] == 1) | (f["digits"] == 1) | (f["slashes"] >= 2) | (f["dictionary"] >= 0.6) | (f["placeholder"] == 1)
    label = F.when(secret, 1).when(harmless, 0)
    return found.filter(~F.col("kind").isin(*PROVED)).select("digest", "features", label.alias("label")).filter("label IS NOT NULL")


def train_forest(labelled: DataFrame, rule: SecretRule = SecretRule()):
    """A forest from at most ``rule.labelled`` labelled findings (digest, features, label), chosen by digest; None if one label is missing."""
    once = labelled.groupBy("digest").agg(F.min_by("features", "label").alias("features"), F.min("label").cast("double").alias("label"))
    rows = staged(once.orderBy("digest").limit(rule.labelled).select("label", array_to_vector("features").alias("vector")), "secret-labels")
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=rule.trees, maxDepth=rule.depth, seed=11, rawPredictionCol="_raw", probabilityCol="_share", predictionCol="_class")
    return forest.fit(rows.coalesce(1))


def findings(docs: DataFrame, rule: SecretRule = SecretRule(), labelled: DataFrame | None = None) -> DataFrame:
    """(row_key, doc_id, start, end, kind, digest, score, is_secret) of every candidate in ``docs`` (doc_id, text).

    ``labelled`` has findings (digest, features, label) that someone reviewed;
    without it those that ``reviewed`` can label are used. ``start`` and ``end`` count
    characters. A null or empty text has no candidates; repeated rows have theirs each;
    without findings of both labels the forest is left out and a finding scores 1
    if it stands under a credential's name or has a known head. A key block scores 1, a password
    in an address too unless the whole of it is a placeholder, whatever the forest says. Values leave as digests only.
    """
    found = staged(candidates(docs, common_words(docs, rule)), "secret-candidates")
    model = train_forest(labelled if labelled is not None else reviewed(found), rule)
    keep = ["row_key", "doc_id", "start", "end", "kind", "digest"]
    proved = F.when(F.col("kind").isin(*PROVED), 1 - F.get("features", FEATURES.index("placeholder")))
    if model is None:
        plain = F.coalesce(proved, F.when(F.col("kind") == "run", 0.0).otherwise(1.0))
        return found.select(*keep, plain.alias("score"), (plain >= rule.cut).alias("is_secret"))
    scored = model.transform(found.withColumn("vector", array_to_vector("features")))
    scored = scored.withColumn("score", F.coalesce(proved, F.round(F.get(vector_to_array("_share"), 1), 6)))
    return scored.select(*keep, "score", (F.col("score") >= rule.cut).alias("is_secret"))


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret finding in its texts replaced by ``mark``; other texts and all other columns stay as they are."""
    key, cuts = fresh(docs, "_key"), fresh(docs, "_cuts")
    spans = found.filter("is_secret").select(F.col("row_key").alias(key), "start", "end").distinct()
    spans = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end")), asc=False).alias(cuts))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(spans, key, "left")
    cut = lambda text, s: F.overlay(text, F.lit(mark), s["start"] + 1, s["end"] - s["start"])
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.aggregate(cuts, F.col("text"), cut))
    return keyed.withColumn("text", text).select(*docs.columns)
