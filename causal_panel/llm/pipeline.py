"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir); docs has the columns doc_id, text, lang, source, n_chars and maybe more.

All of them take nulls in any column, empty and very long texts, rows that
repeat and tables without rows; columns beyond those five, whatever their names,
pass through every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causal_panel.llm import lsh_forest, packing, secret_scan, source_mix, toxicity
from causal_panel.llm.queries import tokenizer_path
from causal_panel.llm.text import table

#: At 0.80 a pair is in no common region of 32 trees of depth 4 with probability (1 - 0.8**4)**32 = 5e-8,
#: and its signatures agree in fewer than 0.61 of 128 hashes with 6e-7.
NEAR = lsh_forest.ForestRule(words=5, percent=80, trees=32, screen=0.61)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    A null text is scored as an empty one; rows of one text stay or go together.
    Labels of ids that ``docs`` lacks teach nothing, and without any the voters' seeds decide.
    """
    score = toxicity.scorer(toxicity.train(docs, table(spark, sf_dir, "labels")))
    return docs.filter(score("text") < toxicity.ToxicityRule().cut)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity of 0.8 or more): the one whose id is the smallest.

    Rows of one id are one document and stay or go together; rows without an id stay, and so do texts without words.
    """
    grouped = lsh_forest.near_duplicates(docs, NEAR)
    gone = grouped.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the text.

    A null text stays null and keeps its n_chars; equal rows stay equal.
    """
    clean = secret_scan.redact(docs, secret_scan.findings(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.

    A null source is a source of its own, last in the order; rows of one id are
    taken alike; documents without words have size 0.
    """
    return source_mix.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens.

    A null or empty text is the end token alone; a row that repeats is packed as
    often as it stands there; null ids are kept.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_copies),
    ("secret_scan", redact_secrets),
    ("source_mix", mix),
    ("best_fit_packing", pack),
]
