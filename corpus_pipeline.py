"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing and packing, each stage on what the one before it kept.

``run(spark, sf_dir)`` applies STAGES to ``documents``. A stage takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs; all but the last return the columns of documents. Near-duplicates
are documents whose sets of five-word shingles have a similarity of 0.8 or more (NEAR).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causal_panel.llm.pipeline import NEAR, STAGES  # noqa: F401
from causal_panel.llm.text import table
from causal_panel.session import staged

#: SQL cannot express the classifiers and the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
