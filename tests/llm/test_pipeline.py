"""The pipeline stage by stage, and the text queries against their SQL."""

import random
import re
from collections import Counter

import pytest
import verify
from test_documents import awkward, brute_components, corpus, near_texts

import corpus_pipeline
from causal_panel.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return verify.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert verify.compare(queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()) == ""


def test_stages_do_what_they_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    assert all(t.columns == columns for t in tables[:-1])
    rows = [t.orderBy("doc_id").collect() for t in tables]

    scores = {r.doc_id: r.predicted for r in queries.QUERIES["op1_label_model"](spark, SF).collect()}
    assert rows[1] == [r for r in rows[0] if not scores[r.doc_id]] and len(rows[1]) < len(rows[0])

    groups = brute_components([r.text for r in rows[1]], corpus_pipeline.NEAR.percent)
    assert rows[2] == [rows[1][i] for i, _, first in groups if first == i]

    assert [r.doc_id for r in rows[3]] == [r.doc_id for r in rows[2]]
    for before, after in zip(rows[2], rows[3]):
        assert after.text == re.sub(r'(?i)(?<=token = ")[0-9a-f]{40}(?=")', "[SECRET]", before.text) and after.n_chars == len(after.text)

    words = lambda text: len(re.findall(r"[^\x20\x09-\x0d]+", text))
    total = sum(words(r.text) for r in rows[3])
    assert abs(sum(words(r.text) for r in rows[4]) - 1.5 * total) <= 0.12 * total
    copies = Counter(r.doc_id for r in rows[4])
    assert max(copies.values()) == 2 and {r.doc_id: r for r in rows[4]}.items() <= {r.doc_id: r for r in rows[3]}.items()

    pieces = Counter(r.doc_id for r in rows[5] if r.piece == 0)
    assert pieces == copies


def test_near_duplicate_stage_takes_pairs_from_0_80_on(spark):
    texts = near_texts(random.Random(1))
    wanted = [i for i, _, first in brute_components(texts, 80) if i == first]
    assert len(wanted) < sum(i == x for i, _, x in brute_components(texts))
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, corpus(spark, texts), SF).collect()) == wanted


def test_stages_take_awkward_rows(spark):
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() >= 6
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, SF).count()
