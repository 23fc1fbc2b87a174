"""What queries do once or seldom, where every row would do it again."""

import datetime as dt

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry
from causal_panel.functions.scalar import logit
from causal_panel.operators import bootstrap
from causal_panel.operators.calibrators import Calibrator
from panel_checks import inputs, scoring


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with a few entities' events, customers and nations."""
    folder, start = tmp_path_factory.mktemp("small"), dt.datetime(2024, 1, 1)
    kinds = inputs.CHANNELS
    events = [
        (7 * e + k, start + dt.timedelta(hours=(5 * k + e) % 60, minutes=k), e, kinds[(e + k) % 5], round(37.5 * ((k * 13 + e * 7) % 19), 2))
        for e in range(1, 25) for k in range(30)
    ]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    write(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double", "events")
    write([(e, e % 4, 100.5 * e) for e in range(1, 25)], "c_custkey long, c_nationkey long, c_acctbal double", "customer")
    write([(n, n) for n in range(4)], "n_nationkey long, n_regionkey long", "nation")
    return str(folder)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_weights_are_stored_once_per_hour(spark, small):
    rows = scoring.weighted(spark, small)
    stored = inputs._STAGED[(spark.sparkContext.applicationId, small, "weighted")]
    hours = inputs.wide_scores(spark, small).count()
    assert stored.count() == hours and rows.count() == 3 * hours
    assert rows.columns == ["split", "entity", "idx", "y", "u_pos", "u_neg", "delta", "model", "score"]
    assert entry.queries()["met_best_threshold"](spark, small).count() == 6


def test_entities_are_hashed_after_they_are_distinct(spark, monkeypatch):
    scores = spark.createDataFrame([("m", e, i / 10, (e + i) % 2) for e in range(6) for i in range(4)] + [("m", None, 0.5, 1)], "model string, entity long, score double, y int")
    seen, scan = [], bootstrap.range_scan
    monkeypatch.setattr(bootstrap, "range_scan", lambda df, *a, **b: (seen.append(df), scan(df, *a, **b))[1])
    drawn = bootstrap.entity_draws(scores, "entity", 8, groups=["model"]).collect()
    assert sorted((r["_entity"] is None, r["_entity"] or "") for r in drawn) == [*[(False, str(e)) for e in range(6)], (True, "")]
    assert sum(sum(r["times"]) for r in drawn) == 8 * 7
    last = [line for line in optimized(seen[0]).splitlines() if "md5" in line or "Aggregate" in line]
    assert "Aggregate" in last[-1] and not any("md5" in line for line in optimized(seen[0]).split("Aggregate", 1)[1].splitlines()[1:])


def test_platt_scores_without_vectors(spark):
    rows = spark.createDataFrame([(i / 40, int(i * 7 % 40 < i)) for i in range(41)] + [(None, 1), (float("nan"), 0)], "score double, y int")
    fitted = Calibrator("platt").fit(rows.where("not isnan(score)"))
    found = fitted.transform(rows)
    assert "UDF" not in optimized(found) and found.columns == ["score", "y", "calibrated"]
    whole = fitted.model.transform(rows.where("score is not null").withColumn("x", array_to_vector(F.array(logit("score"))))).select("score", vector_to_array("probability")[1].alias("p"))
    key = lambda v: "" if v is None else str(v)
    got = {key(r.score): r.calibrated for r in found.collect()}
    assert got.pop("") is None  # as with isotonic maps
    assert got == pytest.approx({key(r.score): r.p for r in whole.collect()}, abs=1e-14)


def test_lines_are_moved_as_they_are_stored(spark, tmp_path):
    """Orders are brought together before the columns of the snapshot are worked out."""
    lines = [(o, n + 1, 3.0 * n + o, 100.5 * o + n, 0.01 * n, 0.02, "F" if o % 2 else "O") for o in range(1, 9) for n in range(o % 4 + 1)]
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linestatus string"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    built = entry.queries()["prj_build_clinical"](spark, str(tmp_path))
    assert sorted((r.l_orderkey, r.l_linenumber) for r in built.collect()) == sorted(row[:2] for row in lines)
    sent = optimized(built).split("RepartitionByExpression")
    assert len(sent) > 1 and not any("CASE WHEN" in part.split("RelationV2")[0].split("Relation [")[0].partition("\n")[2] for part in sent[1:2])
