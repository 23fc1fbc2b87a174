import hashlib

import numpy as np
import pytest
from panels import cohort
from pyspark.sql import functions as F

from causal_panel.operators import alerts, bootstrap, discrimination, evaluation, reliability, splits, utility
from causal_panel.operators.calibrators import Calibrator

SCHEMA = "entity string, idx int, y int, score double"


def by_hour(rows, threshold):
    """Utility summed hour by hour from the piecewise definition."""
    got = best = idle = 0.0
    for e in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == e)
        hits = [h for _, h, y, _ in own if y]
        for _, h, _, s in own:
            if not hits:
                tp, fn = -0.05, 0.0
            else:
                d = h - (min(hits) + 6)
                if d > 3:
                    tp = fn = 0.0
                elif d <= -6:
                    tp, fn = max((d + 12) / 6, -0.05), 0.0
                else:
                    tp, fn = (3 - d) / 9, -2 * (d + 6) / 9
            got += tp if s >= threshold else fn
            best += max(tp, fn)
            idle += fn
    return got, (got - idle) / (best - idle)


@pytest.fixture(scope="module")
def rows():
    return cohort()


@pytest.fixture(scope="module")
def weighted(spark, rows):
    return utility.utility_weights(spark.createDataFrame(rows, SCHEMA)).cache()


@pytest.mark.parametrize("threshold", [0.3, 0.9])
def test_utility_matches_hourly_definition(weighted, rows, threshold):
    found = utility.utility_scores(weighted, F.col("score") >= threshold).first()
    raw, norm = by_hour(rows, threshold)
    assert found["utility_raw"] == pytest.approx(raw, abs=1e-9) and found["utility"] == pytest.approx(norm, abs=1e-9)


def test_utility_bounds(weighted):
    at = lambda c: utility.utility_scores(weighted, c).first()["utility"]
    assert at(F.lit(False)) == 0 and at(F.col("delta") > 0) == pytest.approx(1) and at(F.lit(True)) < 1


def test_sweep_is_exhaustive_and_picks_the_first_maximum(weighted, rows):
    swept = utility.sweep(utility.score_prefix(weighted)).toPandas().sort_values("threshold", ignore_index=True)
    scores = np.array([r[3] for r in rows])
    assert np.allclose(swept["threshold"], np.unique(np.quantile(scores, np.linspace(0, 1, 200))))
    for _, r in swept.iloc[::40].iterrows():
        assert r["utility"] == pytest.approx(by_hour(rows, r["threshold"])[1], abs=1e-9)
    best = utility.best_threshold(utility.sweep(utility.score_prefix(weighted))).first()
    assert best["threshold"] == pytest.approx(swept.loc[swept["utility"].round(12).idxmax(), "threshold"])


def test_auroc_and_delong_on_equal_scores(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    y, s = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    wins = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    assert discrimination.auroc(discrimination.label_prefix(df)).first()["auroc"] == pytest.approx(wins, abs=1e-12)
    same = discrimination.delong_test(df.withColumn("again", F.col("score")), "score", "again")
    assert same["z"] == 0 and same["p_value"] == 1


def test_bootstrap_brackets_the_point_and_repeats(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.round(0.4 * F.col("y") + 0.8 * F.col("score"), 2))
    for metric in ("auroc", "auprc"):
        a = bootstrap.cluster_bootstrap_ci(df, metric=metric, n_boot=60, seed=3).first()
        b = bootstrap.cluster_bootstrap_ci(df.repartition(7), metric=metric, n_boot=60, seed=3).first()
        assert a["ci_low"] < a["point"] < a["ci_high"] and a["replicates"] == 60
        assert a["ci_low"] == pytest.approx(b["ci_low"], abs=1e-9) and a["ci_high"] == pytest.approx(b["ci_high"], abs=1e-9)


def drawn_by_hand(entities, b, seed):
    """How often replicate ``b`` draws each entity: bucket by bucket, from the hashes alone."""
    ranked = sorted(entities, key=lambda e: (hashlib.md5(f"{e}:{seed}".encode()).hexdigest(), e))
    times = dict.fromkeys(entities, 0)
    fell = bootstrap.draws(seed, b, 0, 0, len(ranked), len(ranked)) // bootstrap.BUCKET
    for k in range(-(-len(ranked) // bootstrap.BUCKET)):
        inside = ranked[k * bootstrap.BUCKET:(k + 1) * bootstrap.BUCKET]
        for slot in bootstrap.draws(seed, b, k + 1, 0, int((fell == k).sum()), len(inside)):
            times[inside[slot]] += 1
    return times


def test_bootstrap_draws_n_of_n_entities(spark):
    groups = {"x": [f"e{k}" for k in range(2500)], None: [f"e{k}" for k in range(700)], "y": ["only"]}
    rows = spark.createDataFrame([(g, e, 0.5) for g, es in groups.items() for e in es for _ in range(2)], "model string, entity string, score double")
    drawn = {}
    for r in bootstrap.entity_draws(rows, "entity", 40, 9, ["model"]).collect():
        drawn.setdefault(r.model, {})[r._entity] = np.frombuffer(r.times, "u1").astype(int)
    for g, es in groups.items():
        total = sum(drawn[g].values())
        assert sorted(drawn[g]) == sorted(es) and (total == len(es)).all()
        for b in (0, 17, 39):
            assert {e: int(t[b]) for e, t in drawn[g].items()} == drawn_by_hand(es, b, 9)
    many = np.concatenate([t for t in drawn["x"].values()])
    assert abs((many == 0).mean() - np.exp(-1)) < 0.01 and abs(many.var() - 1) < 0.03  # binomial(n, 1/n)


def test_bootstrap_replicate_by_hand(spark, rows):
    """One replicate equals the statistic of the rows repeated as often as their entity is drawn, whatever the ranges."""
    half = [(e, h, y, round(s, 1)) for e, h, y, s in rows]
    df = spark.createDataFrame([("raw", *r) for r in rows] + [("ties", *r) for r in half] + [("blank", *r[:3], None) for r in rows], "model string, " + SCHEMA)
    found = {m: {(r["model"], r["b"]): r["value"] for r in bootstrap.replicates(df.repartition(5), metric=m, n_boot=3, seed=5, groups=["model"]).collect()} for m in ("auroc", "auprc")}
    assert {k for k in found["auroc"]} == {(m, b) for m in ("raw", "ties") for b in range(3)} == set(found["auprc"])
    for model, mine in (("raw", rows), ("ties", half)):
        y, s = np.array([r[2] for r in mine]), np.array([r[3] for r in mine])
        pairs = (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
        for b in range(3):
            times = drawn_by_hand({r[0] for r in mine}, b, 5)
            k = np.array([times[r[0]] for r in mine])
            assert found["auroc"][model, b] == pytest.approx((k[y == 1][:, None] * pairs * k[y == 0]).sum() / (k[y == 1].sum() * k[y == 0].sum()), abs=1e-9)
            above = s[:, None] <= s  # rows at or above each row's score
            precision = (above * (k * y)).sum(axis=1) / np.maximum((above * k).sum(axis=1), 1)
            assert found["auprc"][model, b] == pytest.approx((k * y * precision).sum() / (k * y).sum(), abs=1e-9)


def test_alert_timing_known_answer(spark):
    stay = [("s", h, int(h >= 20), float(h >= 14)) for h in range(40)] + [("late", h, int(h >= 20), float(h >= 30)) for h in range(40)]
    timing = alerts.alert_timing(spark.createDataFrame(stay, SCHEMA), F.col("score") >= 0.5)
    by = {r["entity"]: r for r in timing.collect()}
    assert (by["s"]["onset_hour"], by["s"]["first_alert_hour"], by["s"]["lead_time_hours"]) == (26, 14, 12)
    assert by["late"]["lead_time_hours"] == -4
    summary = alerts.lead_time_summary(timing).first()
    assert summary["septic_admissions"] == 2 and summary["detected_before_onset"] == 1 and summary["median_lead_time_h"] == 12


def test_no_detection_means_unbounded_false_alarms(spark):
    rows = [(f"c{e}", h, 0, float(e == 1 and h == 3)) for e in range(3) for h in range(20)]
    summary = alerts.lead_time_summary(alerts.alert_timing(spark.createDataFrame(rows, SCHEMA), F.col("score") >= 0.5)).first()
    assert summary["control_admissions_with_any_alert"] == 1 and summary["false_alarms_per_true_detection"] == float("inf")


def test_calibration_keeps_order_and_lowers_brier(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=4000)
    raw = 1 / (1 + np.exp(-1.5 * z))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * z - 3)))).astype(int)
    df = spark.createDataFrame([(str(i), 0, int(a), float(b)) for i, (a, b) in enumerate(zip(y, raw))], SCHEMA).cache()
    auc = lambda d, c: discrimination.auroc(discrimination.label_prefix(d, c)).first()["auroc"]
    for method, slack in (("platt", 1e-9), ("isotonic", 2e-2)):
        out = Calibrator(method).fit(df).transform(df)
        assert auc(out, "calibrated") == pytest.approx(auc(df, "score"), abs=slack)
        assert reliability.brier(out, "calibrated").first()["brier"] < reliability.brier(df).first()["brier"]


def test_missing_labels_and_groups_lose_no_rows(spark):
    people = [(f"e{k}", "A", None if k % 7 == 0 else int(k % 3 == 0)) for k in range(20)]
    panel = spark.createDataFrame([(*p, h) for p in people for h in range(2)], "entity string, site string, y int, idx int")
    assert splits.make_splits(panel, "entity", "y", "site", "A", 1).count() == 20
    assert splits.grouped_folds(panel, "entity", "y", 4, 1).count() == 20
    kept = splits.downsample_negatives(panel, "y", ["entity", "idx"], 50, 1).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in kept} == {None: 6, 1: 12, 0: 11}
    away = panel.withColumn("site", F.when(F.col("entity") != "e1", F.col("site")))
    assert splits.make_splits(away, "entity", "y", "site", "A", 1).count() == 20

    rows = [(g, k / 10, int(k > 4)) for g in ("x", None) for k in range(10)]
    scores = spark.createDataFrame(rows, "model string, score double, y int")
    found = discrimination.auroc(discrimination.label_prefix(scores, groups=["model"]), ["model"]).collect()
    assert {r.model: r.auroc for r in found} == {"x": 1.0, None: 1.0}


def test_bootstrap_leaves_out_missing_scores(spark):
    rng = np.random.default_rng(4)
    scored = [(f"e{k}", float(s), int(rng.random() < s)) for k, s in enumerate(rng.random(300))]
    blank = [(f"m{k}", v, 1) for k, v in enumerate([None, float("nan")] * 80)] + [("z", 0.5, None)]
    schema = "entity string, score double, y int"
    alone, mixed = (bootstrap.cluster_bootstrap_ci(spark.createDataFrame(r, schema), n_boot=60).first() for r in (scored, scored + blank))
    assert tuple(alone) == pytest.approx(tuple(mixed)) and alone.ci_low < alone.point < alone.ci_high
