"""Folds over ranges against plain loops, and the isotonic fit that rests on them."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from causal_panel.operators import isotonic
from causal_panel.operators.scan import range_scan
from causal_panel.operators.windows import running_best

SCHEMA = "g string, k int, v long, x double, d decimal(10, 2), s string"


@pytest.fixture
def many_ranges(spark):
    """As many ranges as rows nearly: groups straddle them, and batches of two rows straddle frames."""
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield spark
    for c, v in before.items():
        spark.conf.set(c, v)


def drawn(rng, n):
    maybe = lambda v: None if rng.random() < 0.3 else v
    return [(rng.choice(["a", "a", "a", "b", None]), k, maybe(rng.randrange(-50, 50)), maybe(rng.random()), maybe(Decimal(rng.randrange(900)) / 100), maybe(rng.choice("pqrst"))) for k in range(n)]


@pytest.mark.parametrize("inclusive", [False, True])
def test_folds_match_a_loop(many_ranges, inclusive):
    rows = drawn(random.Random(inclusive), 200) + [("lone", 0, None, None, None, None)]
    folds = {"v_sum": ("sum", "v"), "d_sum": ("sum", "d"), "v_max": ("max", "v"), "x_min": ("min", "x"), "s_last": ("last", "s"), "x_last": ("last", "x"), "s_max": ("max", "s")}
    df = many_ranges.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA)
    found = {(r.g, r.k): r for r in range_scan(df, ["k"], folds, by=["g"], inclusive=inclusive, totals=True).collect()}
    assert len(found) == len(rows)
    column = dict(v=2, x=3, d=4, s=5)
    value = {
        "sum": lambda vs: sum(vs), "max": lambda vs: max(vs, default=None), "min": lambda vs: min(vs, default=None), "last": lambda vs: vs[-1] if vs else None,
    }
    for g, k, *_ in rows:
        mine = [r for r in rows if r[0] == g]
        upto = [r for r in mine if r[1] < k or inclusive and r[1] == k]
        for name, (how, c) in folds.items():
            known = lambda rs: [r[column[c]] for r in rs if r[column[c]] is not None]
            assert found[g, k][name] == value[how](known(upto)), (g, k, name)
            assert found[g, k][f"{name}_all"] == value[how](known(mine))


def test_scans_of_nothing_and_of_taken_names(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert range_scan(df, ["k"], {"t": ("sum", "v")}, totals=True).count() == 0
    with pytest.raises(ValueError):
        range_scan(df, ["k"], {"x": ("sum", "v")})
    with pytest.raises(ValueError):
        range_scan(df, ["k"], {"t": ("median", "v")})


def test_running_best_of_all_trials(many_ranges):
    values = [random.Random(3).random() if k % 5 else None for k in range(300)]
    trials = many_ranges.createDataFrame([(k, v) for k, v in enumerate(values)], "trial int, value double")
    best = {r.trial: r.best_so_far for r in running_best(trials, "trial", "value").collect()}
    assert best == {k: max((v for v in values[:k + 1] if v is not None), default=None) for k in range(300)}


def by_hand(points):
    """Largest over all starts of the smallest mean over all ends."""
    y, w = np.array([p[1] for p in points], float), np.array([p[2] for p in points], float)
    mean = lambda a, b: y[a:b + 1].sum() / w[a:b + 1].sum()
    return [max(min(mean(a, b) for b in range(i, len(points))) for a in range(i + 1)) for i in range(len(points))]


@pytest.mark.parametrize("shape", ["rising", "falling", "noise", "late"])
def test_isotonic_fit_of_groups_over_many_ranges(many_ranges, shape):
    rng = random.Random(5)
    rows, hand = [], {}
    for g in ("a", None):
        points = []
        for k in range(70):
            w = rng.randrange(1, 9)
            share = {"rising": k / 70, "falling": 1 - k / 70, "noise": rng.random(), "late": k < 60 and k / 60}[shape]
            points.append((k / 7, min(w, max(0, round(w * share + rng.random() - 0.5))), w))
        rows += [(g, *p) for p in points]
        hand[g] = by_hand(points)
    df = many_ranges.createDataFrame(rng.sample(rows, len(rows)), "g string, x double, total long, weight long")
    blocks = isotonic.pooled_blocks(df, "x", "total", "weight", ["g"])
    fitted = {(r.g, r.x): r.value for r in isotonic.interpolated(df.select("g", "x"), "x", blocks, by=["g"]).collect()}
    for g, values in hand.items():
        assert [fitted[g, k / 7] for k in range(70)] == pytest.approx(values)
    asked = many_ranges.createDataFrame([("a", -1.0), ("a", 0.05), ("a", 99.0)], "g string, x double")
    low, between, high = [r.value for r in isotonic.interpolated(asked, "x", blocks, by=["g"]).orderBy("x").collect()]
    assert low == pytest.approx(hand["a"][0]) and high == pytest.approx(hand["a"][-1])
    assert between == pytest.approx(hand["a"][0] + (hand["a"][1] - hand["a"][0]) * 0.35)
