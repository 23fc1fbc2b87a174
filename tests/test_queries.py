"""Registered queries against their SQL on the smallest tables."""

import pytest
import verify

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [
    "flagship_alert_utility", "src_build_panel", "win_locf_split_runs", "win_deviation", "prj_build_clinical", "met_sweep", "met_evaluate",
    "met_delong", "split_make_splits", "sta_drift_report", "sta_rank_auc", "agg_quantiles",
]


@pytest.fixture(scope="module")
def duck():
    return verify.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert verify.compare(got, duck.execute(entry.oracle_sql()[name]).df()) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 120


def test_streamed_state_matches_batch():
    """State carried over cuts of the hours equals one pass over all of them."""
    import numpy as np
    from causal_panel.streaming.features import advance, empty_state
    from panel_checks.inputs import SPEC

    rng = np.random.default_rng(0)
    x = np.where(rng.random((200, 5)) < 0.1, rng.normal(size=(200, 5)), np.nan)
    start = lambda: empty_state(5, SPEC.windows.lookback)
    _, whole = advance(start(), x, SPEC)
    state, parts = start(), []
    for lo in range(0, 200, 17):
        state, out = advance(state, x[lo : lo + 17], SPEC)
        parts.append(out)
    np.testing.assert_allclose(np.concatenate(parts), whole, atol=1e-9)
