"""Screens, drift and collinearity."""

from __future__ import annotations

from pyspark.sql import functions as F

from causal_panel.operators import collinearity, drift, univariate
from causal_panel.operators.aggregates import entity_summaries
from causal_panel.operators.windows import build_features

from . import query
from .inputs import (
    DRIFT_FEATURES, DRIFT_SQL, INTENSITY_CHANNELS, ORDER_FEATURES, PANEL_SQL, RUNNING, SPEC, SUMMARY_SQL,
    drift_pair, once, order_rows, panel, r6, s6, span_hours, table,
)
from .tables import quantile_sql


def summary(spark, sf):
    return once(spark, sf, "order-summary", lambda: entity_summaries(order_rows(spark, sf), "entity", "y", ORDER_FEATURES))


def _rows(sql: str) -> str:
    return " UNION ALL ".join(sql.format(c=c) for c in ORDER_FEATURES)


_MOMENTS = _rows(
    """SELECT '{c}' AS feature, count({c}) FILTER (WHERE y = 1)::DOUBLE AS n_a, avg({c}) FILTER (WHERE y = 1) AS mean_a, var_samp({c}) FILTER (WHERE y = 1) AS var_a,
       count({c}) FILTER (WHERE y = 0)::DOUBLE AS n_b, avg({c}) FILTER (WHERE y = 0) AS mean_b, var_samp({c}) FILTER (WHERE y = 0) AS var_b FROM summary"""
)
_G = "((mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2))) * (1 - 3 / (4 * (n_a + n_b) - 9))"
_T = "(mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b)"
_DF = "((var_a / n_a + var_b / n_b) * (var_a / n_a + var_b / n_b)) / ((var_a / n_a) * (var_a / n_a) / (n_a - 1) + (var_b / n_b) * (var_b / n_b) / (n_b - 1))"


@query("sta_hedges_g", f"WITH {SUMMARY_SQL}, m AS ({_MOMENTS}) SELECT feature, {s6(_G)} AS g FROM m")
def sta_hedges_g(spark, sf):
    moments = univariate.two_group_moments(summary(spark, sf), "y", ORDER_FEATURES)
    return moments.select("feature", r6(univariate.hedges_g()).alias("g"))


@query("sta_welch", f"WITH {SUMMARY_SQL}, m AS ({_MOMENTS}) SELECT feature, {s6(_T, 5)} AS t, {s6(_DF, 3)} AS df FROM m")
def sta_welch(spark, sf):
    t, df = univariate.welch_t()
    moments = univariate.two_group_moments(summary(spark, sf), "y", ORDER_FEATURES)
    return moments.select("feature", r6(t, 5).alias("t"), r6(df, 3).alias("df"))


RANK_SQL = """lr AS (SELECT feature, y, v, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS rk FROM long WHERE v IS NOT NULL),
  tie AS (SELECT feature, sum(t * t * t - t) AS ties FROM (SELECT feature, v, count(*)::DOUBLE AS t FROM lr GROUP BY 1, 2) GROUP BY 1),
  us AS (SELECT feature, sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE AS u, sum(y)::DOUBLE AS a, (count(*) - sum(y))::DOUBLE AS b FROM lr GROUP BY 1),
  mw AS (SELECT feature, u, u / (a * b) AS auc, (greatest(u, a * b - u) - a * b / 2 - 0.5) / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) AS z FROM us JOIN tie USING (feature))"""
_LONG = "long AS (" + _rows("SELECT '{c}' AS feature, y, {c} AS v FROM summary") + ")"


@query("sta_rank_auc", f"WITH {SUMMARY_SQL}, {_LONG}, {RANK_SQL} SELECT feature, {s6('auc')} AS auc FROM mw")
def sta_rank_auc(spark, sf):
    return univariate.rank_tests(summary(spark, sf), "y", ORDER_FEATURES).select("feature", r6(F.col("auc")).alias("auc"))


@query("sta_mann_whitney", f"WITH {SUMMARY_SQL}, {_LONG}, {RANK_SQL} SELECT feature, {s6('u', 1)} AS u, {s6('z', 5)} AS z FROM mw")
def sta_mann_whitney(spark, sf):
    found = univariate.rank_tests(summary(spark, sf), "y", ORDER_FEATURES)
    return found.select("feature", r6(F.col("u"), 1).alias("u"), r6(F.col("z"), 5).alias("z"))


@query(
    "sta_benjamini_hochberg",
    f"""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey * 37 % 1009) / 1009.0::DOUBLE END AS p FROM part),
        r AS (SELECT id, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, id) AS raw, row_number() OVER (ORDER BY p, id) AS k FROM p WHERE p IS NOT NULL)
        SELECT id, {s6('least(min(raw) OVER (ORDER BY k DESC), 1)')} AS q FROM r UNION ALL SELECT id, NULL FROM p WHERE p IS NULL""",
)
def sta_benjamini_hochberg(spark, sf):
    tests = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 != 0, (F.col("p_partkey") * 37 % 1009) / F.lit(1009.0)).alias("p")
    )
    return univariate.benjamini_hochberg(tests, "p", "q").select("id", r6(F.col("q")).alias("q"))


@query(
    "sta_screen",
    f"""WITH {SUMMARY_SQL}, m AS ({_MOMENTS}), {_LONG}, {RANK_SQL} SELECT feature, n_a::BIGINT AS n_septic, n_b::BIGINT AS n_control, {s6('mean_a', 4)} AS mean_septic,
        {s6('mean_b', 4)} AS mean_control, {s6(_G)} AS hedges_g, {s6('auc')} AS univariate_auc, {s6(_T, 5)} AS welch_t, {s6(f'abs({_G})')} AS abs_g
        FROM m JOIN mw USING (feature) WHERE n_a >= 30 AND n_b >= 30""",
)
def sta_screen(spark, sf):
    found = univariate.screen(order_rows(spark, sf), "entity", "y", ORDER_FEATURES)
    digits = {"mean_septic": 4, "mean_control": 4, "hedges_g": 6, "univariate_auc": 6, "welch_t": 5, "abs_g": 6}
    return found.select("feature", "n_septic", "n_control", *[r6(F.col(c), d).alias(c) for c, d in digits.items()])


def _simpson(function: str, start: str, stop: str, n: int) -> str:
    """Integral of a function of ``u`` by Simpson's rule with n (even) steps."""
    at = function.replace("u", f"(({start}) + (({stop}) - ({start})) * i / {n}.0::DOUBLE)")
    weight = f"CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum(list_transform(range({n + 1}), lambda i: {weight} * {at})) * (({stop}) - ({start})) / {3 * n}.0::DOUBLE)"


_NORMAL_P = "least(1, sqrt(2 / pi()) * " + _simpson("exp(-u * u / 2)", "abs(z)", "abs(z) + 12", 4000) + ")"
_STUDENT_P = "2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * " + _simpson("pow(cos(u), df - 1)", "atan(abs(t) / sqrt(df))", "pi() / 2", 20000)
_STEPPED = lambda p: f"least(min(raw_{p}) OVER (ORDER BY k_{p} DESC), 1)"
TESTS_SQL = f"""{SUMMARY_SQL}, m AS ({_MOMENTS}), {_LONG}, {RANK_SQL},
  tests AS (SELECT feature, {_T} AS t, {_DF} AS df, z FROM m JOIN mw USING (feature) WHERE n_a >= 30 AND n_b >= 30),
  ps AS (SELECT feature, {_STUDENT_P} AS p_welch, {_NORMAL_P} AS p_mannwhitney FROM tests),
  raws AS (SELECT *, {', '.join(f'{p} * count(*) OVER () / row_number() OVER (ORDER BY {p}) AS raw_{p}, row_number() OVER (ORDER BY {p}) AS k_{p}' for p in ('p_welch', 'p_mannwhitney'))} FROM ps)"""


@query(
    "sta_screen_p_values",
    f"""WITH {TESTS_SQL} SELECT feature, {s6('p_welch')} AS p_welch, {s6('p_mannwhitney')} AS p_mannwhitney, {s6(_STEPPED('p_welch'))} AS q_welch,
        {s6(_STEPPED('p_mannwhitney'))} AS q_mannwhitney, {_STEPPED('p_welch')} < 0.05 AS significant FROM raws""",
)
def sta_screen_p_values(spark, sf):
    found = univariate.screen(order_rows(spark, sf), "entity", "y", ORDER_FEATURES)
    return found.select("feature", *[r6(F.col(c)).alias(c) for c in ("p_welch", "p_mannwhitney", "q_welch", "q_mannwhitney")], "significant")


_RATES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, y, v FROM (SELECT entity, max(y) OVER (PARTITION BY entity) AS y, idx, (count({c}) OVER {RUNNING}) / (idx + 1)::DOUBLE AS v FROM panel) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY idx DESC) = 1"
    for c in INTENSITY_CHANNELS
)


@query(
    "sta_missingness_informative",
    f"""WITH {PANEL_SQL}, long AS ({_RATES}), {RANK_SQL}, m AS (SELECT feature, avg(v) FILTER (WHERE y = 1) AS a1, avg(v) FILTER (WHERE y = 0) AS b1 FROM long GROUP BY 1)
        SELECT feature AS channel, {s6('a1')} AS order_rate_septic, {s6('b1')} AS order_rate_control, {s6('a1 / b1')} AS rate_ratio, {s6('auc')} AS auc_of_ordering FROM m JOIN mw USING (feature)""",
)
def sta_missingness_informative(spark, sf):
    rows = build_features(panel(spark, sf), SPEC, blocks=("intensity",), longest=span_hours(spark, sf), dtype="double")
    found = univariate.missingness_is_informative(rows, "entity", "idx", "y", INTENSITY_CHANNELS)
    return found.select("channel", *[r6(F.col(c)).alias(c) for c in ("order_rate_septic", "order_rate_control", "rate_ratio", "auc_of_ordering")])


# --- drift ------------------------------------------------------------------------------
DRIFT_LONG = "dl AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, side, {c} AS v FROM pair" for c in DRIFT_FEATURES) + ")"
PSI_SQL = f"""{DRIFT_SQL}, {DRIFT_LONG}, ref AS (SELECT feature, v FROM dl WHERE side = 0), {quantile_sql('ref', 'v', 11, 'feature')},
  edges AS (SELECT feature, q, row_number() OVER (PARTITION BY feature ORDER BY q) AS i, count(*) OVER (PARTITION BY feature) AS m FROM (SELECT DISTINCT feature, q FROM qp)),
  per AS (SELECT feature, v, count(*) FILTER (WHERE side = 0) AS r, count(*) FILTER (WHERE side = 1) AS k FROM dl WHERE v IS NOT NULL GROUP BY 1, 2),
  placed AS (SELECT p.feature, p.v, p.r, p.k, count(e.q) AS bin FROM per p LEFT JOIN edges e ON e.feature = p.feature AND e.i > 1 AND e.i < e.m AND e.q <= p.v GROUP BY 1, 2, 3, 4),
  tot AS (SELECT feature, count(v) FILTER (WHERE side = 0)::DOUBLE AS nr, count(v) FILTER (WHERE side = 1)::DOUBLE AS nk,
          avg((v IS NULL)::INTEGER) FILTER (WHERE side = 0) AS missing_ref, avg((v IS NULL)::INTEGER) FILTER (WHERE side = 1) AS missing_cmp,
          avg(v) FILTER (WHERE side = 0) AS mean_ref, avg(v) FILTER (WHERE side = 1) AS mean_cmp FROM dl GROUP BY 1),
  share AS (SELECT feature, sum(r) / any_value(nr) * (1 - any_value(missing_ref)) + 1e-6 AS p, sum(k) / any_value(nk) * (1 - any_value(missing_cmp)) + 1e-6 AS q FROM placed JOIN tot USING (feature) GROUP BY feature, bin
    UNION ALL SELECT feature, missing_ref + 1e-6, missing_cmp + 1e-6 FROM tot),
  psi AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM share GROUP BY 1),
  ks AS (SELECT feature, max(abs(fr / nr - fk / nk)) AS ks_stat FROM (SELECT feature, sum(r) OVER w AS fr, sum(k) OVER w AS fk FROM per WINDOW w AS (PARTITION BY feature ORDER BY v)) JOIN tot USING (feature) GROUP BY 1)"""


@query("sta_psi", f"WITH {PSI_SQL} SELECT feature, {s6('psi')} AS psi FROM psi")
def sta_psi(spark, sf):
    return drift.drift_report(drift_pair(spark, sf), DRIFT_FEATURES).select("feature", r6(F.col("psi")).alias("psi"))


@query("sta_ks", f"WITH {PSI_SQL} SELECT feature, {s6('ks_stat')} AS ks_stat FROM ks")
def sta_ks(spark, sf):
    return drift.drift_report(drift_pair(spark, sf), DRIFT_FEATURES).select("feature", r6(F.col("ks_stat")).alias("ks_stat"))


@query(
    "sta_drift_report",
    f"""WITH {PSI_SQL} SELECT feature, {s6('psi')} AS psi, {s6('missing_ref')} AS missing_ref, {s6('missing_cmp')} AS missing_cmp, {s6('mean_ref', 4)} AS mean_ref, {s6('mean_cmp', 4)} AS mean_cmp,
        {s6('ks_stat')} AS ks_stat, CASE WHEN psi <= 0.1 THEN 'stable' WHEN psi <= 0.25 THEN 'moderate' ELSE 'material' END AS severity FROM psi JOIN ks USING (feature) JOIN tot USING (feature)""",
)
def sta_drift_report(spark, sf):
    found = drift.ranked(drift.drift_report(drift_pair(spark, sf), DRIFT_FEATURES)).drop("ks_p")  # sta_drift_p_values has it
    digits = {"psi": 6, "missing_ref": 6, "missing_cmp": 6, "mean_ref": 4, "mean_cmp": 4, "ks_stat": 6}
    return found.withColumns({c: r6(F.col(c), d) for c, d in digits.items()})


_X = "sqrt(nr * nk / (nr + nk)) * ks_stat"


@query(
    "sta_drift_p_values",
    f"""WITH {PSI_SQL} SELECT feature, {s6('ks_stat')} AS ks_stat,
        {s6(f"CASE WHEN {_X} < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 301), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * pow({_X}, 2)))))) END")} AS ks_p
        FROM ks JOIN tot USING (feature)""",
)
def sta_drift_p_values(spark, sf):
    found = drift.drift_report(drift_pair(spark, sf), DRIFT_FEATURES)
    return found.select("feature", r6(F.col("ks_stat")).alias("ks_stat"), r6(F.col("ks_p")).alias("ks_p"))


# --- collinearity --------------------------------------------------------------------------
LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {s6(f'corr(CASE WHEN l_orderkey % 7 <> 0 THEN {a} END, {b})')} AS r FROM lineitem"
    for i, a in enumerate(LINE) for b in LINE[i + 1:]
)


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", *LINE)


_GAPPY = ", ".join(f"CASE WHEN (l_orderkey + {k}) % 7 <> 0 THEN {c} END AS {c}" for k, c in enumerate(LINE))


def gappy(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[f"CASE WHEN (l_orderkey + {k}) % 7 <> 0 THEN {c} END AS {c}" for k, c in enumerate(LINE)])


_GAP_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {s6(f'corr({a}, {b})')} AS r FROM g" for i, a in enumerate(LINE) for b in LINE[i + 1:])


@query("sta_correlation_pairs", f"WITH g AS (SELECT {_GAPPY} FROM lineitem) {_GAP_CORR}")
def sta_correlation_pairs(spark, sf):
    return collinearity.correlation_pairs(gappy(spark, sf), LINE).select("a", "b", r6(F.col("r")).alias("r"))


@query("sta_correlation_matrix", f"WITH g AS (SELECT {_GAPPY} FROM lineitem) {_GAP_CORR}")
def sta_correlation_matrix(spark, sf):
    """The wide route (masked cross-products) on the same columns."""
    r = collinearity.correlation_matrix(gappy(spark, sf), LINE)
    rows = [(a, b, float(r[i, j])) for i, a in enumerate(LINE) for j, b in enumerate(LINE) if i < j]
    return spark.createDataFrame(rows, "a string, b string, r double").select("a", "b", r6(F.col("r")).alias("r"))


def derived(spark, sf):
    """Line columns with two that nearly repeat others."""
    rows = table(spark, sf, "lineitem").select(*LINE)
    return rows.withColumns({
        "net": F.col("l_extendedprice") * (1 - F.col("l_discount")),
        "mixed": F.col("l_quantity") * (F.col("l_tax") + 0.9) + F.col("l_discount") * 20, "same": F.lit(1.0),
    })


DERIVED = (*LINE, "net", "mixed", "same")


LIVE = DERIVED[:-1]  # "same" does not vary
_R = ", ".join("[" + ", ".join("1::DOUBLE" if a == b else f"corr({a}, {b})" for b in LIVE) + "]" for a in LIVE)
_UNIT = lambda n: "[" + ", ".join("[" + ", ".join(f"{int(i == j)}::DOUBLE" for j in range(n)) + "]" for i in range(n)) + "]"
#: Gauss-Jordan elimination of the correlation matrix beside a unit matrix; greedy pruning; the largest eigenvalue by squaring, each time divided by the trace.
COLLINEARITY_SQL = f"""derived AS (SELECT {', '.join(LINE)}, l_extendedprice * (1 - l_discount) AS net, l_quantity * (l_tax + 0.9::DOUBLE) + l_discount * 20 AS mixed FROM lineitem),
r AS MATERIALIZED (SELECT [{_R}] AS r FROM derived),
steps AS (SELECT 0 AS k, list_transform(r, lambda row, i: list_concat(row, {_UNIT(len(LIVE))}[i])) AS m FROM r
  UNION ALL SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda v: v / row[k + 1])
    ELSE list_transform(row, lambda v, j: v - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM steps WHERE k < {len(LIVE)}),
vif AS (SELECT unnest({list(LIVE)!r}) AS feature, unnest(list_transform(range(1, {len(LIVE) + 1}), lambda i: m[i][{len(LIVE)} + i])) AS vif FROM steps WHERE k = {len(LIVE)}),
walk AS (SELECT 0 AS k, CAST([] AS INTEGER[]) AS kept FROM r
  UNION ALL SELECT k + 1, CASE WHEN len(list_filter(kept, lambda o: abs(r[k + 1][o]) >= 0.85)) = 0 THEN list_append(kept, CAST(k + 1 AS INTEGER)) ELSE kept END FROM walk, r WHERE k < {len(LIVE)}),
kept AS (SELECT kept, list_transform(kept, lambda i: list_transform(kept, lambda j: r[i][j])) AS r FROM walk, r WHERE k = {len(LIVE)}),
whole AS (SELECT name, m, len(m) AS n FROM (
  SELECT 'all' AS name, r AS m FROM r UNION ALL SELECT 'all inverse', list_transform(m, lambda row: row[{len(LIVE) + 1}:]) FROM steps WHERE k = {len(LIVE)}
  UNION ALL SELECT 'kept', r FROM kept)),
kept_steps AS (SELECT 0 AS k, list_transform(r, lambda row, i: list_concat(row, list_transform(range(1, len(r) + 1), lambda j: CASE WHEN i = j THEN 1::DOUBLE ELSE 0 END))) AS m, len(r) AS n FROM kept
  UNION ALL SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda v: v / row[k + 1])
    ELSE list_transform(row, lambda v, j: v - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END), n FROM kept_steps WHERE k < n),
powers AS (SELECT name, 0 AS k, 0::DOUBLE AS logs, m, n FROM (SELECT * FROM whole UNION ALL SELECT 'kept inverse', list_transform(m, lambda row: row[n + 1:]), n FROM kept_steps WHERE k = n)
  UNION ALL SELECT name, k + 1, logs + ln(t) / pow(2, k), list_transform(m, lambda row: list_transform(range(1, n + 1), lambda j: list_sum(list_transform(range(1, n + 1), lambda x: row[x] / t * (m[x][j] / t))))), n
  FROM (SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: m[i][i])) AS t FROM powers) WHERE k < 30),
eigen AS (SELECT name, exp(logs) AS largest FROM powers WHERE k = 30),
condition AS (SELECT split_part(a.name, ' ', 1) AS name, sqrt(a.largest * b.largest) AS value FROM eigen a JOIN eigen b ON b.name = a.name || ' inverse')"""


@query("sta_vif", f"WITH RECURSIVE {COLLINEARITY_SQL} SELECT feature, {s6('vif', 4)} AS vif FROM vif UNION ALL SELECT 'same', NULL")
def sta_vif(spark, sf):
    found = collinearity.variance_inflation_factors(derived(spark, sf), DERIVED)
    return found.withColumn("vif", r6(F.col("vif"), 4))


@query("sta_vif_top", f"WITH RECURSIVE {COLLINEARITY_SQL} SELECT feature, {s6('vif', 4)} AS vif FROM vif ORDER BY vif.vif DESC, feature LIMIT 3")
def sta_vif_top(spark, sf):
    return collinearity.variance_inflation_factors(derived(spark, sf), DERIVED).limit(3).withColumn("vif", r6(F.col("vif"), 4))


@query("sta_greedy_decorrelate", f"WITH RECURSIVE {COLLINEARITY_SQL} SELECT unnest(range(len(kept)))::INTEGER AS position, unnest(list_transform(kept, lambda i: {list(LIVE)!r}[i])) AS feature FROM kept")
def sta_greedy_decorrelate(spark, sf):
    kept = collinearity.greedy_decorrelate(derived(spark, sf), LIVE)
    return spark.createDataFrame([(i, c) for i, c in enumerate(kept)], "position int, feature string")


@query("sta_condition_number", f"WITH RECURSIVE {COLLINEARITY_SQL} SELECT {s6('value', 4)} AS condition_number FROM condition WHERE name = 'all'")
def sta_condition_number(spark, sf):
    value = collinearity.condition_number(derived(spark, sf), DERIVED)
    return spark.createDataFrame([(value,)], "condition_number double").select(r6(F.col("condition_number"), 4).alias("condition_number"))


@query(
    "sta_collinearity_report",
    f"""WITH RECURSIVE {COLLINEARITY_SQL} SELECT name, {s6('value', 4)} AS value FROM (
        SELECT 'n_features' AS name, {len(DERIVED)}::DOUBLE AS value UNION ALL SELECT 'n_after_pruning', len(kept) + 1 FROM kept UNION ALL SELECT 'max_vif', max(vif) FROM vif
        UNION ALL SELECT 'median_vif', median(vif) FROM vif UNION ALL SELECT 'n_vif_over_10', count(*) FROM vif WHERE vif > 10 UNION ALL SELECT 'condition_number', value FROM condition WHERE name = 'kept')""",
)
def sta_collinearity_report(spark, sf):
    """Figures of the report; a column that does not vary is kept by pruning and left out of the condition number."""
    found = collinearity.collinearity_report(derived(spark, sf), DERIVED)
    rows = [(k, float(v)) for k, v in found.items() if isinstance(v, (int, float))]
    return spark.createDataFrame(rows, "name string, value double").withColumn("value", r6(F.col("value"), 4))


