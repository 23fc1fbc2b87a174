"""Utility, ranking quality, calibration error, alert timing, blending."""

from __future__ import annotations

from pyspark.sql import functions as F

from causal_panel.operators import alerts, bootstrap, discrimination, evaluation, ordered, reliability, utility
from causal_panel.operators.blending import blend, contribution_table, optimise_weights, rank_normalise

from . import query
from .inputs import MODELS, SCORES_SQL, SPEC, WEIGHTS_SQL, WIDE_SQL, derive_panel, long_scores, once, r6, s6, span_hours, table, wide_scores
from .tables import quantile_sql

GROUPS = ["model", "split"]
KEY = "model || '/' || split"


def weighted(spark, sf):
    """Scores with the value of alerting at each hour, as a stage table."""
    rows = once(spark, sf, "weighted", lambda: utility.utility_weights(wide_scores(spark, sf)))
    return rows.unpivot(["split", "entity", "idx", "y", "u_pos", "u_neg", "delta"], list(MODELS), "model", "score")


@query(
    "flagship_alert_utility",
    f"""WITH {WEIGHTS_SQL} SELECT split, count(*) AS hours, count(DISTINCT entity) AS entities,
        {s6("sum(CASE WHEN score >= 0.5 THEN u_pos - u_neg ELSE 0 END) / nullif(sum(greatest(u_pos - u_neg, 0)), 0)")} AS utility
        FROM weighted WHERE model = 'rule' GROUP BY 1""",
)
def flagship_alert_utility(spark, sf):
    """From raw events to the utility of a rule-based alert, nothing staged in between."""
    from causal_panel.functions.scalar import indicator, total
    from causal_panel.operators.windows import build_features

    features = build_features(derive_panel(spark, sf), SPEC, blocks=("locf",), longest=span_hours(spark, sf), dtype="double")
    rule = total([
        F.lit(0.5) * indicator(F.col("error_locf") > 10000), F.lit(0.35) * indicator(F.col("click_locf") > 9000),
        F.lit(0.15) * indicator(F.col("view_locf") > 12000),
    ])
    rows = features.select("entity", "idx", "y", F.col("site").alias("split"), r6(rule).alias("score"))
    scored = utility.utility_weights(rows)
    per_entity = scored.groupBy("split", "entity").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("score") >= 0.5, F.col("delta")).otherwise(F.lit(0.0))).alias("gained"),
        F.sum(F.greatest("delta", F.lit(0.0))).alias("best"),
    )
    return per_entity.groupBy("split").agg(
        F.sum("n").alias("hours"), F.count(F.lit(1)).alias("entities"), r6(F.try_divide(F.sum("gained"), F.sum("best"))).alias("utility")
    )


@query(
    "met_utility_weights",
    f"WITH {WEIGHTS_SQL} SELECT entity, idx, {s6('u_pos')} AS u_pos, {s6('u_neg')} AS u_neg FROM weighted WHERE model = 'a'",
)
def met_utility_weights(spark, sf):
    rows = utility.utility_weights(wide_scores(spark, sf))
    return rows.select("entity", "idx", r6(F.col("u_pos")).alias("u_pos"), r6(F.col("u_neg")).alias("u_neg"))


@query(
    "met_utility_scores",
    f"""WITH {WEIGHTS_SQL}, d AS (SELECT *, u_pos - u_neg AS delta FROM weighted)
        SELECT model, split, {s6('sum(u_neg) + sum(CASE WHEN score >= 0.25 THEN delta ELSE 0 END)', 4)} AS utility_raw,
        {s6('coalesce(sum(CASE WHEN score >= 0.25 THEN delta ELSE 0 END) / nullif(sum(greatest(delta, 0)), 0), 0)')} AS utility FROM d GROUP BY 1, 2""",
)
def met_utility_scores(spark, sf):
    found = utility.utility_scores(weighted(spark, sf), F.col("score") >= 0.25, GROUPS)
    return found.select(*GROUPS, r6(F.col("utility_raw"), 4).alias("utility_raw"), r6(F.col("utility")).alias("utility"))


def _sweep_sql(points: int) -> str:
    return f"""WITH {WEIGHTS_SQL}, keyed AS (SELECT *, {KEY} AS g, u_pos - u_neg AS delta FROM weighted),
      {quantile_sql('keyed', 'score', points, 'g')},
      per AS (SELECT g, score, count(*) AS n, sum(y) AS pos, sum(delta) AS delta, sum(greatest(delta, 0)) AS best FROM keyed GROUP BY 1, 2),
      tot AS (SELECT g, sum(n) AS n, sum(pos) AS pos, sum(best) AS best FROM per GROUP BY 1),
      thr AS (SELECT DISTINCT g, q AS threshold FROM qp),
      reached AS (SELECT t.g, threshold, sum(p.n) AS n_above, sum(p.pos) AS pos_above, sum(p.delta) AS delta_above
             FROM thr t JOIN per p ON p.g = t.g AND p.score >= t.threshold GROUP BY 1, 2),
      swept AS (SELECT split_part(g, '/', 1) AS model, split_part(g, '/', 2) AS split, threshold,
             delta_above / nullif(best, 0) AS utility, n_above / n::DOUBLE AS alert_rate, n_above, n - n_above AS quiet,
             n_above - pos_above AS false_alarms, pos - pos_above AS missed FROM reached JOIN tot USING (g))"""


def swept(spark, sf, points=200):
    return utility.sweep(utility.score_prefix(weighted(spark, sf), groups=GROUPS), points, groups=GROUPS)


@query("met_sweep", f"{_sweep_sql(200)} SELECT model, split, {s6('threshold')} AS threshold, {s6('utility')} AS utility, {s6('alert_rate')} AS alert_rate FROM swept")
def met_sweep(spark, sf):
    return swept(spark, sf).select(*GROUPS, *[r6(F.col(c)).alias(c) for c in ("threshold", "utility", "alert_rate")])


@query(
    "met_best_threshold",
    f"""{_sweep_sql(200)} SELECT model, split, {s6('threshold')} AS threshold, {s6('utility')} AS utility FROM swept
        QUALIFY row_number() OVER (PARTITION BY model, split ORDER BY round(utility, 12) DESC, threshold) = 1""",
)
def met_best_threshold(spark, sf):
    best = utility.best_threshold(swept(spark, sf), GROUPS)
    return best.select(*GROUPS, r6(F.col("threshold")).alias("threshold"), r6(F.col("utility")).alias("utility"))


@query(
    "met_expected_cost",
    f"""{_sweep_sql(200)} SELECT model, split, {s6('threshold')} AS threshold, {s6('alert_rate * 1000')} AS alerts_per_1000_hours,
        false_alarms::BIGINT AS false_alarms, missed::BIGINT AS missed_positive_hours,
        (1.0 * false_alarms + 40.0 * missed)::DOUBLE AS expected_cost, {s6('coalesce(utility, 0)')} AS utility FROM swept""",
)
def met_expected_cost(spark, sf):
    found = utility.expected_cost_sweep(utility.score_prefix(weighted(spark, sf), groups=GROUPS), groups=GROUPS)
    return found.withColumns({c: r6(F.col(c)) for c in ("threshold", "alerts_per_1000_hours", "utility")})


# --- ranking -----------------------------------------------------------------------
AUC_SQL = """auc AS (SELECT {g}, (sum(CASE WHEN y = 1 THEN rk END) - any_value(np) * (any_value(np) + 1) / 2.0::DOUBLE) / (any_value(np) * any_value(nn)) AS auroc
  FROM (SELECT {g}, y, rank() OVER (PARTITION BY {g} ORDER BY score) + (count(*) OVER (PARTITION BY {g}, score) - 1) / 2.0::DOUBLE AS rk,
        sum(y) OVER (PARTITION BY {g})::DOUBLE AS np, (count(*) OVER (PARTITION BY {g}) - sum(y) OVER (PARTITION BY {g}))::DOUBLE AS nn FROM {t}) GROUP BY ALL)"""
AP_SQL = """ap AS (SELECT {g}, sum(pos * tp / n_at) / max(p) AS auprc FROM (
    SELECT {g}, score, sum(y)::DOUBLE AS pos, sum(sum(y)) OVER (PARTITION BY {g} ORDER BY score DESC)::DOUBLE AS tp,
           sum(count(*)) OVER (PARTITION BY {g} ORDER BY score DESC)::DOUBLE AS n_at, sum(sum(y)) OVER (PARTITION BY {g})::DOUBLE AS p FROM {t} GROUP BY {g}, score) GROUP BY ALL)"""
_AUC, _AP = AUC_SQL.format(g="model, split", t="scores"), AP_SQL.format(g="model, split", t="scores")


@query("met_auroc", f"WITH {SCORES_SQL}, {_AUC} SELECT model, split, {s6('auroc')} AS auroc FROM auc")
def met_auroc(spark, sf):
    found = discrimination.auroc(discrimination.label_prefix(long_scores(spark, sf), groups=GROUPS), GROUPS)
    return found.select(*GROUPS, r6(F.col("auroc")).alias("auroc"))


@query("met_average_precision", f"WITH {SCORES_SQL}, {_AP} SELECT model, split, {s6('auprc')} AS auprc FROM ap")
def met_average_precision(spark, sf):
    found = discrimination.average_precision(discrimination.label_prefix(long_scores(spark, sf), groups=GROUPS), GROUPS)
    return found.select(*GROUPS, r6(F.col("auprc")).alias("auprc"))


_DOCS_SQL = "docs AS (SELECT source, quality AS y, n_chars AS score FROM documents JOIN labels USING (doc_id))"


@query("met_auroc_documents", f"WITH {_DOCS_SQL}, {AUC_SQL.format(g='source', t='docs')}, {AP_SQL.format(g='source', t='docs')} SELECT source, {s6('auroc')} AS auroc, {s6('auprc')} AS auprc FROM auc JOIN ap USING (source)")
def met_auroc_documents(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("source", F.col("quality").alias("y"), F.col("n_chars").alias("score"))
    prefix = discrimination.label_prefix(docs, groups=["source"])
    both = discrimination.auroc(prefix, ["source"]).join(discrimination.average_precision(prefix, ["source"]), "source")
    return both.select("source", r6(F.col("auroc")).alias("auroc"), r6(F.col("auprc")).alias("auprc"))


_CURVE = """SELECT model, score AS threshold, {x} FROM (SELECT model, score, sum(sum(y)) OVER d AS tp, sum(count(*)) OVER d AS k,
    sum(sum(y)) OVER (PARTITION BY model) AS p, sum(count(*)) OVER (PARTITION BY model) AS n FROM scores GROUP BY 1, 2 WINDOW d AS (PARTITION BY model ORDER BY score DESC))"""


@query("met_roc_points", f"WITH {SCORES_SQL} " + _CURVE.format(x=f"{s6('(k - tp) / (n - p)::DOUBLE')} AS fpr, {s6('tp / p::DOUBLE')} AS tpr"))
def met_roc_points(spark, sf):
    points = discrimination.roc_points(discrimination.label_prefix(long_scores(spark, sf), groups=["model"]), groups=["model"])
    return points.select("model", "threshold", r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"))


@query("met_pr_points", f"WITH {SCORES_SQL} " + _CURVE.format(x=f"{s6('tp / p::DOUBLE')} AS recall, {s6('tp / k::DOUBLE')} AS precision"))
def met_pr_points(spark, sf):
    points = discrimination.pr_points(discrimination.label_prefix(long_scores(spark, sf), groups=["model"]), groups=["model"])
    return points.select("model", "threshold", r6(F.col("recall")).alias("recall"), r6(F.col("precision")).alias("precision"))


def _placements(c: str) -> str:
    rk = lambda part: f"(rank() OVER ({part} ORDER BY {c}) + (count(*) OVER ({part + ',' if part else 'PARTITION BY'} {c}) - 1) / 2.0::DOUBLE)"
    return f"CASE WHEN y = 1 THEN ({rk('')} - {rk('PARTITION BY y')}) / nn ELSE 1 - ({rk('')} - {rk('PARTITION BY y')}) / np END AS v_{c}"


DELONG_SQL = f"""counted AS (SELECT a, b, y, sum(y) OVER ()::DOUBLE AS np, (count(*) OVER () - sum(y) OVER ())::DOUBLE AS nn FROM wide),
  comp AS (SELECT y, {_placements('a')}, {_placements('b')} FROM counted),
  cls AS (SELECT y, count(*)::DOUBLE AS k, avg(v_a) AS ma, avg(v_b) AS mb, var_samp(v_a) + var_samp(v_b) - 2 * covar_samp(v_a, v_b) AS v FROM comp GROUP BY 1),
  dl AS (SELECT max(ma) FILTER (WHERE y = 1) AS auc_a, max(mb) FILTER (WHERE y = 1) AS auc_b, sum(v / k) AS var FROM cls)"""


@query("met_delong", f"WITH {WIDE_SQL}, {DELONG_SQL} SELECT {s6('auc_a')} AS auc_a, {s6('auc_b')} AS auc_b, {s6('auc_a - auc_b')} AS diff, {s6('(auc_a - auc_b) / sqrt(var)', 5)} AS z FROM dl")
def met_delong(spark, sf):
    found = discrimination.delong_components(wide_scores(spark, sf), "a", "b")
    return found.select(*[r6(F.col(c)).alias(c) for c in ("auc_a", "auc_b", "diff")], r6(F.col("z"), 5).alias("z"))


# --- calibration ----------------------------------------------------------------------
@query("met_brier", f"WITH {SCORES_SQL} SELECT model, split, {s6('avg((least(greatest(score, 0), 1) - y) * (least(greatest(score, 0), 1) - y))')} AS brier FROM scores GROUP BY 1, 2")
def met_brier(spark, sf):
    return reliability.brier(long_scores(spark, sf), groups=GROUPS).select(*GROUPS, r6(F.col("brier")).alias("brier"))


def _bins_sql(bins: int, g: str = KEY) -> str:
    return f"""keyed AS (SELECT *, {g} AS g FROM scores), {quantile_sql('keyed', 'score', bins + 1, 'g')},
      edges AS (SELECT g, q, row_number() OVER (PARTITION BY g ORDER BY q) AS i, count(*) OVER (PARTITION BY g) AS m FROM (SELECT DISTINCT g, q FROM qp)),
      sizes AS (SELECT g, any_value(m) AS m FROM edges GROUP BY 1),
      per AS (SELECT g, score, count(*) AS n, sum(y) AS pos FROM keyed GROUP BY 1, 2),
      placed AS (SELECT p.g, p.score, p.n, p.pos, any_value(s.m) AS m, count(e.q) AS bin FROM per p JOIN sizes s ON s.g = p.g
        LEFT JOIN edges e ON e.g = p.g AND e.i > 1 AND e.i < e.m AND e.q <= p.score GROUP BY 1, 2, 3, 4),
      bins AS (SELECT g, bin, sum(n) AS n, sum(score * n) / sum(n) AS predicted, sum(pos) / sum(n)::DOUBLE AS observed, any_value(m) AS m FROM placed GROUP BY 1, 2)"""


@query(
    "met_calibration_error",
    f"""WITH {SCORES_SQL}, {_bins_sql(20)}, tot AS (SELECT g, sum(n) AS t FROM bins GROUP BY 1)
        SELECT split_part(g, '/', 1) AS model, split_part(g, '/', 2) AS split, {s6('sum(n / t::DOUBLE * abs(predicted - observed))')} AS ece FROM bins JOIN tot USING (g) GROUP BY g""",
)
def met_calibration_error(spark, sf):
    prefix = reliability.probability_prefix(long_scores(spark, sf), groups=GROUPS)
    return reliability.expected_calibration_error(prefix, groups=GROUPS).select(*GROUPS, r6(F.col("ece")).alias("ece"))


@query(
    "met_reliability_curve",
    f"""WITH {SCORES_SQL}, {_bins_sql(15, 'model')} SELECT g AS model, bin::INTEGER AS bin, {s6('predicted')} AS predicted, {s6('observed')} AS observed, n::BIGINT AS count
        FROM bins WHERE m >= 3""",
)
def met_reliability_curve(spark, sf):
    curve = reliability.reliability_curve(reliability.probability_prefix(long_scores(spark, sf), groups=["model"]), groups=["model"])
    return curve.select("model", "bin", r6(F.col("predicted")).alias("predicted"), r6(F.col("observed")).alias("observed"), "count")


@query(
    "met_calibration_report",
    f"""WITH {WIDE_SQL}, scores AS (SELECT 'x' AS split, y, 'raw' AS model, a AS score FROM wide UNION ALL SELECT 'x', y, 'calibrated', b FROM wide),
        {AUC_SQL.format(g='model', t='scores')}, {_bins_sql(20, 'model')}, tot AS (SELECT g, sum(n) AS t FROM bins GROUP BY 1),
        ece AS (SELECT g AS model, sum(n / t::DOUBLE * abs(predicted - observed)) AS ece FROM bins JOIN tot USING (g) GROUP BY g),
        br AS (SELECT model, avg((score - y) * (score - y)) AS brier FROM scores GROUP BY 1), m AS (SELECT * FROM auc JOIN ece USING (model) JOIN br USING (model))
        SELECT 'pair' AS model, {', '.join(f"{s6(f'''max({c}) FILTER (WHERE model = '{v}')''')} AS {c}_{v}" for c in ('brier', 'ece', 'auroc') for v in ('raw', 'calibrated'))} FROM m""",
)
def met_calibration_report(spark, sf):
    rows = wide_scores(spark, sf).select(F.lit("pair").alias("model"), "a", "b", "y")
    found = evaluation.calibration_report(rows, "a", "b")
    return found.select("model", *[r6(F.col(c)).alias(c) for c in found.columns if c != "model"])


@query(
    "met_evaluate",
    f"""{_sweep_sql(200)}, bt AS (SELECT model, split, threshold, utility FROM swept QUALIFY row_number() OVER (PARTITION BY model, split ORDER BY round(utility, 12) DESC, threshold) = 1),
        {_AUC}, {_AP}, k AS (SELECT model, split, threshold, avg((score >= threshold)::INTEGER) AS alert_rate,
          count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND y = 0) AS fp,
          sum(y) AS p, avg((score - y) * (score - y)) AS brier FROM scores JOIN bt USING (model, split) GROUP BY 1, 2, 3)
        SELECT model, split, {s6('auroc')} AS auroc, {s6('auprc')} AS auprc, {s6('coalesce(bt.utility, 0)')} AS utility, {s6('k.threshold')} AS threshold,
          {s6('alert_rate')} AS alert_rate, {s6('tp / nullif(p, 0)::DOUBLE')} AS sensitivity, {s6('tp / nullif(tp + fp, 0)::DOUBLE')} AS precision, {s6('brier')} AS brier
        FROM k JOIN bt USING (model, split) JOIN auc USING (model, split) JOIN ap USING (model, split)""",
)
def met_evaluate(spark, sf):
    found = evaluation.evaluate(weighted(spark, sf)).drop("ece")
    return found.select(*GROUPS, *[r6(F.col(c)).alias(c) for c in found.columns if c not in GROUPS])


# --- alert timing -----------------------------------------------------------------------
TIMING_SQL = """timing AS (SELECT model, entity, max(y) = 1 AS septic, count(*) AS stay_hours, (min(CASE WHEN y = 1 THEN idx END) + 6)::DOUBLE AS onset_hour,
  min(CASE WHEN score >= 0.4 THEN idx END)::DOUBLE AS first_alert_hour, count(*) FILTER (WHERE score >= 0.4) > 0 AS alerted,
  count(*) FILTER (WHERE score >= 0.4) AS n_alert_hours,
  (min(CASE WHEN y = 1 THEN idx END) + 6 - min(CASE WHEN score >= 0.4 THEN idx END))::DOUBLE AS lead_time_hours FROM scores GROUP BY 1, 2)"""


def timing(spark, sf):
    return alerts.alert_timing(long_scores(spark, sf), F.col("score") >= 0.4, groups=["model"])


@query("met_alert_timing", f"WITH {SCORES_SQL}, {TIMING_SQL} SELECT * FROM timing")
def met_alert_timing(spark, sf):
    return timing(spark, sf)


@query(
    "met_lead_time_summary",
    f"""WITH {SCORES_SQL}, {TIMING_SQL}, c AS (SELECT *, septic AND coalesce(lead_time_hours > 0, false) AS caught FROM timing)
        SELECT model, count(*) FILTER (WHERE septic) AS septic_admissions, count(*) FILTER (WHERE NOT septic) AS control_admissions,
        count(*) FILTER (WHERE caught) AS detected_before_onset, {s6('count(*) FILTER (WHERE caught) / count(*) FILTER (WHERE septic)::DOUBLE')} AS detection_rate,
        count(*) FILTER (WHERE caught AND lead_time_hours <= 48) AS detected_within_48h,
        count(*) FILTER (WHERE NOT septic AND alerted) AS control_admissions_with_any_alert,
        {s6('avg(alerted::INTEGER) FILTER (WHERE NOT septic)')} AS false_alarm_rate_per_admission,
        {s6('avg(n_alert_hours) FILTER (WHERE NOT septic)')} AS alert_hours_per_control_admission,
        {s6('count(*) FILTER (WHERE NOT septic AND alerted) / count(*) FILTER (WHERE caught)::DOUBLE')} AS false_alarms_per_true_detection,
        quantile_cont(lead_time_hours, 0.5) FILTER (WHERE caught) AS median_lead_time_h,
        quantile_cont(lead_time_hours, 0.75) FILTER (WHERE caught) - quantile_cont(lead_time_hours, 0.25) FILTER (WHERE caught) AS iqr_lead_time_h
        FROM c GROUP BY 1""",
)
def met_lead_time_summary(spark, sf):
    found = alerts.lead_time_summary(timing(spark, sf), ["model"])
    rates = ("detection_rate", "false_alarm_rate_per_admission", "alert_hours_per_control_admission", "false_alarms_per_true_detection")
    return found.withColumns({c: r6(F.col(c)) for c in rates})


@query(
    "met_lead_time_histogram",
    f"""WITH {SCORES_SQL}, {TIMING_SQL}, l AS (SELECT model, least(lead_time_hours, 48) AS lead FROM timing WHERE lead_time_hours > 0), m AS (SELECT DISTINCT model FROM timing),
        e AS (SELECT i, i * 2.0::DOUBLE AS low, (i + 1) * 2.0::DOUBLE AS high FROM (SELECT unnest(range(0, 24)) AS i))
        SELECT m.model, low AS lead_time_low, high AS lead_time_high, count(lead) AS admissions FROM m CROSS JOIN e LEFT JOIN l ON l.model = m.model AND lead >= low AND (lead < high OR (i = 23 AND lead = high)) GROUP BY 1, 2, 3""",
)
def met_lead_time_histogram(spark, sf):
    return alerts.lead_time_histogram(timing(spark, sf), groups=["model"])


_WRAP, _GOLDEN = "18446744073709551616::UHUGEINT", "11400714819323198485::UHUGEINT"


def _mixed(name: str, start: str, number: str) -> str:
    """``name``: the 64-bit hash of a start and a number, as columns of one SELECT."""
    wide = lambda x, shift, factor: f"CAST(CAST(xor({x}, {x} >> {shift}) AS UHUGEINT) * {factor}::UHUGEINT % {_WRAP} AS UBIGINT)"
    return f"""CAST((CAST({start} AS UHUGEINT) + CAST({number} + 1 AS UHUGEINT) * {_GOLDEN}) % {_WRAP} AS UBIGINT) AS {name}_0,
      {wide(f'{name}_0', 30, '13787848793156543929')} AS {name}_1, {wide(f'{name}_1', 27, '10723151780598845931')} AS {name}_2, xor({name}_2, {name}_2 >> 31) AS {name}"""


#: How often each of 400 replicates draws each entity, with the library's hashes.
DRAWN_SQL = f"""known AS (SELECT DISTINCT model, CAST(entity AS VARCHAR) AS entity FROM scores WHERE score IS NOT NULL AND y IS NOT NULL),
ranked AS (SELECT model, entity, row_number() OVER (PARTITION BY model ORDER BY md5(entity || ':0'), entity) - 1 AS rank, count(*) OVER (PARTITION BY model) AS n FROM known),
begun AS (SELECT model, n, b, {_mixed('s', '0', 'b')} FROM (SELECT DISTINCT model, n FROM ranked), range(400) t(b)),
over_buckets AS (SELECT model, n, b, s, {_mixed('t', 's', '0')} FROM begun),
fell AS (SELECT model, n, b, s, CAST(v % CAST(n AS UBIGINT) AS BIGINT) // 1024 AS bucket, count(*) AS m
  FROM (SELECT model, n, b, s, {_mixed('v', 't', 'i')} FROM (SELECT model, n, b, s, t, unnest(range(n)) AS i FROM over_buckets)) GROUP BY ALL),
nodes AS (SELECT *, {_mixed('t', 's', '(bucket + 1)')}, least(1024, n - bucket * 1024) AS size FROM fell),
drawn AS (SELECT model, b, bucket * 1024 + CAST(v % CAST(size AS UBIGINT) AS BIGINT) AS rank, count(*) AS times
  FROM (SELECT model, b, bucket, size, {_mixed('v', 't', 'j')} FROM (SELECT model, b, bucket, size, t, unnest(range(m)) AS j FROM nodes)) GROUP BY ALL),
weighed AS (SELECT r.model, d.b, r.entity, d.times FROM drawn d JOIN ranked r USING (model, rank)),
counted AS (SELECT model, CAST(entity AS VARCHAR) AS entity, score, y, count(*) AS k FROM scores WHERE score IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
by_score AS (SELECT c.model, w.b, c.score, sum(c.k * w.times * c.y) AS pos, sum(c.k * w.times * (1 - c.y)) AS neg
  FROM counted c JOIN weighed w USING (model, entity) GROUP BY ALL)"""
_REPLICATE_SQL = {
    "auroc": """SELECT model, b, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS value
      FROM (SELECT *, sum(neg) OVER (PARTITION BY model, b ORDER BY score) - neg AS below FROM by_score) GROUP BY model, b""",
    "auprc": """SELECT model, b, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * CASE WHEN up > 0 THEN hits / up ELSE 0 END) / CAST(sum(pos) AS DOUBLE) END AS value
      FROM (SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS hits, CAST(sum(pos + neg) OVER w AS DOUBLE) AS up FROM by_score WINDOW w AS (PARTITION BY model, b ORDER BY score DESC)) GROUP BY model, b""",
}
_POINT_SQL = {
    "auroc": "sum(pos * (below + neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))",
    "auprc": "sum(pos * CAST(all_pos - hits_below AS DOUBLE) / (all_n - n_below)) / CAST(sum(pos) AS DOUBLE)",
}


def _interval_sql(metric: str) -> str:
    return f"""WITH {SCORES_SQL}, {DRAWN_SQL}, replicates AS ({_REPLICATE_SQL[metric]}),
      singles AS (SELECT model, score, sum(k * y) AS pos, sum(k * (1 - y)) AS neg FROM counted GROUP BY ALL),
      placed AS (SELECT *, sum(neg) OVER w - neg AS below, sum(pos) OVER w - pos AS hits_below, sum(pos + neg) OVER w - pos - neg AS n_below,
        sum(pos) OVER (PARTITION BY model) AS all_pos, sum(pos + neg) OVER (PARTITION BY model) AS all_n FROM singles WINDOW w AS (PARTITION BY model ORDER BY score)),
      points AS (SELECT model, {_POINT_SQL[metric]} AS point FROM placed GROUP BY model)
      SELECT model, {s6('point')} AS point, {s6('quantile_cont(value, 0.025)')} AS ci_low, {s6('quantile_cont(value, 0.975)')} AS ci_high, count(value) AS replicates
      FROM replicates JOIN points USING (model) GROUP BY model, point"""


def _bootstrapped(spark, sf, metric):
    found = bootstrap.cluster_bootstrap_ci(long_scores(spark, sf), metric=metric, groups=["model"])
    return found.select("model", *[r6(F.col(c)).alias(c) for c in ("point", "ci_low", "ci_high")], "replicates")


@query("met_bootstrap_auroc", _interval_sql("auroc"))
def met_bootstrap_auroc(spark, sf):
    return _bootstrapped(spark, sf, "auroc")


@query("met_bootstrap_auprc", _interval_sql("auprc"))
def met_bootstrap_auprc(spark, sf):
    return _bootstrapped(spark, sf, "auprc")


@query("met_bootstrap_replicates", f"WITH {SCORES_SQL}, {DRAWN_SQL}, replicates AS ({_REPLICATE_SQL['auroc']}) SELECT model, CAST(b AS INTEGER) AS b, {s6('value')} AS value FROM replicates")
def met_bootstrap_replicates(spark, sf):
    """Every replicate's AUROC of every model."""
    return bootstrap.replicates(long_scores(spark, sf), groups=["model"]).select("model", F.col("b").cast("int").alias("b"), r6(F.col("value")).alias("value"))


# --- blending ---------------------------------------------------------------------------
_NORM = lambda c: f"((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) - 0.5::DOUBLE) / count(*) OVER ()"


@query("ml_rank_normalise", f"WITH {SCORES_SQL} SELECT model, entity, idx, {s6('((rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0::DOUBLE) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY model)')} AS rank_score FROM scores")
def ml_rank_normalise(spark, sf):
    ranked = rank_normalise(long_scores(spark, sf), "score", ["model"], "rank_score")
    return ranked.select("model", "entity", "idx", r6(F.col("rank_score")).alias("rank_score"))


WEIGHTS = {"a": 0.6, "b": 0.3, "rule": 0.1}
BLEND_SQL = f"""blended AS (SELECT entity, idx, y, {s6(' + '.join(f'{w}::DOUBLE * {_NORM(m)}' for m, w in WEIGHTS.items()))} AS score FROM wide)"""


@query("ml_blend", f"WITH {WIDE_SQL}, {BLEND_SQL} SELECT entity, idx, score FROM blended")
def ml_blend(spark, sf):
    mixed = blend(wide_scores(spark, sf), list(MODELS), WEIGHTS, "score")
    return mixed.select("entity", "idx", r6(F.col("score")).alias("score"))


def _candidates_sql(candidates: str, points: int) -> str:
    """The best utility of candidates (g, wa, wb, wr: whole weights) over whole-number ranks."""
    return f"""WITH {WEIGHTS_SQL}, rows_of AS (SELECT w.a, w.b, w.rule, s.y, s.u_pos - s.u_neg AS delta FROM wide w JOIN weighted s USING (entity, idx) WHERE s.model = 'a'),
      ranked AS (SELECT {', '.join(f'2 * (rank() OVER (ORDER BY {m}) - 1) + count(*) OVER (PARTITION BY {m}) AS r_{m}' for m in ('a', 'b', 'rule'))}, y, delta FROM rows_of),
      tuples AS (SELECT r_a, r_b, r_rule, count(*) AS n, sum(delta) AS delta, sum(greatest(delta, 0)) AS best FROM ranked GROUP BY ALL),
      candidates AS ({candidates}),
      per AS (SELECT g, wa * r_a + wb * r_b + wr * r_rule AS score, sum(n) AS n, sum(delta) AS delta, sum(best) AS best FROM tuples, candidates GROUP BY ALL),
      placed AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY score) AS upto, sum(n) OVER (PARTITION BY g) AS n_all, sum(best) OVER (PARTITION BY g) AS best_all,
        sum(delta) OVER (PARTITION BY g ORDER BY score DESC) AS delta_above FROM per),
      asked AS (SELECT g, n_all, j, (n_all - 1) * j // {points - 1} AS rn FROM (SELECT DISTINCT g, CAST(n_all AS BIGINT) AS n_all FROM placed), range({points}) t(j)),
      lows AS (SELECT a.*, p.score AS lo FROM asked a ASOF JOIN placed p ON a.g = p.g AND a.rn + 1 <= p.upto),
      grid AS (SELECT l.g, l.n_all, l.lo + (p.score - l.lo) * ((((l.n_all - 1) * l.j) % {points - 1}) / {points - 1}.0::DOUBLE) AS threshold
        FROM lows l ASOF JOIN placed p ON l.g = p.g AND least(l.rn + 1, l.n_all - 1) + 1 <= p.upto),
      swept AS (SELECT t.g, t.n_all, t.threshold, p.delta_above / nullif(p.best_all, 0) AS utility FROM (SELECT DISTINCT * FROM grid) t ASOF JOIN placed p ON t.g = p.g AND t.threshold <= p.score),
      found AS (SELECT g, threshold / (2.0::DOUBLE * n_all * greatest(wa + wb + wr, 1)) AS threshold, utility FROM swept JOIN candidates USING (g) WHERE utility IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(utility, 12) DESC, swept.threshold) = 1)"""


_GRID = "SELECT printf('%.6f,%.6f,%.6f', x / 10.0::DOUBLE, y / 10.0::DOUBLE, (10 - x - y) / 10.0::DOUBLE) AS g, x AS wa, y AS wb, 10 - x - y AS wr FROM range(11) s(x), range(11) t(y) WHERE x + y <= 10"


@query(
    "ml_optimise_weights",
    f"""{_candidates_sql(_GRID, 120)} SELECT g AS candidate, wa / 10.0::DOUBLE AS a, wb / 10.0::DOUBLE AS b, wr / 10.0::DOUBLE AS rule, {s6('utility')} AS utility, {s6('threshold')} AS threshold
        FROM found JOIN candidates USING (g)""",
)
def ml_optimise_weights(spark, sf):
    found = optimise_weights(utility.utility_weights(wide_scores(spark, sf)), list(MODELS))
    return found.withColumns({c: r6(F.col(c)) for c in ("utility", "threshold")})


_MEMBERS = """VALUES ('full', 6, 3, 1), ('alone:a', 1, 0, 0), ('alone:b', 0, 1, 0), ('alone:rule', 0, 0, 1),
  ('without:a', 0, 3, 1), ('without:b', 6, 0, 1), ('without:rule', 6, 3, 0)"""


@query(
    "ml_contribution_table",
    f"""{_candidates_sql(f"SELECT * FROM ({_MEMBERS}) t(g, wa, wb, wr)", 200)} SELECT m.model, m.weight, {s6('x.utility')} AS utility_alone, {s6('o.utility')} AS utility_without,
        {s6('f.utility - o.utility')} AS marginal_contribution
        FROM (VALUES ('a', 0.6::DOUBLE), ('b', 0.3::DOUBLE), ('rule', 0.1::DOUBLE)) m(model, weight) JOIN found x ON x.g = 'alone:' || m.model JOIN found o ON o.g = 'without:' || m.model, found f WHERE f.g = 'full'""",
)
def ml_contribution_table(spark, sf):
    found = contribution_table(utility.utility_weights(wide_scores(spark, sf)), list(MODELS), WEIGHTS)
    return found.withColumns({c: r6(F.col(c)) for c in ("utility_alone", "utility_without", "marginal_contribution")})
