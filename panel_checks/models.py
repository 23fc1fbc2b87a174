"""Models as Spark jobs over the whole feature table."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from causal_panel.operators import linear, sequences, trees
from causal_panel.operators.calibrators import Calibrator
from causal_panel.operators.prep import fit_standardiser
from causal_panel.operators.windows import build_features, feature_columns
from causal_panel.plans.experiments import selection_gap
from causal_panel.session import shared_folder
from causal_panel.sources.artifacts import load_model, save_model

from . import query
from .inputs import CHANNELS, LOCF_SQL, SPEC, once, order_rows, panel, r6, s6, span_hours, wide_scores, ORDER_FEATURES, ORDERS_SQL, WIDE_SQL
from .tables import SEED, SPLIT_SQL, assignment, quantile_sql
from .inputs import PANEL_SQL

BLOCKS = ("locf", "recency", "intensity", "deviation", "missing")
def feature_names() -> list[str]:
    return feature_columns(SPEC, BLOCKS)



def feature_table(spark, sf):
    """Features of every panel row with its split."""
    def build():
        rows = build_features(panel(spark, sf), SPEC, blocks=BLOCKS, longest=span_hours(spark, sf))
        return rows.join(assignment(spark, sf), "entity")

    return once(spark, sf, "features", build)


def train(spark, sf):
    return feature_table(spark, sf).where("split = 'train'")


IMPUTE = ("qty", "price", "discount", "tax")
_GAP = ", ".join(f"CASE WHEN (entity + {k}) % 5 <> 0 THEN {c} END AS {c}" for k, c in enumerate(IMPUTE))
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS f, {c} AS v FROM gap" for c in IMPUTE)
_SCALED = ", ".join(
    s6(f"(coalesce({c}, (SELECT q FROM med WHERE f = '{c}')) - (SELECT m FROM mom WHERE f = '{c}')) / (SELECT s FROM mom WHERE f = '{c}')", 4) + f" AS {c}" for c in IMPUTE
)


@query(
    "ml_impute_standardise",
    f"""WITH {ORDERS_SQL}, gap AS (SELECT entity, {_GAP} FROM order_rows), long AS ({_LONG}), {quantile_sql('long', 'v', 3, 'f')},
        med AS (SELECT f, q FROM qp WHERE j = 1), mom AS (SELECT f, avg(coalesce(v, q)) AS m, stddev_pop(coalesce(v, q)) AS s FROM long JOIN med USING (f) GROUP BY 1)
        SELECT entity, {_SCALED} FROM gap""",
)
def ml_impute_standardise(spark, sf):
    rows = order_rows(spark, sf).selectExpr("entity", *[f"CASE WHEN (entity + {k}) % 5 <> 0 THEN {c} END AS {c}" for k, c in enumerate(IMPUTE)])
    fitted = fit_standardiser(rows, IMPUTE)
    x = vector_to_array("features")
    return fitted.vector(rows).select("entity", *[r6(x[i], 4).alias(c) for i, c in enumerate(IMPUTE)])


@query("ml_logistic")
def ml_logistic(spark, sf):
    model = linear.fit_logistic(train(spark, sf), feature_names(), "y", max_iter=50)
    scored = model.predict(feature_table(spark, sf))
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score"), 4).alias("mean_score"))


@query("ml_sparse_signature")
def ml_sparse_signature(spark, sf):
    return linear.sparse_signature(train(spark, sf), feature_names(), "y", target_features=8, max_iter=40)


INFERENCE = ("error_locf", "click_n_obs", "view_n_obs", "error_hours_since", "n_labs_this_hour")


@query("ml_inference_table")
def ml_inference_table(spark, sf):
    return linear.inference_table(train(spark, sf), INFERENCE, "y")


def boosted(spark, sf):
    rows = feature_table(spark, sf)
    return trees.fit_boosted(
        rows.where("split = 'train'"), feature_names(), "y", {"max_depth": 3, "learning_rate": 0.3}, rounds=4, validation=rows.where("split = 'val'"), max_bins=32
    )


@query("ml_boosted")
def ml_boosted(spark, sf):
    model = boosted(spark, sf)
    scored = model.predict(feature_table(spark, sf))
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score"), 4).alias("mean_score"), F.lit(model.rounds).alias("rounds"))


@query(
    "ml_missing_aware_inputs",
    f"""WITH {LOCF_SQL}, {SPLIT_SQL}, counted AS (SELECT entity, idx, error_locf::DOUBLE AS v, (count(error) OVER (PARTITION BY entity ORDER BY idx ROWS UNBOUNDED PRECEDING))::DOUBLE AS n FROM filled),
        rows_of AS (SELECT c.* FROM counted c JOIN assigned a USING (entity) WHERE a.split = 'train'),
        ends AS (SELECT min(v) - greatest(1, max(v) - min(v)) AS low, max(v) + greatest(1, max(v) - min(v)) AS high FROM rows_of)
        SELECT entity, idx, {s6('coalesce(v, low)', 4)} AS error_locf_low, {s6('coalesce(v, high)', 4)} AS error_locf_high, {s6('n', 4)} AS error_n_obs_low FROM rows_of, ends""",
)
def ml_missing_aware_inputs(spark, sf):
    rows = train(spark, sf)
    encoder = trees.fit_missing_aware(rows, ("error_locf", "error_n_obs"))
    columns = {f"{f}_{s}": encoder.column(f, s) for f, s in encoder.inputs}
    return rows.select("entity", "idx", *[r6(c, 4).alias(n) for n, c in columns.items()])


@query("ml_out_of_fold_utility")
def ml_out_of_fold_utility(spark, sf):
    value, rounds = trees.out_of_fold_utility(train(spark, sf), feature_names(), "entity", "idx", "y", {"learning_rate": 0.3}, rounds=2, folds=2)
    return spark.createDataFrame([(float(value), int(rounds))], "utility double, rounds int")


@query("ml_tune")
def ml_tune(spark, sf):
    _, _, trials = trees.tune(train(spark, sf), feature_names(), "entity", "idx", "y", trials=2, rounds=2, folds=2, seed=SEED)
    return trials.drop("duration")


@query("ml_importance")
def ml_importance(spark, sf):
    return trees.importance_table(boosted(spark, sf), spark)


@query("ml_permutation_importance")
def ml_permutation_importance(spark, sf):
    return trees.permutation_importance(boosted(spark, sf), feature_table(spark, sf).where("split = 'val'"), ["entity", "idx"], "y")


@query(
    "ml_isotonic",
    f"""WITH {WIDE_SQL}, points AS (SELECT least(greatest(a, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM wide WHERE a IS NOT NULL AND y IS NOT NULL GROUP BY 1),
      placed AS (SELECT *, row_number() OVER (ORDER BY p) AS i, sum(pos) OVER (ORDER BY p) AS pos_upto, sum(n) OVER (ORDER BY p) AS n_upto FROM points),
      least_means AS (SELECT f.i AS a, t.i AS b, min((t.pos_upto - f.pos_upto + f.pos) / (t.n_upto - f.n_upto + f.n)) OVER (PARTITION BY f.i ORDER BY t.i DESC) AS m FROM placed f JOIN placed t ON f.i <= t.i),
      fitted AS (SELECT b AS i, max(m) AS fit FROM least_means GROUP BY b)
      SELECT w.a, count(*) AS n, {s6('max(f.fit)')} AS calibrated FROM wide w JOIN placed p ON p.p = least(greatest(w.a, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) JOIN fitted f USING (i) GROUP BY w.a""",
)
def ml_isotonic(spark, sf):
    rows = wide_scores(spark, sf)
    fitted = Calibrator("isotonic").fit(rows, "a")
    return fitted.transform(rows, "a").groupBy("a").agg(F.count(F.lit(1)).alias("n"), r6(F.max("calibrated")).alias("calibrated"))


@query("ml_platt")
def ml_platt(spark, sf):
    rows = wide_scores(spark, sf)
    fitted = Calibrator("platt").fit(rows, "a")
    return fitted.transform(rows, "a").groupBy("a").agg(F.count(F.lit(1)).alias("n"), r6(F.max("calibrated"), 4).alias("calibrated"))


@query(
    "ml_model_store",
    f"WITH {PANEL_SQL}, {SPLIT_SQL} SELECT model, true AS scored, true AS same, count(*) AS n FROM panel JOIN assigned USING (entity), (VALUES ('logistic'), ('boosted')) t(model) GROUP BY model",
)
def ml_model_store(spark, sf):
    """Saved and reloaded models give the same scores on every row."""
    folder = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    rows, out = feature_table(spark, sf), None
    for name, model in (("logistic", linear.fit_logistic(train(spark, sf), feature_names(), "y", max_iter=20)), ("boosted", boosted(spark, sf))):
        save_model(spark, folder, name, model)
        again = load_model(spark, folder, name)
        both = again.predict(model.predict(rows, "before"), "after")
        part = both.select(F.lit(name).alias("model"), F.col("before").isNotNull().alias("scored"), (F.col("before") == F.col("after")).alias("same"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("model", "scored", "same").agg(F.count(F.lit(1)).alias("n"))


_V = [f"{c}_locf" for c in CHANNELS]
_ENC = ", ".join(f"(coalesce(({c} - (SELECT avg({c}) FROM filled)) / (SELECT stddev_pop({c}) FROM filled), 0))" for c in _V)
_MASK = ", ".join(f"({c} IS NOT NULL)::INTEGER::DOUBLE" for c in _V)


@query(
    "ml_sequence_encoder",
    f"""WITH {LOCF_SQL}, e AS (SELECT entity, idx, y, {', '.join(f"(coalesce(({c} - (SELECT avg({c}) FROM filled)) / (SELECT stddev_pop({c}) FROM filled), 0)) AS v{i}, ({c} IS NOT NULL)::INTEGER AS m{i}" for i, c in enumerate(_V))} FROM filled)
        SELECT entity, idx // 200 AS segment, count(*)::INTEGER AS n, sum(y)::DOUBLE AS positives, {', '.join(f"{s6(f'sum(v{i})', 3)} AS v{i}, sum(m{i})::DOUBLE AS m{i}" for i in range(len(_V)))}
        FROM e GROUP BY 1, 2""",
)
def ml_sequence_encoder(spark, sf):
    """Totals over each encoded array; segments of 200 hours."""
    rows = build_features(panel(spark, sf), SPEC, blocks=("locf",), longest=span_hours(spark, sf), dtype="double")
    encoder = sequences.fit_sequence_encoder(rows, _V, ())
    arrays = encoder.transform(rows, "entity", "idx", "y", longest=200)
    add = lambda i: F.aggregate("x", F.lit(0.0), lambda acc, s: acc + s[i])
    k = len(_V)
    return arrays.select(
        "entity", "segment", "n", F.aggregate("y", F.lit(0.0), lambda a, v: a + v).alias("positives"),
        *[r6(add(i), 3).alias(f"v{i}") for i in range(k)], *[add(k + i).alias(f"m{i}") for i in range(k)],
    )


@query(
    "ml_make_batches",
    f"""WITH {PANEL_SQL}, s AS (SELECT entity, 0 AS segment, count(*) AS n, sum(y) AS pos FROM panel GROUP BY 1),
        k AS (SELECT *, row_number() OVER (ORDER BY n, md5(entity::VARCHAR || ':0:0')) - 1 AS p FROM s)
        SELECT (p // 16)::BIGINT AS batch, (p % 16)::INTEGER AS slot, entity, n::INTEGER AS n, max(n) OVER (PARTITION BY p // 16)::INTEGER AS steps,
               (n - pos + 5 * pos)::DOUBLE AS weight FROM k""",
)
def ml_make_batches(spark, sf):
    rows = build_features(panel(spark, sf), SPEC, blocks=("locf",), longest=span_hours(spark, sf), dtype="double")
    encoder = sequences.fit_sequence_encoder(rows, _V, ())
    batches = sequences.make_batches(encoder.transform(rows, "entity", "idx", "y", span_hours(spark, sf)), "entity", encoder.n_features, batch_size=16, positive_weight=5.0)
    whole = F.raise_error(F.lit("arrays are not padded to the batch"))
    checked = F.when((F.size("x") == F.col("steps")) & (F.size("y") == F.col("steps")) & (F.size("w") == F.col("steps")), F.col("steps")).otherwise(whole)
    return batches.select("batch", "slot", "entity", "n", checked.cast("int").alias("steps"), F.aggregate("w", F.lit(0.0), lambda a, v: a + v).alias("weight"))


@query(
    "exp_selection_gap",
    """WITH t AS (SELECT o_orderkey AS number, o_totalprice AS value, CASE WHEN o_orderstatus = 'P' THEN 'PRUNED' ELSE 'COMPLETE' END AS state FROM orders)
       SELECT count(*) AS trials, count(*) FILTER (WHERE state = 'PRUNED') AS pruned, max(value) AS best_cv_utility,
       (SELECT max(o_totalprice) FROM orders WHERE o_orderstatus = 'O') AS test_utility,
       max(value) - (SELECT max(o_totalprice) FROM orders WHERE o_orderstatus = 'O') AS optimism FROM t""",
)
def exp_selection_gap(spark, sf):
    from .inputs import table

    orders = table(spark, sf, "orders")
    trials = orders.select(F.col("o_orderkey").alias("number"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderstatus") == "P", "PRUNED").otherwise("COMPLETE").alias("state"))
    results = orders.where("o_orderstatus = 'O'").select(F.lit("m").alias("model"), F.lit("test").alias("split"), F.col("o_totalprice").alias("utility"))
    return selection_gap(trials, results, "m")
