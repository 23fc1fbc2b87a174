"""Joins, aggregates, sorts, set operations, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from causal_panel.operators import aggregates, ordered, splits

from . import query
from .inputs import (
    CHANNELS, LOCF_SQL, MODELS, PANEL_SQL, RUNNING, SCORES_SQL, SPEC, SUMMARY_SQL, WIDE_SQL,
    long_scores, order_rows, panel, r6, s6, table, wide_scores, ORDER_FEATURES, ORDERS_SQL,
)
from causal_panel.functions.scalar import total

SEED = 7


# --- joins ------------------------------------------------------------------------
@query("join_semi", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 200) GROUP BY 1")
def join_semi(spark, sf):
    roster = table(spark, sf, "events").where("event_type = 'error' AND value > 200").select(F.col("user_id").alias("o_custkey"))
    return table(spark, sf, "orders").join(roster, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("join_anti", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY 1")
def join_anti(spark, sf):
    roster = table(spark, sf, "events").select(F.col("user_id").alias("o_custkey"))
    return table(spark, sf, "orders").join(roster, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "join_equi_hours",
    f"""WITH {WIDE_SQL} SELECT entity, idx, p.click, w.a FROM panel p JOIN wide w USING (entity, idx) WHERE p.click IS NOT NULL""",
)
def join_equi_hours(spark, sf):
    measured = panel(spark, sf).where("click IS NOT NULL").select("entity", "idx", "click")
    return measured.join(wide_scores(spark, sf).select("entity", "idx", "a"), ["entity", "idx"])


@query(
    "join_side_by_side_columns",
    f"""WITH {LOCF_SQL} SELECT entity, idx, click_locf, count(click) OVER {RUNNING} AS click_n FROM filled""",
)
def join_side_by_side_columns(spark, sf):
    """Two feature blocks side by side come from one projection, not from a join."""
    from causal_panel.operators.windows import build_features
    from .inputs import span_hours

    built = build_features(panel(spark, sf), SPEC, blocks=("locf", "intensity"), longest=span_hours(spark, sf), dtype="double")
    return built.select("entity", "idx", "click_locf", F.col("click_n_obs").cast("bigint").alias("click_n"))


@query("join_align_models", f"WITH {WIDE_SQL} SELECT entity, idx, a, b, rule FROM wide")
def join_align_models(spark, sf):
    """Long predictions of several models as one row per entity and hour."""
    cells = [F.max(F.when(F.col("model") == m, F.col("score"))).alias(m) for m in MODELS]
    return long_scores(spark, sf).groupBy("entity", "idx").agg(*cells)


@query(
    "join_rows_by_thresholds",
    f"""WITH {SCORES_SQL}, t AS (SELECT unnest([0.05, 0.1, 0.25, 0.5])::DOUBLE AS threshold)
        SELECT model, threshold, count(*) FILTER (WHERE score >= threshold) AS alerts FROM scores, t GROUP BY 1, 2""",
)
def join_rows_by_thresholds(spark, sf):
    """Alerts at given thresholds without pairing rows and thresholds: each row
    counts the thresholds it reaches, and counts accumulate from the top."""
    from pyspark.sql import Window

    grid = [0.05, 0.1, 0.25, 0.5]
    reached = total([(F.col("score") >= t).cast("int") for t in grid])
    counts = long_scores(spark, sf).groupBy("model", reached.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    models = counts.select("model").distinct()
    rungs = models.select("model", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])).alias("r"))
    full = rungs.select("model", "r.k", "r.threshold").join(counts, ["model", "k"], "left")
    down = Window.partitionBy("model").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return full.select("model", "threshold", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("alerts"))


# --- aggregates -------------------------------------------------------------------
@query("agg_entity_labels", f"WITH {PANEL_SQL} SELECT entity, max(y) AS y FROM panel GROUP BY 1")
def agg_entity_labels(spark, sf):
    return splits.entity_labels(panel(spark, sf), "entity", "y")


@query(
    "agg_entity_summaries",
    f"WITH {PANEL_SQL} SELECT entity, max(y) AS y, {', '.join(f'{s6(f'avg({c})', 4)} AS {c}' for c in CHANNELS)} FROM panel GROUP BY 1",
)
def agg_entity_summaries(spark, sf):
    return aggregates.entity_summaries(panel(spark, sf), "entity", "y", CHANNELS).select("entity", "y", *[r6(F.col(c), 4).alias(c) for c in CHANNELS])


@query(
    "agg_entity_summaries_max",
    f"WITH {PANEL_SQL} SELECT entity, max(y) AS y, {', '.join(f'max({c}) AS {c}' for c in CHANNELS)} FROM panel GROUP BY 1",
)
def agg_entity_summaries_max(spark, sf):
    return aggregates.entity_summaries(panel(spark, sf), "entity", "y", CHANNELS, how="max").select("entity", "y", *CHANNELS)


@query(
    "agg_last_observed",
    f"WITH {PANEL_SQL} SELECT entity, {', '.join(f'arg_max({c}, idx) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in CHANNELS)} FROM panel GROUP BY 1",
)
def agg_last_observed(spark, sf):
    return aggregates.last_observed(panel(spark, sf), "entity", "idx", CHANNELS)


@query("agg_max_on_rows", f"WITH {PANEL_SQL} SELECT entity, idx, max(y) OVER (PARTITION BY entity) AS label FROM panel")
def agg_max_on_rows(spark, sf):
    return aggregates.with_entity_max(panel(spark, sf), "entity", "y", "label").select("entity", "idx", "label")


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {s6(f'avg({c})', 4)} AS mean, {s6(f'avg(({c} IS NULL)::INTEGER)')} AS missing FROM panel" for c in CHANNELS
)


@query("agg_column_profile", f"WITH {PANEL_SQL} {_PROFILE}")
def agg_column_profile(spark, sf):
    profile = aggregates.column_profile(panel(spark, sf), CHANNELS)
    return profile.select("feature", r6(F.col("mean"), 4).alias("mean"), r6(F.col("missing")).alias("missing"))


def quantile_sql(source: str, value: str, points: int, by: str = "", extra: str = "") -> str:
    """Interpolated quantiles at j / (points - 1), ranks in integer arithmetic."""
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    join = f"s.{by} = lo.{by} AND " if by else ""
    join_hi = f"s.{by} = hi.{by} AND " if by else ""
    return f"""qs AS MATERIALIZED (SELECT {group}{value} AS v, row_number() OVER ({part}ORDER BY {value}) - 1 AS rn, count(*) OVER ({part}) AS n
        FROM {source} WHERE {value} IS NOT NULL),
      qg AS (SELECT DISTINCT {group}n, unnest(range(0, {points})) AS j FROM qs),
      qp AS (SELECT {'s.' + by + ', ' if by else ''}s.j::INTEGER AS j,
          lo.v + (hi.v - lo.v) * (((n1 * s.j) % {points - 1}) / {points - 1}.0::DOUBLE) AS q
        FROM (SELECT *, n - 1 AS n1 FROM qg) s
        JOIN qs lo ON {join}lo.rn = (s.n1 * s.j) // {points - 1}
        JOIN qs hi ON {join_hi}hi.rn = least((s.n1 * s.j) // {points - 1} + 1, s.n1))"""


@query("agg_quantiles", f"WITH {SCORES_SQL}, {quantile_sql('scores', 'score', 200, 'model')} SELECT model, j, {s6('q')} AS q FROM qp")
def agg_quantiles(spark, sf):
    prefix = ordered.prefix_totals(long_scores(spark, sf), "score", {"n": F.lit(1)}, ["model"])
    return ordered.quantile_points(prefix, "score", 200, ["model"]).select("model", "j", r6(F.col("q")).alias("q"))


@query("agg_quantiles_lineitem", f"WITH {quantile_sql('lineitem', 'l_extendedprice', 11)} SELECT j, {s6('q', 4)} AS q FROM qp")
def agg_quantiles_lineitem(spark, sf):
    found = ordered.exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [(j, 10) for j in range(11)])
    return found.select("j", r6(F.col("q"), 4).alias("q"))


_EDGES = [1.0, 5.0, 10.0, 20.0, 35.0, 50.0]


@query(
    "agg_histogram",
    f"""WITH e AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])))}) t(bin, low, high))
        SELECT bin, low, high, count(l_quantity) AS n FROM e LEFT JOIN lineitem
        ON l_quantity >= low AND (l_quantity < high OR (bin = {len(_EDGES) - 2} AND l_quantity = high)) GROUP BY 1, 2, 3""",
)
def agg_histogram(spark, sf):
    return ordered.histogram(table(spark, sf, "lineitem"), "l_quantity", _EDGES)


_MOMENTS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {s6(f'coalesce(avg({e}), 0)', 4)} AS mean, {s6(f'coalesce(nullif(stddev_pop({e}), 0), 1)', 4)} AS std FROM panel"
    for c, e in [*[(c, c) for c in CHANNELS], ("constant", "idx * 0 + 3"), ("nothing", "CASE WHEN idx < 0 THEN 1.0 END")]
)


@query("agg_column_moments", f"WITH {PANEL_SQL} {_MOMENTS}")
def agg_column_moments(spark, sf):
    rows = panel(spark, sf).withColumns({"constant": F.col("idx") * 0 + 3, "nothing": F.when(F.col("idx") < 0, 1.0)})
    found = aggregates.column_moments(rows, [*CHANNELS, "constant", "nothing"])
    return found.select("feature", r6(F.col("mean"), 4).alias("mean"), r6(F.col("std"), 4).alias("std"))


@query(
    "agg_confusion",
    f"""WITH {SCORES_SQL} SELECT model, split, count(*) FILTER (WHERE score >= 0.25 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.25 AND y = 0) AS fp,
        count(*) FILTER (WHERE score < 0.25 AND y = 1) AS fn, count(*) FILTER (WHERE score < 0.25 AND y = 0) AS tn FROM scores GROUP BY 1, 2""",
)
def agg_confusion(spark, sf):
    return aggregates.confusion(long_scores(spark, sf), F.col("score") >= 0.25, groups=["model", "split"])


@query(
    "agg_class_ratio",
    f"WITH {PANEL_SQL} SELECT site, {s6('coalesce(count(*) FILTER (WHERE y = 0) / nullif(count(*) FILTER (WHERE y = 1), 0)::DOUBLE, 1)')} AS ratio FROM panel GROUP BY 1",
)
def agg_class_ratio(spark, sf):
    return aggregates.class_ratio(panel(spark, sf), groups=["site"]).select("site", r6(F.col("ratio")).alias("ratio"))


@query(
    "agg_wide_results",
    f"""WITH {SCORES_SQL}, r AS (SELECT model, split, {s6('avg(score)')} AS mean, max(score) AS top FROM scores GROUP BY 1, 2)
        SELECT model, max(mean) FILTER (WHERE split = 'A') AS A_mean, max(mean) FILTER (WHERE split = 'B') AS B_mean,
        max(top) FILTER (WHERE split = 'A') AS A_top, max(top) FILTER (WHERE split = 'B') AS B_top FROM r GROUP BY 1""",
)
def agg_wide_results(spark, sf):
    results = long_scores(spark, sf).groupBy("model", "split").agg(r6(F.avg("score")).alias("mean"), F.max("score").alias("top"))
    return aggregates.wide_results(results, ("mean", "top"), ("A", "B"))


# --- sorts and top-k ---------------------------------------------------------------
@query("sort_canonical", f"WITH {PANEL_SQL} SELECT row_number() OVER (ORDER BY entity, idx) AS position, entity, idx FROM panel")
def sort_canonical(spark, sf):
    """Every hour with its place in the order of entity and hour: the rows of earlier entities and the hour's own index."""
    rows = panel(spark, sf).select("entity", "idx")
    before = ordered.prefix_totals(rows, "entity", {"n": F.lit(1)}).select("entity", "n_below")
    return rows.join(before, "entity").select((F.col("n_below") + F.col("idx") + 1).alias("position"), "entity", "idx").orderBy("entity", "idx")


@query("sort_missing_last", f"WITH {SUMMARY_SQL} SELECT entity, price, row_number() OVER (ORDER BY price DESC NULLS LAST, entity) AS position FROM (SELECT entity, CASE WHEN entity % 3 <> 0 THEN price END AS price FROM summary)")
def sort_missing_last(spark, sf):
    rows = aggregates.entity_summaries(order_rows(spark, sf), "entity", "y", ["price"])
    rows = rows.select("entity", F.when(F.col("entity") % 3 != 0, F.col("price")).alias("price"))
    # Missing prices lie behind all others; prices in descending order, entities of one price in ascending order.
    return ordered.row_positions(rows, [F.col("price").desc_nulls_last(), F.col("entity").asc()]).select("entity", "price", "position")


@query("sort_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def sort_top_k(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


# --- sets ---------------------------------------------------------------------------
@query("set_union_distinct", "SELECT user_id FROM events UNION SELECT o_custkey FROM orders")
def set_union_distinct(spark, sf):
    return table(spark, sf, "events").select("user_id").union(table(spark, sf, "orders").select("o_custkey")).distinct()


@query("set_except", "SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events")
def set_except(spark, sf):
    return table(spark, sf, "orders").select("o_custkey").subtract(table(spark, sf, "events").select("user_id"))


@query("set_distinct_entities", f"WITH {PANEL_SQL} SELECT DISTINCT site, entity FROM panel")
def set_distinct_entities(spark, sf):
    return panel(spark, sf).select("site", "entity").distinct()


# --- splits -------------------------------------------------------------------------
def _hash_rank(source: str, ids: str, by: str, extra: str = "*", seed: int = SEED) -> str:
    key = " || ':' || ".join(f"{i}::VARCHAR" for i in ids.split(", "))
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {extra}, row_number() OVER ({part}ORDER BY md5({key} || ':{seed}')) - 1 AS k, count(*) OVER ({part}) AS n FROM {source}"""


SPLIT_SQL = f"""labels_e AS (SELECT site, entity, max(y) AS y FROM panel GROUP BY 1, 2),
ranked AS ({_hash_rank("(SELECT * FROM labels_e WHERE site = 'A')", "entity", "y")}),
assigned AS (SELECT entity, CASE WHEN k < (n * 30 + 100) // 200 THEN 'test' WHEN k < 2 * ((n * 30 + 100) // 200) THEN 'val' ELSE 'train' END AS split FROM ranked
  UNION ALL SELECT entity, 'external' FROM labels_e WHERE site <> 'A')"""


def assignment(spark, sf):
    return splits.make_splits(panel(spark, sf), "entity", "y", "site", "A", SEED)


@query("split_make_splits", f"WITH {PANEL_SQL}, {SPLIT_SQL} SELECT entity, split FROM assigned")
def split_make_splits(spark, sf):
    return assignment(spark, sf)


@query(
    "split_entity_split",
    f"""WITH {PANEL_SQL}, l AS (SELECT entity, max(y) AS y FROM panel GROUP BY 1), r AS ({_hash_rank('l', 'entity', 'y')})
        SELECT entity, CASE WHEN k < (n * 50 + 100) // 200 THEN 'test' ELSE 'train' END AS split FROM r""",
)
def split_entity_split(spark, sf):
    return splits.entity_split(panel(spark, sf), "entity", "y", SEED)


@query(
    "split_row_split",
    f"""WITH {PANEL_SQL}, r AS ({_hash_rank('panel', 'entity, idx', '')})
        SELECT entity, idx, CASE WHEN k < floor(n * 75 / 100) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def split_row_split(spark, sf):
    rows = panel(spark, sf).select("entity", "idx")
    return splits.row_split(rows, ["entity", "idx"], SEED)


@query(
    "split_grouped_folds",
    f"""WITH {PANEL_SQL}, l AS (SELECT entity, max(y) AS y FROM panel GROUP BY 1), r AS ({_hash_rank('l', 'entity', 'y')})
        SELECT entity, (k % 3)::INTEGER AS fold FROM r""",
)
def split_grouped_folds(spark, sf):
    return splits.grouped_folds(panel(spark, sf), "entity", "y", 3, SEED)


@query(
    "split_downsample",
    f"""WITH {PANEL_SQL}, r AS ({_hash_rank('(SELECT entity, idx, y FROM panel WHERE y = 0)', 'entity, idx', '')})
        SELECT entity, idx, y FROM panel WHERE y = 1 UNION ALL SELECT entity, idx, y FROM r WHERE k < floor(n * 20 / 100)""",
)
def split_downsample(spark, sf):
    return splits.downsample_negatives(panel(spark, sf).select("entity", "idx", "y"), "y", ["entity", "idx"], 20, SEED)


@query("split_sample_rows", f"WITH {PANEL_SQL} SELECT entity, idx FROM panel ORDER BY md5(entity::VARCHAR || ':' || idx::VARCHAR || ':{SEED}') LIMIT 1000")
def split_sample_rows(spark, sf):
    return splits.sample_rows(panel(spark, sf).select("entity", "idx"), ["entity", "idx"], 1000, SEED)


@query("split_disjoint", f"WITH {PANEL_SQL} SELECT count(DISTINCT entity) AS assigned, 0::BIGINT AS overlapping, 0::BIGINT AS missing FROM panel")
def split_disjoint(spark, sf):
    """Entities with a split, in more than one split, and in none: all are in exactly one."""
    assigned, rows = assignment(spark, sf), panel(spark, sf).select("entity").distinct()
    overlapping = splits.overlapping_entities(assigned, "entity").agg(F.count(F.lit(1)).alias("overlapping"))
    missing = rows.join(assigned, "entity", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return assigned.agg(F.countDistinct("entity").alias("assigned")).crossJoin(overlapping).crossJoin(missing)  # one row each


@query(
    "split_summary",
    f"""WITH {PANEL_SQL}, {SPLIT_SQL}, e AS (SELECT split, entity, count(*) AS n, max(y) AS m, sum(y) AS s FROM panel JOIN assigned USING (entity) GROUP BY 1, 2)
        SELECT split, sum(n)::BIGINT AS hours, count(*) AS admissions, sum(m)::BIGINT AS septic_admissions,
               {s6('avg(m)')} AS septic_admission_rate, {s6('sum(s) / sum(n)::DOUBLE')} AS positive_hour_rate FROM e GROUP BY 1""",
)
def split_summary(spark, sf):
    found = splits.split_summary(splits.with_split(panel(spark, sf), assignment(spark, sf), "entity"), "entity", "y")
    return found.withColumns({c: r6(F.col(c)) for c in ("septic_admission_rate", "positive_hour_rate")})


@query(
    "set_shared_entities",
    f"""WITH {PANEL_SQL}, r AS ({_hash_rank('panel', 'entity, idx', '')}), s AS (SELECT entity, k < floor(n * 75 / 100) AS train FROM r)
        SELECT entity FROM s WHERE train INTERSECT SELECT entity FROM s WHERE NOT train""",
)
def set_shared_entities(spark, sf):
    rows = splits.row_split(panel(spark, sf).select("entity", "idx"), ["entity", "idx"], SEED)
    return splits.shared_entities(rows.where("split = 'train'"), rows.where("split = 'test'"), "entity")


@query(
    "split_take_test",
    f"WITH {PANEL_SQL}, {SPLIT_SQL} SELECT entity, idx FROM panel WHERE entity IN (SELECT entity FROM assigned WHERE split = 'test')",
)
def split_take_test(spark, sf):
    return splits.take(panel(spark, sf), assignment(spark, sf), "entity", "test").select("entity", "idx")


# --- ranks ----------------------------------------------------------------------------
@query(
    "rank_midranks",
    f"""WITH {SCORES_SQL} SELECT model, score, count(*) AS n, {s6('min(rk) + (count(*) - 1) / 2.0::DOUBLE')} AS midrank
        FROM (SELECT model, score, rank() OVER (PARTITION BY model ORDER BY score) AS rk FROM scores) GROUP BY 1, 2""",
)
def rank_midranks(spark, sf):
    return ordered.midranks(long_scores(spark, sf), "score", ["model"]).select("model", "score", "n", r6(F.col("midrank")).alias("midrank"))


@query(
    "rank_midranks_documents",
    f"""WITH d AS (SELECT n_chars, rank() OVER (ORDER BY n_chars) AS rk FROM documents)
        SELECT n_chars, count(*) AS n, {s6('min(rk) + (count(*) - 1) / 2.0::DOUBLE')} AS midrank FROM d GROUP BY 1""",
)
def rank_midranks_documents(spark, sf):
    return ordered.midranks(table(spark, sf, "documents"), "n_chars").select("n_chars", "n", r6(F.col("midrank")).alias("midrank"))


@query(
    "rank_prefix_totals",
    """SELECT l_extendedprice, count(*) AS n, sum(count(*)) OVER w ::BIGINT - count(*) AS n_below,
       (sum(sum(l_quantity)) OVER w - sum(l_quantity))::BIGINT AS qty_below
       FROM lineitem GROUP BY 1 WINDOW w AS (ORDER BY l_extendedprice ROWS UNBOUNDED PRECEDING)""",
)
def rank_prefix_totals(spark, sf):
    prefix = ordered.prefix_totals(table(spark, sf, "lineitem"), "l_extendedprice", {"n": F.lit(1), "qty": F.col("l_quantity")})
    return prefix.select("l_extendedprice", "n", "n_below", F.col("qty_below").cast("bigint").alias("qty_below"))
