"""Sources, panel building, audits and sinks."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from causal_panel.operators.timeline import index_rows
from causal_panel.sources.ingest import read_panel, refresh_panel
from causal_panel.sources.panels import content_digest, ingest_audit, read_psv_panel, union_all, with_hour
from causal_panel.sources.tables import as_json, load_predictions, scan, stage_table, write_csv, write_predictions
from causal_panel.session import shared_folder

from . import query
from .inputs import (
    CHANNELS, DENSE_SQL, LOCF_SQL, MODELS, PANEL_SQL, SCORES_SQL, SPEC, dense, derive_panel, long_scores, panel, r6, s6, table,
)

_CH = ", ".join(CHANNELS)


@query("src_densify", f"WITH {DENSE_SQL} SELECT entity, idx, epoch(h)::BIGINT AS at, {_CH} FROM dense")
def src_densify(spark, sf):
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', h)").cast("bigint")
    return dense(spark, sf).select("entity", "idx", at.alias("at"), *CHANNELS)


@query("src_build_panel", f"WITH {PANEL_SQL} SELECT entity, idx, y, site, acctbal, {_CH} FROM panel")
def src_build_panel(spark, sf):
    return derive_panel(spark, sf).select("entity", "idx", "y", "site", "acctbal", *CHANNELS)


@query(
    "src_index_rows",
    """SELECT user_id AS entity, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS idx
       FROM events""",
)
def src_index_rows(spark, sf):
    from dataclasses import replace

    spec = replace(SPEC, order="event_id")
    events = table(spark, sf, "events").select(F.col("user_id").alias("entity"), "event_id")
    return index_rows(events, spec, block=4096)


@query(
    "src_ingest_audit",
    f"""WITH {PANEL_SQL}, e AS (SELECT site, entity, count(*) AS n, max(y) AS y FROM panel GROUP BY 1, 2)
        SELECT site, sum(n)::BIGINT AS hours, count(*) AS entities, sum(y)::BIGINT AS positive_entities,
               {s6('avg(y)')} AS positive_rate FROM e GROUP BY 1""",
)
def src_ingest_audit(spark, sf):
    return ingest_audit(panel(spark, sf), SPEC).withColumn("positive_rate", r6(F.col("positive_rate")))


@query("src_column_scan", "SELECT DISTINCT o_custkey FROM orders")
def src_column_scan(spark, sf):
    return scan(spark, f"{sf}/orders.parquet", ["o_custkey"]).distinct()


@query(
    "src_stage_cache",
    f"WITH {PANEL_SQL} SELECT site, count(*) AS n, sum(y)::BIGINT AS positives FROM panel GROUP BY 1",
)
def src_stage_cache(spark, sf):
    path = f"{shared_folder(spark)}/stage-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    build = lambda: panel(spark, sf).select("entity", "idx", "y", "site")
    stage_table(spark, path, build, partition_by=("site",))
    again = stage_table(spark, path, lambda: (_ for _ in ()).throw(AssertionError("stage was rebuilt")), partition_by=("site",))
    return again.groupBy(F.col("site").cast("string").alias("site")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("positives"))


@query(
    "src_prediction_sink",
    f"""WITH {SCORES_SQL} SELECT model, split, count(*) AS n, sum(y)::BIGINT AS positives,
        {s6('avg(score::FLOAT::DOUBLE)', 4)} AS mean_score FROM scores WHERE model = 'a' GROUP BY 1, 2""",
)
def src_prediction_sink(spark, sf):
    import uuid

    path = f"{shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    write_predictions(long_scores(spark, sf).withColumnRenamed("idx", "hour"), path)
    assert load_predictions(spark, path, "missing") is None
    stored = load_predictions(spark, path, "a")
    return stored.groupBy("model", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("positives"),
        r6(F.avg(F.col("score").cast("double")), 4).alias("mean_score"),
    )


@query(
    "src_csv_sink",
    f"WITH {PANEL_SQL} SELECT site, count(*) AS n FROM panel GROUP BY 1",
)
def src_csv_sink(spark, sf):
    import uuid

    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    write_csv(panel(spark, sf).groupBy("site").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.option("header", True).schema("site string, n bigint").csv(path)


@query(
    "src_json_rows",
    f"""WITH {PANEL_SQL}, t AS (SELECT site, count(*) AS n FROM panel GROUP BY 1)
        SELECT '{{"site":"' || site || '","n":' || n || '}}' AS json FROM t""",
)
def src_json_rows(spark, sf):
    return as_json(panel(spark, sf).groupBy("site").agg(F.count(F.lit(1)).alias("n")))


@query(
    "src_psv_round_trip",
    f"""WITH {PANEL_SQL} SELECT 'p' || entity AS entity, idx AS hour, y, click::FLOAT::DOUBLE AS click, error::FLOAT::DOUBLE AS error
        FROM panel""",
)
def src_psv_round_trip(spark, sf):
    """Panel rows written as pipe-separated files, one per entity, and read back."""
    spec, path = _psv_spec(site=None), f"{shared_folder(spark)}/psv-{uuid.uuid4().hex}"
    _write_psv(panel(spark, sf), path)
    rows = with_hour(read_psv_panel(spark, path, spec, glob="*.csv", entity_pattern=ENTITY_FOLDER), spec, "clock")
    return _as_checked(rows)


ENTITY_FOLDER = r"/entity=([^/]*)/"


def _psv_spec(site):
    return replace(SPEC, entity="entity", order="hour", labs=("error",), vitals=("click",), statics=("clock",), site=site)


def _write_psv(rows, path):
    """One pipe-separated file per entity, in a folder of its own."""
    cells = rows.select(F.concat(F.lit("p"), F.col("entity")).alias("entity"), "click", "error", (F.col("idx") + 1).alias("clock"), "y")
    (
        cells.repartition("entity").sortWithinPartitions("entity", "clock")
        .write.mode("append").partitionBy("entity").option("header", True).option("sep", "|").option("nullValue", "NaN")
        .option("emptyValue", "NaN").csv(path)
    )


def _as_checked(rows, *more):
    return rows.select(
        *more, "entity", "hour", F.col("y").cast("int").alias("y"), F.col("click").cast("double").alias("click"), F.col("error").cast("double").alias("error")
    )


@query(
    "src_incremental_panel",
    f"""WITH {PANEL_SQL} SELECT p.site, 'p' || p.entity AS entity, idx AS hour, y, click::FLOAT::DOUBLE AS click, error::FLOAT::DOUBLE AS error, CASE WHEN p.entity % 3 = 0 THEN 1 WHEN p.entity % 3 = 1 THEN 2 ELSE 3 END AS run
        FROM panel p""",
)
def src_incremental_panel(spark, sf):
    """Files of a third of the entities at a time, taken up by one run each; every run reads its own files only."""
    spec, root = _psv_spec(site="site"), f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    sources, out, runs = {site: f"{root}/{site}" for site in ("A", "B")}, f"{root}/panel", None
    rows = panel(spark, sf)
    for run in range(3):
        for site, path in sources.items():
            _write_psv(rows.where((F.col("site") == site) & (F.col("entity") % 3 == run)), path)
        changes = refresh_panel(spark, sources, spec, out, "*.csv", ENTITY_FOLDER, "clock")
        read = changes.select("site", "entity", F.lit(run + 1).alias("run"))
        runs = read if runs is None else runs.unionByName(read)
    return _as_checked(read_panel(spark, out, spec).join(runs, ["site", "entity"]), "site", "run")


@query("src_content_digest")
def src_content_digest(spark, sf):
    return content_digest(spark, sf, "*.parquet").select("files", "bytes", "digest")


@query(
    "set_union_all",
    f"WITH {PANEL_SQL} SELECT site, entity, count(*) AS n FROM panel GROUP BY 1, 2",
)
def set_union_all(spark, sf):
    p = panel(spark, sf)
    both = union_all([p.where(F.col("site") == "A"), p.where(F.col("site") == "B")])
    return both.groupBy("site", "entity").agg(F.count(F.lit(1)).alias("n"))
