"""Inputs derived from the driver's tables: the Spark form and the same thing in SQL.

P  hourly panel from events, customer, nation. Channel values are whole
   hundredths, so sums are exact in both engines whatever the order.
S  three scores per panel hour, one of them heavily tied.
L  row-local clinical snapshot from lineitem.
O  one row per order with numeric features and a label.

P and S are written once per session to the shared folder (the library's stage
tables) and read back by every query that starts from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from causal_panel import PanelSpec
from causal_panel.functions.scalar import total
from causal_panel.operators.windows import build_features
from causal_panel.session import staged
from causal_panel.sources.panels import densify

CHANNELS = ("click", "view", "error", "purchase", "signup")
SPEC = PanelSpec(
    entity="entity", order="h", index="idx", label="y", site="site",
    vitals=("click", "view"), labs=("error", "purchase", "signup"),
    sparse_labs=("error", "signup"), rolling_labs=("error", "purchase"),
    carried_ids=("idx",),
)
ALARM = 20_000
INTENSITY_CHANNELS = ("error", "signup", "purchase")
_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def r6(c: Column, digits: int = 6) -> Column:
    """Round the same way in both engines: one multiplication, one floor."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def s6(expression: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"(floor(({expression})::DOUBLE * {scale} + 0.5::DOUBLE) / {scale})"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def once(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """The stage table ``name`` for this session and input folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGED:
        _STAGED[key] = staged(build(), name)
    return _STAGED[key]


# --- P ------------------------------------------------------------------------
def dense(spark: SparkSession, sf: str, attach=None) -> DataFrame:
    kind, value = F.col("event_type"), F.round(F.col("value") * 100)
    return densify(
        table(spark, sf, "events").withColumnRenamed("user_id", "entity"), "entity", "ts",
        {c: F.when(kind == c, value) for c in CHANNELS}, attach=attach,
    )


def derive_panel(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    people = people.select(
        F.col("c_custkey").alias("entity"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("acctbal"),
        F.when(F.col("n_regionkey") < 3, "A").otherwise("B").alias("site"),
    )

    def attach(hours: DataFrame) -> DataFrame:
        """An entity's first alarm and its attributes: alarms are in hours with records."""
        first = hours.where(F.col("error") > ALARM).groupBy("entity").agg(F.min("idx").alias("first_pos"))
        return hours.join(first, "entity", "left").join(people, "entity")

    latched = F.col("idx") >= F.greatest(F.col("first_pos") - 6, F.lit(0))
    return dense(spark, sf, attach).select(
        "entity", "h", "idx", *CHANNELS, F.coalesce(latched, F.lit(False)).cast("int").alias("y"), "acctbal", "site"
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "panel", lambda: derive_panel(spark, sf))


def span_hours(spark: SparkSession, sf: str) -> int:
    """Bound on the hours of one entity: the hours the events cover (Parquet min/max)."""
    lo, hi = table(spark, sf, "events").agg(F.min("ts"), F.max("ts")).first()
    return int((hi - lo).total_seconds() // 3600) + 2


_LATEST = ", ".join(
    f"arg_max(round(value * 100), ts) FILTER (WHERE event_type = '{c}') AS {c}" for c in CHANNELS
)
DENSE_SQL = f"""hourly AS MATERIALIZED (
  SELECT user_id AS entity, date_trunc('hour', ts) AS h, {_LATEST} FROM events GROUP BY 1, 2),
spans AS (SELECT entity, min(h) AS h0, max(h) AS h1 FROM hourly GROUP BY 1),
spine AS (SELECT entity, unnest(generate_series(h0, h1, INTERVAL 1 HOUR)) AS h FROM spans),
dense AS MATERIALIZED (
  SELECT s.entity, s.h, (row_number() OVER (PARTITION BY s.entity ORDER BY s.h) - 1)::INTEGER AS idx,
         {', '.join(CHANNELS)}
  FROM spine s LEFT JOIN hourly USING (entity, h))"""
PANEL_SQL = f"""{DENSE_SQL},
firsts AS (SELECT entity, min(idx) AS first_pos FROM dense WHERE error > {ALARM} GROUP BY 1),
panel AS MATERIALIZED (
  SELECT d.*, CASE WHEN idx >= greatest(first_pos - 6, 0) THEN 1 ELSE 0 END::INTEGER AS y,
         CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS acctbal,
         CASE WHEN n_regionkey < 3 THEN 'A' ELSE 'B' END AS site
  FROM dense d LEFT JOIN firsts USING (entity)
  JOIN customer ON c_custkey = entity JOIN nation ON n_nationkey = c_nationkey)"""
RUNNING = "(PARTITION BY entity ORDER BY idx ROWS UNBOUNDED PRECEDING)"
LOCF_SQL = f"""{PANEL_SQL},
filled AS MATERIALIZED (SELECT *, {', '.join(f"last_value({c} IGNORE NULLS) OVER {RUNNING} AS {c}_locf" for c in CHANNELS)} FROM panel)"""


# --- S ------------------------------------------------------------------------
MODELS = ("a", "b", "rule")


def derive_scores(spark: SparkSession, sf: str) -> DataFrame:
    filled = build_features(
        panel(spark, sf), SPEC, blocks=("locf",), longest=span_hours(spark, sf), dtype="double", keep=("y",)
    )
    ratio = lambda c: F.coalesce(r6(F.col(c) / (F.col(c) + F.lit(10000.0))), F.lit(0.0))
    flag = lambda c, x: F.coalesce(F.col(c) > x, F.lit(False)).cast("double")
    rule = total([F.lit(0.5) * flag("error_locf", 10000), F.lit(0.35) * flag("click_locf", 9000), F.lit(0.15) * flag("view_locf", 12000)])
    wide = filled.select("entity", "idx", "y", F.col("site").alias("split"), ratio("error_locf").alias("a"), ratio("click_locf").alias("b"), r6(rule).alias("rule"))
    return wide


def wide_scores(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "scores", lambda: derive_scores(spark, sf))


def long_scores(spark: SparkSession, sf: str) -> DataFrame:
    return wide_scores(spark, sf).unpivot(["split", "entity", "idx", "y"], list(MODELS), "model", "score")


WIDE_SQL = f"""{LOCF_SQL},
wide AS MATERIALIZED (SELECT entity, idx, y, site AS split,
  coalesce({s6('error_locf / (error_locf + 10000.0::DOUBLE)')}, 0) AS a,
  coalesce({s6('click_locf / (click_locf + 10000.0::DOUBLE)')}, 0) AS b,
  {s6('0.5::DOUBLE * (coalesce(error_locf > 10000, false))::INTEGER + 0.35::DOUBLE * (coalesce(click_locf > 9000, false))::INTEGER + 0.15::DOUBLE * (coalesce(view_locf > 12000, false))::INTEGER')} AS rule
  FROM filled)"""
SCORES_SQL = f"""{WIDE_SQL},
scores AS MATERIALIZED (UNPIVOT wide ON a, b, rule INTO NAME model VALUE score)"""
_DT = "(idx - (first_pos0 + 6))"
WEIGHTS_SQL = f"""{SCORES_SQL},
onset AS (SELECT entity AS oe, min(idx) AS first_pos0 FROM wide WHERE y = 1 GROUP BY 1),
weighted AS MATERIALIZED (
  SELECT s.*,
    CASE WHEN first_pos0 IS NULL THEN -0.05::DOUBLE WHEN {_DT} > 3 THEN 0
         WHEN {_DT} <= -6 THEN greatest(({_DT} + 12) / 6.0::DOUBLE, -0.05::DOUBLE)
         ELSE -({_DT} - 3) / 9.0::DOUBLE END AS u_pos,
    CASE WHEN first_pos0 IS NULL OR {_DT} > 3 OR {_DT} <= -6 THEN 0::DOUBLE
         ELSE -2 * ({_DT} + 6) / 9.0::DOUBLE END AS u_neg
  FROM scores s LEFT JOIN onset ON oe = entity)"""


# --- L ------------------------------------------------------------------------
# Channel -> (expression over lineitem, offset of its missing rows).
SNAPSHOT = {
    "HR": "40 + 2 * l_quantity", "Temp": "35 + 50 * l_tax", "SBP": "60 + 1000 * l_discount",
    "MAP": "45 + 600 * l_discount", "DBP": "40 + 400 * l_discount", "Resp": "10 + 0.4D * l_quantity",
    "O2Sat": "85 + 150 * l_discount", "PaCO2": "22.0D + 4 * l_linenumber", "WBC": "l_quantity / 3",
    "Platelets": "l_extendedprice / 250", "Bilirubin_total": "0.3D * l_quantity",
    "Creatinine": "0.12D * l_quantity", "Lactate": "60 * l_tax", "SaO2": "90 + 100 * l_discount",
    "FiO2": "l_discount * 10", "BUN": "l_quantity * 1", "Chloride": "95 + 100 * l_discount",
    "HCO3": "18.0D + l_linenumber", "pH": "7.2D + 4 * l_tax", "Hgb": "8 + 0.1D * l_quantity",
    "Hct": "l_quantity + 0",
}
STATIC = {
    "Age": "l_quantity + 40", "Gender": "l_linenumber % 2",
    "Unit1": "CASE WHEN l_orderkey % 5 <> 0 THEN CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END END",
    "Unit2": "CASE WHEN l_orderkey % 5 <> 0 THEN CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END END",
    "HospAdmTime": "-l_linenumber * 3", "ICULOS": "l_linenumber * 1",
}


def _snapshot_columns() -> list[str]:
    gaps = [
        f"CASE WHEN (l_orderkey + {k}) % 7 <> 0 THEN {e} END AS {c}" for k, (c, e) in enumerate(SNAPSHOT.items())
    ]
    return gaps + [f"{e} AS {c}" for c, e in STATIC.items()]


def snapshot(spark: SparkSession, sf: str, by_order: bool = False) -> DataFrame:
    """``by_order``: lines of an order lie together; they are moved as they are stored, before the columns are worked out."""
    lines = table(spark, sf, "lineitem")
    lines = lines.repartition("l_orderkey") if by_order else lines
    return lines.selectExpr("l_orderkey", "l_linenumber", *_snapshot_columns())


_DUCK_COLUMNS = ", ".join(c.replace("0D", "0::DOUBLE").replace("4D", "4::DOUBLE").replace("3D", "3::DOUBLE").replace("2D", "2::DOUBLE").replace("1D", "1::DOUBLE") for c in _snapshot_columns())
SNAPSHOT_SQL = f"snap AS (SELECT l_orderkey, l_linenumber, {_DUCK_COLUMNS} FROM lineitem)"


# --- O ------------------------------------------------------------------------
ORDER_FEATURES = ("qty", "price", "discount", "tax", "total")


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line rows with their order's label: money and rates in whole cents/percent."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_quantity").alias("qty"), F.round(F.col("l_extendedprice") * 100).alias("price"),
        F.round(F.col("l_discount") * 100).alias("discount"), F.round(F.col("l_tax") * 100).alias("tax"),
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.round(F.col("o_totalprice") * 100).alias("total"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
    )
    return lines.join(orders, "l_orderkey").withColumnRenamed("l_orderkey", "entity")


ORDERS_SQL = """order_rows AS (
  SELECT l_orderkey AS entity, l_quantity AS qty, round(l_extendedprice * 100) AS price,
         round(l_discount * 100) AS discount, round(l_tax * 100) AS tax,
         round(o_totalprice * 100) AS total, (o_orderstatus = 'F')::INTEGER AS y
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
SUMMARY_SQL = f"""{ORDERS_SQL},
summary AS (SELECT entity, max(y) AS y, {', '.join(f'avg({c}) AS {c}' for c in ORDER_FEATURES)} FROM order_rows GROUP BY 1)"""


# --- drift pair -----------------------------------------------------------------
DRIFT_FEATURES = ("qty", "price", "discount", "tax")


def drift_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Returned lines as reference (side 0), all others as comparison (side 1)."""
    lines = table(spark, sf, "lineitem")
    other = F.col("l_returnflag") != "R"
    return lines.select(
        other.cast("int").alias("side"),
        F.when(~other | (F.col("l_orderkey") % 10 >= 3), F.col("l_quantity")).alias("qty"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


DRIFT_SQL = """pair AS (
  SELECT (l_returnflag <> 'R')::INTEGER AS side,
         CASE WHEN l_returnflag = 'R' OR l_orderkey % 10 >= 3 THEN l_quantity END AS qty,
         l_extendedprice AS price, l_discount AS discount, l_tax AS tax
  FROM lineitem)"""
