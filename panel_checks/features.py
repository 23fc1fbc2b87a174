"""Causal windows and row-local clinical columns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from causal_panel.functions import clinical, scalar
from causal_panel.operators import windows

from . import query
from .inputs import (
    CHANNELS, LOCF_SQL, PANEL_SQL, RUNNING, SNAPSHOT_SQL, SPEC, panel, r6, s6, snapshot, span_hours,
)


def _block(spark, sf, *blocks, **options):
    options.setdefault("longest", span_hours(spark, sf))
    return windows.build_features(panel(spark, sf), SPEC, blocks=blocks, dtype="double", **options)


def _features(df, digits=6):
    names = [c for c in df.columns if c not in (*SPEC.id_columns, SPEC.label)]
    return df.select("entity", "idx", *[r6(F.col(c), digits).alias(c) for c in names])


LOCF = ", ".join(f"{c}_locf" for c in CHANNELS)


@query("win_locf", f"WITH {LOCF_SQL} SELECT entity, idx, {LOCF} FROM filled")
def win_locf(spark, sf):
    return _block(spark, sf, "locf").select("entity", "idx", *[f"{c}_locf" for c in CHANNELS])


@query("win_locf_split_runs", f"WITH {LOCF_SQL} SELECT entity, idx, {LOCF} FROM filled")
def win_locf_split_runs(spark, sf):
    """The same carry-forward with every entity cut into runs of 100 rows."""
    return _block(spark, sf, "locf", longest=10**9, chunk=100).select("entity", "idx", *[f"{c}_locf" for c in CHANNELS])


_SEEN = lambda c: f"max(CASE WHEN {c} IS NOT NULL THEN idx END) OVER {RUNNING}"
RECENCY_SQL = ", ".join(f"(idx - {_SEEN(c)})::DOUBLE AS {c}_hours_since" for c in CHANNELS)


@query("win_recency", f"WITH {PANEL_SQL} SELECT entity, idx, {RECENCY_SQL} FROM panel")
def win_recency(spark, sf):
    return _features(_block(spark, sf, "recency"))


INTENSITY_SQL = ", ".join(
    f"(count({c}) OVER {RUNNING})::DOUBLE AS {c}_n_obs, {s6(f'(count({c}) OVER {RUNNING}) / (idx + 1)::DOUBLE')} AS {c}_obs_rate"
    for c in CHANNELS
)


@query("win_intensity", f"WITH {PANEL_SQL} SELECT entity, idx, {INTENSITY_SQL} FROM panel")
def win_intensity(spark, sf):
    return _features(_block(spark, sf, "intensity"))


DEV_SQL = ", ".join(
    s6(f"{c}_locf - sum({c}_locf) OVER {RUNNING} / (idx + 1)", 4) + f" AS {c}_dev" for c in CHANNELS
)


@query("win_deviation", f"WITH {LOCF_SQL} SELECT entity, idx, {DEV_SQL} FROM filled")
def win_deviation(spark, sf):
    return _features(_block(spark, sf, "deviation"), 4)


@query("win_deviation_split_runs", f"WITH {LOCF_SQL} SELECT entity, idx, {DEV_SQL} FROM filled")
def win_deviation_split_runs(spark, sf):
    return _features(_block(spark, sf, "deviation", longest=10**9, chunk=64), 4)


@query(
    "win_deviation_observed",
    f"""WITH {LOCF_SQL} SELECT entity, idx, {', '.join(s6(f'{c}_locf - sum({c}_locf) OVER {RUNNING} / count({c}_locf) OVER {RUNNING}', 4) + f' AS {c}_dev' for c in CHANNELS)} FROM filled""",
)
def win_deviation_observed(spark, sf):
    return _features(_block(spark, sf, "deviation", denominator="observed"), 4)


def _rolling_sql() -> str:
    out = []
    for rows, stats in ((6, ("avg", "min", "max", "stddev_samp")), (24, ("avg", "stddev_samp"))):
        frame = f"(PARTITION BY entity ORDER BY idx ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
        for how in stats:
            name = {"avg": "mean", "stddev_samp": "std"}.get(how, how)
            for c in SPEC.rolling_channels:
                # Whole hundredths: the sample variance from exact integer sums.
                value = f"{how}({c}_locf) OVER {frame}"
                if how == "stddev_samp":
                    n, s, q = (f"{f}({e}) OVER {frame}" for f, e in (("count", f"{c}_locf"), ("sum", f"{c}_locf"), ("sum", f"{c}_locf * {c}_locf")))
                    value = f"CASE WHEN {n} > 1 THEN sqrt(({n} * {q} - {s} * {s}) / ({n} * ({n} - 1))) END"
                out.append(s6(f"CASE WHEN idx >= {rows - 1} THEN {value} END", 3) + f" AS {c}_{name}{rows}")
    for rows in (6, 12):
        for c in SPEC.rolling_channels:
            out.append(s6(f"({c}_locf - lag({c}_locf, {rows}) OVER (PARTITION BY entity ORDER BY idx)) / {rows}.0::DOUBLE", 3) + f" AS {c}_slope{rows}")
    return ", ".join(out)


@query("win_rolling", f"WITH {LOCF_SQL} SELECT entity, idx, {_rolling_sql()} FROM filled")
def win_rolling(spark, sf):
    return _features(_block(spark, sf, "rolling"), 3)


@query("win_rolling_split_runs", f"WITH {LOCF_SQL} SELECT entity, idx, {_rolling_sql()} FROM filled")
def win_rolling_split_runs(spark, sf):
    return _features(_block(spark, sf, "rolling", longest=10**9, chunk=48), 3)


_SEEN_COUNT = lambda names: " + ".join(f"({c} IS NOT NULL)::INTEGER" for c in names)
MISSING_SQL = f"""(SELECT *, ({_SEEN_COUNT(SPEC.vitals)}) AS nv, ({_SEEN_COUNT(SPEC.labs)}) AS nl, ({_SEEN_COUNT(SPEC.sparse_labs)}) AS ns FROM panel)"""


@query(
    "win_missing",
    f"""WITH {PANEL_SQL} SELECT entity, idx, nv::DOUBLE AS n_vitals_this_hour, nl::DOUBLE AS n_labs_this_hour,
        (nl > 0)::INTEGER::DOUBLE AS any_lab_this_hour, ns::DOUBLE AS n_sparse_labs_this_hour,
        (sum(nl) OVER {RUNNING})::DOUBLE AS cum_labs, {s6(f'(sum(nl) OVER {RUNNING}) / (idx + 1)::DOUBLE')} AS lab_order_rate,
        (idx - max(CASE WHEN nl > 0 THEN idx END) OVER {RUNNING})::DOUBLE AS hours_since_any_lab FROM {MISSING_SQL}""",
)
def win_missing(spark, sf):
    return _features(_block(spark, sf, "missing"))


_AHEAD = "(PARTITION BY entity ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(
    "win_bidirectional_fill",
    f"""WITH {LOCF_SQL} SELECT entity, idx, {', '.join(f'coalesce({c}_locf, first_value({c} IGNORE NULLS) OVER {_AHEAD}) AS {c}' for c in CHANNELS)} FROM filled""",
)
def win_bidirectional_fill(spark, sf):
    return windows.bidirectional_fill(panel(spark, sf), SPEC, span_hours(spark, sf)).select("entity", "idx", *CHANNELS)


@query(
    "win_build_features",
    f"""WITH {LOCF_SQL}, built AS (SELECT entity, site, y, {', '.join(f'{c}_locf' for c in CHANNELS)}, {RECENCY_SQL}, {INTENSITY_SQL}, {DEV_SQL} FROM filled)
        SELECT entity, site, max(y) AS y, count(*) AS n,
        {', '.join(f'{s6(f"avg({n})", 3)} AS {n}' for c in CHANNELS for n in (f'{c}_locf', f'{c}_hours_since', f'{c}_n_obs', f'{c}_obs_rate', f'{c}_dev'))}
        FROM built GROUP BY 1, 2""",
)
def win_build_features(spark, sf):
    built = _block(spark, sf, "locf", "recency", "intensity", "deviation", "rolling", "missing")
    names = [n for c in CHANNELS for n in (f"{c}_locf", f"{c}_hours_since", f"{c}_n_obs", f"{c}_obs_rate", f"{c}_dev")]
    rounded = built.withColumns({f"{c}_dev": r6(F.col(f"{c}_dev"), 4) for c in CHANNELS} | {f"{c}_obs_rate": r6(F.col(f"{c}_obs_rate")) for c in CHANNELS})
    return rounded.groupBy("entity", "site").agg(
        F.max("y").alias("y"), F.count(F.lit(1)).alias("n"), *[r6(F.avg(n), 3).alias(n) for n in names]
    )


@query("win_block_columns")
def win_block_columns(spark, sf):
    """Columns per block against the built table's schema."""
    blocks = [b for b in windows.BLOCKS if b != "clinical"]
    membership = windows.block_columns(SPEC, blocks)
    built = _block(spark, sf, *blocks)
    features = [c for c in built.columns if c not in (*SPEC.id_columns, SPEC.label)]
    windows.assert_partition(membership, features)
    rates = built.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in features])
    long = rates.unpivot([], features, "feature", "filled")
    owner = F.create_map(*[F.lit(v) for b, names in membership.items() for n in names for v in (n, b)])
    return long.groupBy(owner[F.col("feature")].alias("block")).agg(
        F.count(F.lit(1)).alias("n_features"), r6(F.avg("filled")).alias("mean_filled")
    )


CUTS = (1, 5, 13, 24, 47, 300)


@query("exp_no_lookahead", f"WITH {PANEL_SQL} SELECT cut, count(*) AS compared, 0::BIGINT AS changed FROM panel, (SELECT unnest([{', '.join(map(str, CUTS))}]) AS cut) WHERE idx < cut GROUP BY cut")
def exp_no_lookahead(spark, sf):
    """Per cut: hours before it, and those whose features change when the hours from it on are taken away (none may)."""
    p = panel(spark, sf)
    blocks = [b for b in windows.BLOCKS if b != "clinical"]  # the panel has no clinical channels
    names = windows.feature_columns(SPEC, blocks)
    digest = F.xxhash64(*[r6(F.col(n)) for n in names])
    whole = _block(spark, sf, *blocks).where(F.col("idx") < max(CUTS)).select("entity", "idx", digest.alias("whole"))
    # Each cut is a panel of its own, told apart by the entity's name.
    hours = p.where(F.col("idx") < max(CUTS)).withColumn("cut", F.explode(F.array(*[F.lit(c) for c in CUTS]))).where("idx < cut")
    named = hours.withColumns({"real": F.col("entity"), "entity": F.concat_ws("@", "entity", "cut")})
    spec = replace(SPEC, carried_ids=(*SPEC.carried_ids, "real", "cut"))
    cut = windows.build_features(named, spec, blocks=blocks, dtype="double").select(F.col("real").alias("entity"), "cut", "idx", digest.alias("part"))
    both = cut.join(whole, ["entity", "idx"], "full")
    return both.groupBy("cut").agg(F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("whole").eqNullSafe(F.col("part"))).alias("changed")).where("cut IS NOT NULL")


# --- row-local ------------------------------------------------------------------
IDS = ("l_orderkey", "l_linenumber")


def _local(spark, sf, columns, digits=6):
    get = lambda n: F.col(n)
    return snapshot(spark, sf).select(*IDS, *[r6(c.cast("double"), digits).alias(n) for n, c in columns(get).items()])


def _flag(cond):
    return f"coalesce({cond}, false)::INTEGER::DOUBLE"


SIRS = {
    "sirs_temp": _flag("Temp > 38 OR Temp < 36"), "sirs_hr": _flag("HR > 90"),
    "sirs_resp": _flag("Resp > 20 OR PaCO2 < 32"), "sirs_wbc": _flag("WBC > 12 OR WBC < 4"),
}
SIRS["sirs_score"] = " + ".join(list(SIRS.values()))
SIRS["sirs_unmeasured"] = "((Temp IS NULL)::INTEGER + (HR IS NULL)::INTEGER + (Resp IS NULL AND PaCO2 IS NULL)::INTEGER + (WBC IS NULL)::INTEGER)::DOUBLE"
QSOFA = {"qsofa_resp": _flag("Resp >= 22"), "qsofa_sbp": _flag("SBP <= 100")}
QSOFA["qsofa_score"] = f"{QSOFA['qsofa_resp']} + {QSOFA['qsofa_sbp']}"


def _cut(c, edges, labels):
    arms = " ".join(f"WHEN {c} <= {e}::DOUBLE THEN {l}" for e, l in zip(edges, labels))
    return f"(CASE WHEN {c} IS NULL THEN NULL {arms} ELSE {labels[-1]} END)::DOUBLE"


ORGAN = {
    "sofa_resp": "CASE WHEN FiO2 <> 0 THEN SaO2 / FiO2 END",
    "sofa_coag": _cut("Platelets", (20, 50, 100, 150), (4, 3, 2, 1, 0)),
    "sofa_liver": _cut("Bilirubin_total", (1.2, 2.0, 6.0, 12.0), (0, 1, 2, 3, 4)),
    "sofa_cardio": _cut("MAP", (70,), (1, 0)),
    "sofa_renal": _cut("Creatinine", (1.2, 2.0, 3.5, 5.0), (0, 1, 2, 3, 4)),
}
_PARTS = [ORGAN[k] for k in ("sofa_coag", "sofa_liver", "sofa_cardio", "sofa_renal")]
ORGAN["sofa_partial"] = f"CASE WHEN coalesce({', '.join(_PARTS)}) IS NOT NULL THEN {' + '.join(f'coalesce({p}, 0)' for p in _PARTS)} END"
HEMO = {
    "shock_index": "HR / SBP", "modified_shock_index": "HR / MAP", "pulse_pressure": "SBP - DBP",
    "age_shock_index": "HR / SBP * Age", "rate_pressure_product": "HR * SBP / 1000.0::DOUBLE",
    "hypotensive": _flag("MAP < 65"), "tachycardic": _flag("HR > 100"), "hypoxic": _flag("O2Sat < 92"),
}
METAB = {
    "bun_creatinine": "BUN / Creatinine", "anion_gap": "140.0::DOUBLE - Chloride - HCO3",
    "lactate_high": _flag("Lactate > 2"), "lactate_shock": _flag("Lactate > 4"), "acidotic": _flag("pH::FLOAT < 7.35::FLOAT"),
    "hgb_hct_ratio": "Hgb / Hct", "temp_hr_coupling": "HR - 10.0::DOUBLE * (Temp - 37.0::DOUBLE)",
}
ADMIN = {
    "iculos": "ICULOS::DOUBLE", "log_iculos": "ln(1.0::DOUBLE + ICULOS)", "hosp_adm_time": "HospAdmTime::DOUBLE",
    "ward_before_icu": _flag("HospAdmTime < -6"), "age": "Age::DOUBLE", "age_over_65": _flag("Age > 65"),
    "gender": "Gender::DOUBLE", "unit_micu": "coalesce(Unit1, 0)::DOUBLE", "unit_sicu": "coalesce(Unit2, 0)::DOUBLE",
    "unit_unknown": "(Unit1 IS NULL)::INTEGER::DOUBLE",
}


def _local_sql(columns):
    return f"WITH {SNAPSHOT_SQL} SELECT {', '.join(IDS)}, {', '.join(f'{s6(e)} AS {n}' for n, e in columns.items())} FROM snap"


@query("prj_safe_div", f"WITH {SNAPSHOT_SQL} SELECT {', '.join(IDS)}, {s6(ORGAN['sofa_resp'])} AS ratio FROM snap")
def prj_safe_div(spark, sf):
    return snapshot(spark, sf).select(*IDS, r6(scalar.safe_div("SaO2", "FiO2")).alias("ratio"))


@query("prj_sirs", _local_sql(SIRS))
def prj_sirs(spark, sf):
    return _local(spark, sf, clinical.sirs_criteria)


@query("prj_qsofa", _local_sql(QSOFA))
def prj_qsofa(spark, sf):
    return _local(spark, sf, clinical.qsofa)


@query("prj_organ_dysfunction", _local_sql(ORGAN))
def prj_organ_dysfunction(spark, sf):
    return _local(spark, sf, clinical.organ_dysfunction)


@query("prj_hemodynamics", _local_sql(HEMO))
def prj_hemodynamics(spark, sf):
    return _local(spark, sf, clinical.hemodynamics)


@query("prj_metabolic", _local_sql(METAB))
def prj_metabolic(spark, sf):
    return _local(spark, sf, clinical.metabolic)


@query("prj_administrative", _local_sql(ADMIN))
def prj_administrative(spark, sf):
    return _local(spark, sf, clinical.administrative)


# The clinical block reads carried-forward channels: here an order is the stay
# and its line numbers are the hours.
_STAY = "(PARTITION BY l_orderkey ORDER BY hour, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)"
CLINICAL = {**SIRS, **QSOFA, **ORGAN, **HEMO, **METAB, **ADMIN}
SNAP_SPEC = replace(
    SPEC, entity="l_orderkey", order="line", index="idx", label="y", site=None,
    vitals=("HR", "O2Sat", "Temp", "SBP", "MAP", "DBP", "Resp"),
    labs=("PaCO2", "WBC", "Platelets", "Bilirubin_total", "Creatinine", "Lactate", "SaO2", "FiO2", "BUN", "Chloride", "HCO3", "pH", "Hgb", "Hct"),
    statics=("Age", "Gender", "Unit1", "Unit2", "HospAdmTime", "ICULOS"), carried_ids=("l_linenumber",), clinical=True,
)
_SNAP_CHANNELS = SNAP_SPEC.channels
# Lines of one number are told apart by all their columns; those that agree in all of them are alike.
_LINE_ORDER = ", ".join(("l_linenumber", *(f"{c} NULLS FIRST" for c in _SNAP_CHANNELS), *(f"{c} NULLS FIRST" for c in SNAP_SPEC.statics)))
_STAY_ROWS = f"""stay AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS line FROM snap),
held AS (SELECT * REPLACE ({', '.join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY line ROWS UNBOUNDED PRECEDING) AS {c}" for c in _SNAP_CHANNELS)}) FROM stay)"""


@query(
    "prj_build_clinical",
    f"""WITH {SNAPSHOT_SQL}, {_STAY_ROWS} SELECT {', '.join(IDS)}, {', '.join(f'{s6(e)} AS {n}' for n, e in CLINICAL.items())} FROM held""",
)
def prj_build_clinical(spark, sf):
    rows = snapshot(spark, sf, by_order=True).withColumn("line", F.expr(f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER})"))
    built = windows.build_features(rows, SNAP_SPEC, blocks=("clinical",), dtype="double")
    return built.select(*IDS, *[r6(F.col(n)).alias(n) for n in CLINICAL])


_RULE = f"0.5::DOUBLE * (({QSOFA['qsofa_score']}) / 2.0::DOUBLE) + 0.35::DOUBLE * (({SIRS['sirs_score']}) / 4.0::DOUBLE) + 0.15::DOUBLE * ({METAB['lactate_high']})"


@query("prj_clinical_rule", f"WITH {SNAPSHOT_SQL} SELECT {', '.join(IDS)}, {s6(_RULE)} AS score FROM snap")
def prj_clinical_rule(spark, sf):
    scored = {**clinical.qsofa(F.col), **clinical.sirs_criteria(F.col), **clinical.metabolic(F.col)}
    return snapshot(spark, sf).select(*IDS, r6(clinical.clinical_rule_baseline(scored.__getitem__)).alias("score"))


@query(
    "prj_finite_float",
    f"""WITH {SNAPSHOT_SQL} SELECT {', '.join(IDS)}, {s6("CASE WHEN FiO2 <> 0 THEN (SaO2 / FiO2)::FLOAT::DOUBLE END", 3)} AS ratio,
        (FiO2 IS NULL OR SaO2 IS NULL OR FiO2 = 0) AS is_missing FROM snap""",
)
def prj_finite_float(spark, sf):
    """A quotient with infinities and NaN in it, cleaned and stored in single precision."""
    raw = F.when(F.col("FiO2") == 0, F.lit(float("inf"))).otherwise(F.try_divide("SaO2", "FiO2"))
    clean = scalar.finite_or_null(raw).cast("float")
    return snapshot(spark, sf).select(*IDS, r6(clean.cast("double"), 3).alias("ratio"), clean.isNull().alias("is_missing"))


@query(
    "prj_right_closed_bin",
    f"WITH {SNAPSHOT_SQL} SELECT {', '.join(IDS)}, {_cut('Hct', (10, 25, 40), (0, 1, 2, 3))}::INTEGER AS bin FROM snap",
)
def prj_right_closed_bin(spark, sf):
    return snapshot(spark, sf).select(*IDS, scalar.right_closed_bin("Hct", [10, 25, 40], [0, 1, 2, 3]).alias("bin"))


_P = "least(greatest(l_discount * 10, 1e-7), 1 - 1e-7)"


@query("prj_logit", f"SELECT {', '.join(IDS)}, {s6(f'ln({_P} / (1.0::DOUBLE - {_P}))', 5)} AS logit FROM lineitem")
def prj_logit(spark, sf):
    from .inputs import table

    return table(spark, sf, "lineitem").select(*IDS, r6(scalar.logit(F.col("l_discount") * 10), 5).alias("logit"))


@query(
    "win_running_best",
    """SELECT o_orderkey, o_custkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS best
       FROM orders""",
)
def win_running_best(spark, sf):
    from .inputs import table

    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return windows.running_best(orders, "o_orderkey", "o_totalprice", "best", by="o_custkey").drop("o_totalprice")
