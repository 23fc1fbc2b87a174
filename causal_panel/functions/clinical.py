"""Bedside scores as plain column expressions.

Each function maps ``get(name) -> Column`` (carried-forward channels and static
covariates) to an ordered dict of named columns; nothing here scans or shuffles.
Thresholds and bin edges are fixed clinical values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .scalar import absent, indicator, right_closed_bin, safe_div, total

Getter = Callable[[str], Column]


def sirs_criteria(get: Getter) -> dict[str, Column]:
    temp, hr, resp, paco2, wbc = (get(n) for n in ("Temp", "HR", "Resp", "PaCO2", "WBC"))
    # NULL OR TRUE is TRUE in SQL, so a half-measured criterion still fires.
    flags = {
        "sirs_temp": indicator((temp > 38.0) | (temp < 36.0)),
        "sirs_hr": indicator(hr > 90),
        "sirs_resp": indicator((resp > 20) | (paco2 < 32)),
        "sirs_wbc": indicator((wbc > 12) | (wbc < 4)),
    }
    unmeasured = [absent(temp), absent(hr), absent(F.coalesce(resp, paco2)), absent(wbc)]
    return {**flags, "sirs_score": total(list(flags.values())), "sirs_unmeasured": total(unmeasured)}


def qsofa(get: Getter) -> dict[str, Column]:
    resp, sbp = indicator(get("Resp") >= 22), indicator(get("SBP") <= 100)
    return {"qsofa_resp": resp, "qsofa_sbp": sbp, "qsofa_score": resp + sbp}


def organ_dysfunction(get: Getter) -> dict[str, Column]:
    scores = {
        "sofa_coag": right_closed_bin(get("Platelets"), [20, 50, 100, 150], [4.0, 3.0, 2.0, 1.0, 0.0]),
        "sofa_liver": right_closed_bin(get("Bilirubin_total"), [1.2, 2.0, 6.0, 12.0], [0.0, 1.0, 2.0, 3.0, 4.0]),
        "sofa_cardio": right_closed_bin(get("MAP"), [70], [1.0, 0.0]),
        "sofa_renal": right_closed_bin(get("Creatinine"), [1.2, 2.0, 3.5, 5.0], [0.0, 1.0, 2.0, 3.0, 4.0]),
    }
    parts = list(scores.values())
    partial = F.when(
        F.coalesce(*parts).isNotNull(), total([F.coalesce(p, F.lit(0.0)) for p in parts])
    )
    return {"sofa_resp": safe_div(get("SaO2"), get("FiO2")), **scores, "sofa_partial": partial}


def hemodynamics(get: Getter) -> dict[str, Column]:
    hr, sbp, mean_bp = get("HR"), get("SBP"), get("MAP")
    shock = safe_div(hr, sbp)
    return {
        "shock_index": shock,
        "modified_shock_index": safe_div(hr, mean_bp),
        "pulse_pressure": sbp - get("DBP"),
        "age_shock_index": shock * get("Age"),
        "rate_pressure_product": hr * sbp / F.lit(1000.0),
        "hypotensive": indicator(mean_bp < 65),
        "tachycardic": indicator(hr > 100),
        "hypoxic": indicator(get("O2Sat") < 92),
    }


def metabolic(get: Getter) -> dict[str, Column]:
    lactate = get("Lactate")
    # 7.35 has no exact binary form, so the comparison is made at the precision
    # channels are stored in: a stored 7.35 is not below the threshold.
    acidotic = get("pH").cast("float") < F.lit(7.35).cast("float")
    return {
        "bun_creatinine": safe_div(get("BUN"), get("Creatinine")),
        "anion_gap": F.lit(140.0) - get("Chloride") - get("HCO3"),
        "lactate_high": indicator(lactate > 2.0),
        "lactate_shock": indicator(lactate > 4.0),
        "acidotic": indicator(acidotic),
        "hgb_hct_ratio": safe_div(get("Hgb"), get("Hct")),
        "temp_hr_coupling": get("HR") - F.lit(10.0) * (get("Temp") - F.lit(37.0)),
    }


def administrative(get: Getter) -> dict[str, Column]:
    stay, waited, age = get("ICULOS"), get("HospAdmTime"), get("Age")
    return {
        "iculos": stay.cast("double"),
        "log_iculos": F.log1p(stay.cast("double")),
        "hosp_adm_time": waited.cast("double"),
        "ward_before_icu": indicator(waited < -6),
        "age": age.cast("double"),
        "age_over_65": indicator(age > 65),
        "gender": get("Gender").cast("double"),
        "unit_micu": F.coalesce(get("Unit1").cast("double"), F.lit(0.0)),
        "unit_sicu": F.coalesce(get("Unit2").cast("double"), F.lit(0.0)),
        "unit_unknown": absent(get("Unit1")),
    }


FAMILIES = (sirs_criteria, qsofa, organ_dysfunction, hemodynamics, metabolic, administrative)


def build_clinical(get: Getter) -> dict[str, Column]:
    """All 40 domain columns of one row."""
    merged: dict[str, Column] = {}
    for family in FAMILIES:
        merged.update(family(get))
    return merged


def clinical_rule_baseline(get: Getter) -> Column:
    """Unlearned reference score over ``qsofa_score``, ``sirs_score``, ``lactate_high``."""
    zero = F.lit(0.0)
    return (
        F.coalesce(get("qsofa_score"), zero) / F.lit(2.0) * F.lit(0.5)
        + F.coalesce(get("sirs_score"), zero) / F.lit(4.0) * F.lit(0.35)
        + F.coalesce(get("lactate_high"), zero) * F.lit(0.15)
    )
