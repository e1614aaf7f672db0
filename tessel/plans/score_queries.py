"""Queries over scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import descriptors as D
from tessel.functions import scoring as S
from tessel.sources.tables import table

PROFILE = {"mw": (200.0, 500.0), "logp": (-1.0, 5.0), "tpsa": (20.0, 140.0), "hbd": (0.0, 5.0)}
WEIGHTS = {"mw": 1.0, "logp": 2.0, "tpsa": 1.0, "hbd": 0.5}
MPO = [("logp", 0.0, 5.0, "sigmoid", 2.0), ("tpsa", 20.0, 140.0, "ramp", 1.0), ("fsp3", 0.0, 0.42, "step", 1.0)]


def _rows(spark, sf_dir):
    return D.from_lineitem(table(spark, sf_dir, "lineitem"))


def _in_range():
    return S.count_true(*(v >= 1.0 for v in S.radar().values()))


def _over(columns):
    """A query over descriptors. columns() gives (column, decimals if any) by name; columns need a session, so later."""
    return lambda spark, sf_dir: _rows(spark, sf_dir).select(*D.KEYS, *(F.round(v, r[0]).alias(k) if r else v.alias(k) for k, (v, *r) in columns().items()))


QUERIES = {
    "profile_score": _over(lambda: dict(profile=(S.profile_score(PROFILE, WEIGHTS), 4))),
    "profile_breakdown": _over(lambda: dict(**{f"d_{n}": (S.desirability(F.col(n), *r), 6) for n, r in PROFILE.items()})),
    "mpo_custom": _over(lambda: dict(mpo=(S.custom_mpo(MPO), 6))),
    "cns_mpo": _over(lambda: dict(cns=(S.cns_mpo(), 6), admet_cns=(S.admet_cns(), 6))),
    "druglikeness_rules": _over(lambda: dict(**{k: (v,) for k, v in S.rule_sets().items()})),
    "consensus_score": _over(lambda: dict(consensus=(S.consensus().cast("long"),), muegge=(S.muegge_violations(F.col("heavy"), F.col("hba")).cast("long"),))),
    "esol": _over(lambda: dict(log_s=(S.esol(), 6), solubility=(S.esol_class(S.esol()),))),
    "pfi_stars": _over(lambda: dict(pfi=(S.pfi(), 6), pfi_risk=(S.banded(S.pfi(), (5, "low"), (7, "moderate"), last="high"),), stars=(S.stars().cast("long"),))),
    "abbott_skin": _over(lambda: dict(abbott=(S.abbott(),), logp=(S.consensus_logp(), 6), log_kp=(S.skin_permeation(), 6), skin=(S.banded(S.skin_permeation(), (-6, "low"), (-4, "moderate"), last="high"),))),
    "safety_rules": _over(lambda: dict(herg=(S.herg().cast("long"),), herg_risk=(F.when(S.herg() <= 1, "low").when(S.herg() == 2, "moderate").otherwise("high"),), bro5=(F.coalesce(S.beyond_five_violations(), F.lit(-1)).cast("long"),), reos=(S.reos_violations().cast("long"),))),
    "ligand_efficiency": _over(lambda: dict(**{k: (v, 6) for k, v in S.ligand_efficiency().items()})),
    "aggregator_risk": _over(lambda: {k: (v,) for k, v in S.aggregator_risk(F.pmod("hba", F.lit(4))).items()}),
    "radar_axes": _over(lambda: dict(**{k: (v, 6) for k, v in S.radar().items()}, in_range=(_in_range().cast("long"),), band=(S.radar_band(_in_range()),))),
    "boiled_egg": _over(lambda: dict(region=(S.egg_region(),))),
    "unusual_properties": _over(lambda: {n: (v,) for n, v in S.unusual().items()} | {"n_unusual": (S.count_true(*(v != "within" for v in S.unusual().values())).cast("long"),)}),
    "readiness": _over(lambda: dict(properties=(S.readiness_properties(), 4), accessibility=(S.accessibility_points(F.col("sa")), 4), stereo=(S.stereocentre_points(F.col("hba"), F.col("hbd")), 4), label=(S.labelled(S.readiness_properties() * 100 / 35),), flatness=(S.flatness(F.col("fsp3")),))),
    "proxy_efficiency": _over(lambda: dict(le=(S.proxy_efficiency()[0],), band=(S.proxy_efficiency()[1],))),
    "generative_composite": _over(lambda: dict(score=(S.composite(), 6))),
}

_D = f"WITH {D.SQL} SELECT l_orderkey, l_linenumber, "


def _des(n, low, high):
    return f"(CASE WHEN {n} BETWEEN {low} AND {high} THEN 1.0 WHEN {n} < {low} THEN greatest(0.0, 1.0 - ({low} - {n}) / {high - low}) ELSE greatest(0.0, 1.0 - ({n} - {high}) / {high - low}) END)::DOUBLE"


_LIP = "((mw > 500)::INT + (logp > 5)::INT + (hbd > 5)::INT + (hba > 10)::INT)"
_MUE = "((NOT mw BETWEEN 200 AND 600)::INT + (NOT logp BETWEEN -2 AND 5)::INT + (tpsa > 150)::INT + (rings > 7)::INT + (heavy <= 4)::INT + (hba <= 1)::INT + (rotb > 15)::INT + (hbd > 5)::INT + (hba > 10)::INT)"
_ESOL = "(0.16::DOUBLE - 0.63::DOUBLE * logp - 0.0062::DOUBLE * mw + 0.066::DOUBLE * rotb - 0.74::DOUBLE * least(1.0, 6.0::DOUBLE * arom / heavy))"
_HERG = "((logp > 3.7)::INT + (mw > 250 AND mw < 500)::INT + (tpsa < 75)::INT + basic_n::INT)"
_SKIN = "(-2.71::DOUBLE + 0.71::DOUBLE * logp - 0.0061::DOUBLE * mw)"
_AXES = {a: _des("esol" if n == "esol" else n, low, high) for a, (n, low, high) in S.RADAR_AXES.items()}
_READY = "(" + " + ".join(f"round({_des(n, lo, hi)} * {pts}, 2)" for n, (lo, hi, pts) in S.READINESS.items()) + ")"
_unit = lambda x: f"least(greatest({x}, 0.0), 1.0)"
_ell = lambda e: f"(power((tpsa - {e[0]}) / {e[1 + 1]}, 2) + power((logp - {e[1]}) / {e[3]}, 2) <= 1)"

ORACLE_SQL = {
    "profile_score": _D + "round(power(" + " * ".join(f"power({_des(n, *r)}, {WEIGHTS[n]})" for n, r in PROFILE.items()) + f", 1.0 / {sum(WEIGHTS.values())}) * 100, 4) AS profile FROM descriptors",
    "profile_breakdown": _D + ", ".join(f"round({_des(n, *r)}, 6) AS d_{n}" for n, r in PROFILE.items()) + " FROM descriptors",
    "mpo_custom": _D + f"round((2.0 / (1.0 + exp(-12.0 * ({_unit('logp / 5.0::DOUBLE')} - 0.5))) + {_unit('(tpsa - 20.0) / 120.0::DOUBLE')} + (fsp3 >= 0.42)::INT) / 4.0, 6) AS mpo FROM descriptors",
    "cns_mpo": _D
    + f"""round(CASE WHEN logp <= 1 THEN 1.0 WHEN logp >= 5 THEN 0.0 ELSE 1.0 - (logp - 1) / 4.0 END
        + CASE WHEN tpsa BETWEEN 40 AND 90 THEN 1.0 WHEN tpsa < 20 OR tpsa > 120 THEN 0.0 WHEN tpsa < 40 THEN (tpsa - 20) / 20.0 ELSE 1.0 - (tpsa - 90) / 30.0 END
        + CASE WHEN mw <= 360 THEN 1.0 WHEN mw >= 500 THEN 0.0 ELSE 1.0 - (mw - 360) / 140.0 END + greatest(0.0, 1.0 - hbd * 0.25), 6) AS cns,
      round({_unit("1.0 - (mw - 360) / 140.0")} + {_unit("1.0 - (logp - 3) / 2.0")} + {_unit("1.0 - (tpsa - 40) / 50.0")} + CASE WHEN hbd <= 3 THEN 1.0 - hbd * 0.25 ELSE 0.0 END + 1.0, 6) AS admet_cns FROM descriptors""",
    "druglikeness_rules": _D
    + f"""{_LIP} <= 1 AS lipinski, rotb <= 10 AND tpsa <= 140 AS veber,
      mw < 300 AND logp <= 3 AND hbd <= 3 AND hba <= 3 AND rotb <= 3 AND tpsa <= 60 AS ro3,
      mw BETWEEN 160 AND 480 AND logp BETWEEN -0.4 AND 5.6 AND heavy BETWEEN 20 AND 70 AND mr BETWEEN 40 AND 130 AS ghose,
      logp <= 5.88 AND tpsa <= 131.6 AS egan, mw BETWEEN 200 AND 350 AND logp BETWEEN -1 AND 3 AND rotb <= 7 AS lead,
      NOT (logp > 3 AND tpsa < 75) AS pfizer, mw <= 400 AND logp <= 4 AS gsk, mw BETWEEN 200 AND 450 AND logp BETWEEN -0.5 AND 5 AS golden_triangle FROM descriptors""",
    "consensus_score": _D
    + f"""(({_LIP} <= 1)::BIGINT + (rotb <= 10 AND tpsa <= 140)::BIGINT + (logp <= 5.88 AND tpsa <= 131.6)::BIGINT
      + (mw BETWEEN 160 AND 480 AND logp BETWEEN -0.4 AND 5.6 AND heavy BETWEEN 20 AND 70 AND mr BETWEEN 40 AND 130)::BIGINT + ({_MUE} = 0)::BIGINT)::BIGINT AS consensus,
      {_MUE}::BIGINT AS muegge FROM descriptors""",
    "esol": _D + f"round({_ESOL}, 6) AS log_s, CASE WHEN {_ESOL} >= -1 THEN 'highly soluble' WHEN {_ESOL} >= -3 THEN 'soluble' WHEN {_ESOL} >= -4 THEN 'moderately soluble' WHEN {_ESOL} >= -5 THEN 'slightly soluble' ELSE 'insoluble' END AS solubility FROM descriptors",
    "pfi_stars": _D + "round(logp + arom, 6) AS pfi, CASE WHEN logp + arom < 5 THEN 'low' WHEN logp + arom < 7 THEN 'moderate' ELSE 'high' END AS pfi_risk, (" + " + ".join(f"(NOT {n} BETWEEN {lo} AND {hi})::BIGINT" for n, (lo, hi) in S.DRUG_RANGES.items()) + ")::BIGINT AS stars FROM descriptors",
    "abbott_skin": _D
    + f"""(CASE WHEN tpsa > 150 THEN 0.11 WHEN {_LIP} > 1 THEN 0.17 WHEN charge = 0 AND {_LIP} = 0 THEN 0.85 ELSE 0.56 END)::DOUBLE AS abbott,
      round((logp + (0.92::DOUBLE * logp + 0.12::DOUBLE)) / 2, 6) AS logp, round({_SKIN}, 6) AS log_kp,
      CASE WHEN {_SKIN} < -6 THEN 'low' WHEN {_SKIN} < -4 THEN 'moderate' ELSE 'high' END AS skin FROM descriptors""",
    "safety_rules": _D
    + f"""{_HERG}::BIGINT AS herg, CASE WHEN {_HERG} <= 1 THEN 'low' WHEN {_HERG} = 2 THEN 'moderate' ELSE 'high' END AS herg_risk,
      CASE WHEN mw > 500 THEN ((mw > 1000)::BIGINT + (logp > 10)::BIGINT + (hbd > 6)::BIGINT + (tpsa > 250)::BIGINT + (rotb > 20)::BIGINT)::BIGINT ELSE -1 END AS bro5,
      ({" + ".join(f"(NOT {n} BETWEEN {lo} AND {hi})::BIGINT" for n, (lo, hi) in S.REOS_RANGES.items())})::BIGINT AS reos FROM descriptors""",
    "ligand_efficiency": _D
    + """round(1.4::DOUBLE * activity / nullif(heavy, 0), 6) AS le, round(activity - logp, 6) + 0.0::DOUBLE AS lle, round(logp / nullif(1.4::DOUBLE * activity / heavy, 0), 6) + 0.0::DOUBLE AS lelp,
      round(1000.0::DOUBLE * activity / nullif(mw, 0), 6) AS bei, round(100.0::DOUBLE * activity / nullif(tpsa, 0), 6) AS sei FROM descriptors""",
    "aggregator_risk": _D
    + """round(risk, 2) AS risk, CASE WHEN risk >= 0.6 THEN 'high' WHEN risk >= 0.3 THEN 'moderate' ELSE 'low' END AS likelihood, round(n / 6.0::DOUBLE, 2) AS confidence FROM (SELECT l_orderkey, l_linenumber,
      round(least(1.0, (CASE WHEN logp > 4 THEN 0.3 WHEN logp > 3 THEN 0.15 ELSE 0.0 END)::DOUBLE + (CASE WHEN tpsa < 40 THEN 0.2 ELSE 0.0 END)::DOUBLE
      + (CASE WHEN arom >= 4 THEN 0.2 WHEN arom >= 3 THEN 0.1 ELSE 0.0 END)::DOUBLE + (CASE WHEN mw > 500 THEN 0.1 ELSE 0.0 END)::DOUBLE + least(hba % 4, 2) * 0.2::DOUBLE
      + (CASE WHEN least(1.0, 6.0::DOUBLE * arom / heavy) > 0.7 AND heavy > 20 THEN 0.15 ELSE 0.0 END)::DOUBLE), 6) AS risk,
      (logp > 3)::INT + (tpsa < 40)::INT + (arom >= 3)::INT + (mw > 500)::INT + (hba % 4 > 0)::INT + (least(1.0, 6.0::DOUBLE * arom / heavy) > 0.7 AND heavy > 20)::INT AS n FROM descriptors)""",
    "radar_axes": f"WITH {D.SQL}, more AS (SELECT *, {_ESOL} AS esol FROM descriptors) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({x}, 6) AS {a}" for a, x in _AXES.items()) + ", (" + " + ".join(f"({x} >= 1.0)::BIGINT" for x in _AXES.values()) + ")::BIGINT AS in_range, CASE WHEN in_range = 6 THEN 'excellent' WHEN in_range >= 4 THEN 'good' WHEN in_range >= 2 THEN 'moderate' ELSE 'poor' END AS band FROM more",
    "boiled_egg": _D + f"CASE WHEN {_ell(S.BRAIN)} THEN 'yolk' WHEN {_ell(S.GUT)} THEN 'white' ELSE 'grey' END AS region FROM descriptors",
    "unusual_properties": _D + ", ".join(f"CASE WHEN {n} < {lo} THEN 'below' WHEN {n} > {hi} THEN 'above' ELSE 'within' END AS {n}" for n, (lo, hi) in S.PERCENTILES.items()) + ", (" + " + ".join(f"(NOT {n} BETWEEN {lo} AND {hi})::BIGINT" for n, (lo, hi) in S.PERCENTILES.items()) + ")::BIGINT AS n_unusual FROM descriptors",
    "readiness": _D
    + f"""round({_READY}, 4) AS properties, round(CASE WHEN sa <= 3 THEN 8.0 WHEN sa <= 7 THEN 8.0 - (sa - 3.0) * 2.0 ELSE 0.0 END, 4) AS accessibility,
      round(CASE WHEN hba <= 4 THEN 5.0 WHEN hba <= 8 THEN 5.0 - (hba - 4) * 0.75 ELSE 0.0 END::DOUBLE * CASE WHEN hba > 0 AND hbd / hba::DOUBLE > 0.5 THEN 0.5 ELSE 1.0 END, 4) AS stereo,
      CASE WHEN {_READY} * 100 / 35 >= 85 THEN 'Excellent' WHEN {_READY} * 100 / 35 >= 70 THEN 'Good' WHEN {_READY} * 100 / 35 >= 50 THEN 'Moderate' WHEN {_READY} * 100 / 35 >= 30 THEN 'Limited' ELSE 'Poor' END AS label,
      CASE WHEN fsp3 < 0.25 THEN 'flat' WHEN fsp3 < 0.42 THEN 'moderate' ELSE '3d' END AS flatness FROM descriptors""",
    "proxy_efficiency": _D + "1.37::DOUBLE * activity / heavy AS le, CASE WHEN 1.37::DOUBLE * activity / heavy >= 0.3 THEN 'excellent' WHEN 1.37::DOUBLE * activity / heavy >= 0.2 THEN 'good' ELSE 'poor' END AS band FROM descriptors",
    "generative_composite": _D + f"round(0.3::DOUBLE + 0.3::DOUBLE * qed + 0.2::DOUBLE * 1.0 + 0.2::DOUBLE * {_unit('(10.0 - sa) / 9.0')}, 6) AS score FROM descriptors",
}
