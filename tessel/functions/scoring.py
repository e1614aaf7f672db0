"""Closed-form scores over descriptor columns, each a Spark column expression.

A null descriptor makes a score null, except in profile scores, which leave null properties out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

# Published thresholds of the rule sets.
DRUG_RANGES = {"mw": (130, 725), "logp": (-2, 6.5), "hba": (2, 20), "hbd": (0, 6), "tpsa": (7, 200), "rotb": (0, 15), "fsp3": (0, 1), "rings": (0, 6)}
REOS_RANGES = {"mw": (200, 500), "logp": (-5, 5), "hbd": (0, 5), "hba": (0, 10), "rotb": (0, 8), "tpsa": (0, 150), "rings": (0, 4)}
RADAR_AXES = {"lipo": ("logp", -0.7, 5.0), "size": ("mw", 150.0, 500.0), "polar": ("tpsa", 20.0, 130.0), "insolu": ("esol", -6.0, 0.0), "insatu": ("fsp3", 0.25, 1.0), "flex": ("rotb", 0.0, 9.0)}
#: Ellipses on the (polarity, lipophilicity) plane: centre and half axes.
GUT, BRAIN = (71.051, 2.292, 142.081, 4.580), (45.542, 2.137, 79.579, 3.177)
#: Low and high percentiles of known drugs; outside them a property counts as unusual.
PERCENTILES = {"mw": (150.0, 550.0), "logp": (-2.0, 5.5), "rotb": (0.0, 12.0), "rings": (1.0, 5.0), "heavy": (10.0, 40.0)}
#: Ideal ranges and points of the property part of machine-learning readiness, and its labels.
READINESS = {"mw": (200, 500, 6), "logp": (0.5, 4.0, 6), "tpsa": (40, 120, 5), "hbd": (0, 3, 4), "hba": (2, 8, 4), "rotb": (1, 8, 5), "arom": (1, 3, 5)}
LABELS = ((85, "Excellent"), (70, "Good"), (50, "Moderate"), (30, "Limited"))
BEYOND_FIVE = {"mw": 1000, "logp": 10, "hbd": 6, "tpsa": 250, "rotb": 20}


def count_true(*tests: Column) -> Column:
    return reduce(lambda a, b: a + b, (t.cast("int") for t in tests))


def outside(name: str, low: float, high: float) -> Column:
    return ~c(name).between(low, high)


def banded(value: Column, *bands: tuple[float, str], last: str) -> Column:
    """The name of the first band whose bound the value is under, else the last."""
    out = F.lit(last)
    for bound, name in reversed(bands):
        out = F.when(value < bound, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def desirability(value: Column, low: float, high: float) -> Column:
    """1 within [low, high], down to 0 one range's width beyond; null for null."""
    width = max(high - low, 1e-6)
    away = F.when(value < low, F.lit(low) - value).otherwise(value - F.lit(high)) / F.lit(width)
    return F.when(value.between(low, high), F.lit(1.0)).when(value.isNotNull(), F.greatest(F.lit(0.0), 1.0 - away))


def shaped(value: Column, low: float, high: float, shape: str) -> Column:
    """Ramp, sigmoid or step from 0 at low to 1 at high."""
    if shape == "step" or high == low:
        return (value >= high).cast("double")
    ramp = clamp((value - low) / (high - low))
    return 1.0 / (1.0 + F.exp(-12.0 * (ramp - 0.5))) if shape == "sigmoid" else ramp


def profile_score(thresholds: dict[str, tuple[float, float]], weights: dict[str, float]) -> Column:
    """Weighted geometric mean of desirabilities times 100, over the properties that are there; null without any."""
    product, total = F.lit(1.0), F.lit(0.0)
    for name, (low, high) in thresholds.items():
        w = weights.get(name, 1.0)
        product = product * F.when(c(name).isNull(), 1.0).otherwise(F.pow(desirability(c(name), low, high), F.lit(w)))
        total = total + F.when(c(name).isNull(), 0.0).otherwise(w)
    return F.when(total > 0, F.pow(product, F.try_divide(F.lit(1.0), total)) * 100)


def custom_mpo(parts: list[tuple[str, float, float, str, float]]) -> Column:
    """Weighted mean of shaped desirabilities: (descriptor, low, high, shape, weight)."""
    return reduce(lambda a, b: a + b, (shaped(c(n), low, high, s) * w for n, low, high, s, w in parts)) / sum(p[4] for p in parts)


def cns_mpo() -> Column:
    """Four components, 4 at most."""
    tpsa = F.when(c("tpsa").between(40, 90), 1.0).when((c("tpsa") < 20) | (c("tpsa") > 120), 0.0).when(c("tpsa") < 40, (c("tpsa") - 20) / 20.0).otherwise(1.0 - (c("tpsa") - 90) / 30.0)
    return clamp(1.0 - (c("logp") - 1) / 4.0) + tpsa + clamp(1.0 - (c("mw") - 360) / 140.0) + F.greatest(F.lit(0.0), 1.0 - c("hbd") * 0.25)


def admet_cns() -> Column:
    """Six components with two of 0.5 that stand for unknown ones, 6 at most."""
    hbd = F.when(c("hbd") <= 3, 1.0 - c("hbd") * 0.25).otherwise(0.0)
    return clamp(1.0 - (c("mw") - 360) / 140.0) + clamp(1.0 - (c("logp") - 3) / 2.0) + clamp(1.0 - (c("tpsa") - 40) / 50.0) + hbd + 1.0


def lipinski_violations() -> Column:
    return count_true(c("mw") > 500, c("logp") > 5, c("hbd") > 5, c("hba") > 10)


def rule_sets() -> dict[str, Column]:
    """Whether each rule set is met."""
    return {
        "lipinski": lipinski_violations() <= 1,
        "veber": (c("rotb") <= 10) & (c("tpsa") <= 140),
        "ro3": (c("mw") < 300) & (c("logp") <= 3) & (c("hbd") <= 3) & (c("hba") <= 3) & (c("rotb") <= 3) & (c("tpsa") <= 60),
        "ghose": c("mw").between(160, 480) & c("logp").between(-0.4, 5.6) & c("heavy").between(20, 70) & c("mr").between(40, 130),
        "egan": (c("logp") <= 5.88) & (c("tpsa") <= 131.6),
        "lead": c("mw").between(200, 350) & c("logp").between(-1, 3) & (c("rotb") <= 7),
        "pfizer": ~((c("logp") > 3) & (c("tpsa") < 75)),
        "gsk": (c("mw") <= 400) & (c("logp") <= 4),
        "golden_triangle": c("mw").between(200, 450) & c("logp").between(-0.5, 5),
    }


def muegge_violations(carbons: Column, heteroatoms: Column) -> Column:
    ok = (c("mw").between(200, 600), c("logp").between(-2, 5), c("tpsa") <= 150, c("rings") <= 7, carbons > 4, heteroatoms > 1, c("rotb") <= 15, c("hbd") <= 5, c("hba") <= 10)
    return count_true(*(~t for t in ok))


def consensus() -> Column:
    """Of five rule sets, how many are met."""
    sets = rule_sets()
    return count_true(sets["lipinski"], sets["veber"], sets["egan"], sets["ghose"], muegge_violations(c("heavy"), c("hba")) == 0)


def esol() -> Column:
    """log10 of solubility; the aromatic proportion is aromatic atoms (six a ring) over heavy atoms, 1 at most."""
    proportion = F.least(F.lit(1.0), F.try_divide(6.0 * c("arom"), c("heavy")))
    return 0.16 - 0.63 * c("logp") - 0.0062 * c("mw") + 0.066 * c("rotb") - 0.74 * proportion


def esol_class(value: Column) -> Column:
    return F.when(value >= -1, "highly soluble").when(value >= -3, "soluble").when(value >= -4, "moderately soluble").when(value >= -5, "slightly soluble").when(value.isNotNull(), "insoluble")


def pfi() -> Column:
    return c("logp") + c("arom")


def stars() -> Column:
    return count_true(*(outside(n, *r) for n, r in DRUG_RANGES.items()))


def reos_violations() -> Column:
    return count_true(*(outside(n, *r) for n, r in REOS_RANGES.items()))


def abbott() -> Column:
    v = lipinski_violations()
    return F.when(c("tpsa") > 150, 0.11).when(v > 1, 0.17).when((c("charge") == 0) & (v == 0), 0.85).otherwise(0.56)


def consensus_logp() -> Column:
    return (c("logp") + (0.92 * c("logp") + 0.12)) / 2


def skin_permeation() -> Column:
    return -2.71 + 0.71 * c("logp") - 0.0061 * c("mw")


def herg() -> Column:
    return count_true(c("logp") > 3.7, (c("mw") > 250) & (c("mw") < 500), c("tpsa") < 75, c("basic_n"))


def beyond_five_violations() -> Column:
    """Null where the rule does not apply (500 or lighter)."""
    return F.when(c("mw") > 500, count_true(*(c(n) > v for n, v in BEYOND_FIVE.items())))


def ligand_efficiency() -> dict[str, Column]:
    le = F.try_divide(1.4 * c("activity"), c("heavy"))
    return {"le": le, "lle": c("activity") - c("logp"), "lelp": F.try_divide(c("logp"), le), "bei": F.try_divide(1000.0 * c("activity"), c("mw")), "sei": F.try_divide(100.0 * c("activity"), c("tpsa"))}


# Factors of aggregation risk: what is added from which bound on, the highest that holds.
RISK_FACTORS = (
    ("logp", ">", ((4, 0.3), (3, 0.15))),
    ("tpsa", "<", ((40, 0.2),)),
    ("arom", ">=", ((4, 0.2), (3, 0.1))),
    ("mw", ">", ((500, 0.1),)),
)


def aggregator_factors(scaffolds: Column) -> list[Column]:
    """What six factors add: four descriptors, known scaffolds (two count at most), and conjugation."""
    test = {">": lambda x, b: x > b, "<": lambda x, b: x < b, ">=": lambda x, b: x >= b}
    out = []
    for name, way, steps in RISK_FACTORS:
        value = F.lit(0.0)
        for bound, points in reversed(steps):
            value = F.when(test[way](c(name), bound), F.lit(points)).otherwise(value)
        out.append(value)
    conjugated = (F.least(F.lit(1.0), F.try_divide(6.0 * c("arom"), c("heavy"))) > 0.7) & (c("heavy") > 20)
    return [*out, F.least(scaffolds, F.lit(2)) * 0.2, F.when(conjugated, 0.15).otherwise(0.0)]


def aggregator_risk(scaffolds: Column) -> dict[str, Column]:
    """Risk (1 at most), its name, and the share of factors that add to it."""
    parts = aggregator_factors(scaffolds)
    risk = F.round(F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts)), 6)
    return {"risk": F.round(risk, 2), "likelihood": F.when(risk >= 0.6, "high").when(risk >= 0.3, "moderate").otherwise("low"), "confidence": F.round(count_true(*(p > 0 for p in parts)) / 6, 2)}


def radar() -> dict[str, Column]:
    return {axis: desirability(esol() if name == "esol" else c(name), low, high) for axis, (name, low, high) in RADAR_AXES.items()}


def radar_band(in_range: Column) -> Column:
    return F.when(in_range == 6, "excellent").when(in_range >= 4, "good").when(in_range >= 2, "moderate").otherwise("poor")


# The radar's reference profile.
REFERENCE_PROFILE = {"logp": 2.5, "mw": 350.0, "tpsa": 75.0, "esol": -3.0, "fsp3": 0.35, "rotb": 5.0}


def radar_comparison(df: DataFrame, *keys: str, places: int = 4) -> DataFrame:
    """The rows' radar profiles, and the reference's (keys null)."""
    own = df.select(*keys, F.lit(False).alias("is_reference"), *(F.round(v, places).alias(a) for a, v in radar().items()))
    at = {a: desirability(F.lit(REFERENCE_PROFILE[n]), low, high) for a, (n, low, high) in RADAR_AXES.items()}
    kinds = dict(df.dtypes)
    reference = df.sparkSession.range(1).select(*(F.lit(None).cast(kinds[k]).alias(k) for k in keys), F.lit(True).alias("is_reference"), *(F.round(v, places).alias(a) for a, v in at.items()))
    return own.union(reference)


# Points of natural-product likeness by feature, the first interval that holds; and names of its bands.
INF = float("inf")
LIKENESS = {
    "ring_share": ((0.2, 0.6, 0.5), (0.6, INF, -0.3)),
    "oxygen_share": ((0.1, 0.5, 0.5), (0.5, INF, 0.3)),
    "fsp3": ((0.4, INF, 0.5), (0.25, INF, 0.3), (-INF, INF, -0.2)),
    "chiral": ((2.5, INF, 0.5), (0.5, INF, 0.2)),
    "mw": ((200, 800, 0.3), (-INF, 150, -0.2)),
}
LIKENESS_BANDS = ((2.0, "strongly natural"), (1.0, "natural"), (0.3, "moderately natural"), (-0.3, "mixed"), (-1.0, "moderately synthetic"), (-2.0, "synthetic"))


def likeness() -> Column:
    """Natural-product likeness from features (ring_share, oxygen_share and nitrogen_share to carbon, halogens, fsp3,
    chiral, mw), within 3 of 0. An interval that starts at another's end is open there."""
    total = F.when(c("nitrogen_share") > 0.3, -0.3).otherwise(0.0) - 0.3 * F.least(c("halogens"), F.lit(3))
    for name, rows in LIKENESS.items():
        points = F.lit(0.0)
        for low, high, p in reversed(rows):
            closed = name in ("ring_share", "oxygen_share", "mw") and (low, high, p) == rows[0]
            inside = (c(name) >= low) & (c(name) <= high) if closed else (c(name) > low) & (c(name) < high)
            points = F.when(inside, p).otherwise(points)
        total = total + points
    return F.round(clamp(total * 1.5, -3.0, 3.0), 6)


def likeness_band(score: Column) -> Column:
    out = F.lit("strongly synthetic")
    for bound, name in reversed(LIKENESS_BANDS):
        out = F.when(score >= bound, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def density_points(on: Column, width: Column) -> Column:
    """5 for a fingerprint with 1 to 30 % of its bits on, less in proportion below, and down to 0 at 45 % above."""
    d = F.try_divide(on.cast("double"), width)
    return F.when(d.between(0.01, 0.30), 5.0).when(d < 0.01, F.round(5.0 * (d / 0.01), 2)).when(d <= 0.45, F.round(5.0 * (1.0 - (d - 0.30) / 0.15), 2)).otherwise(0.0)


def contributions(df: DataFrame, key: str, parts: str, scores: DataFrame, most: int = 5) -> DataFrame:
    """Of rows with an array of parts, and scores (part, group, score): total, parts known, groups' sums (largest first) and
    the parts of most weight, by size of score."""
    each = df.select(key, F.explode(parts).alias("part")).join(scores, "part")
    groups = each.groupBy(key, "group").agg(F.round(F.sum("score"), 4).alias("sum"))
    ranked = groups.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("sum")).alias("o"), "group", "sum"))), lambda g: F.concat_ws(":", g["group"], F.format_number(g["sum"], 4))).alias("groups"))
    whole = each.groupBy(key).agg(F.round(F.sum("score"), 4).alias("total"), F.count("*").alias("known"), F.slice(F.array_sort(F.collect_list(F.struct((-F.abs("score")).alias("o"), "part"))), 1, most).alias("top"))
    return whole.join(ranked, key).select(key, "total", "known", F.array_join("groups", ",").alias("groups"), F.array_join(F.transform("top", lambda t: t["part"].cast("string")), ",").alias("top"))


def in_ellipse(ellipse: tuple[float, float, float, float]) -> Column:
    x, y, a, b = ellipse
    return F.pow((c("tpsa") - x) / a, F.lit(2.0)) + F.pow((c("logp") - y) / b, F.lit(2.0)) <= 1


def egg_region() -> Column:
    return F.when(in_ellipse(BRAIN), "yolk").when(in_ellipse(GUT), "white").when(c("tpsa").isNotNull() & c("logp").isNotNull(), "grey")


def composite(validity: float = 0.3, qed: float = 0.3, alert_free: float = 0.2, sa: float = 0.2, alerts: Column | None = None) -> Column:
    """Generative score of a valid row: weighted validity, drug-likeness, freedom from alerts and ease of making."""
    free = F.lit(1.0) if alerts is None else (alerts == 0).cast("double")
    return validity + qed * c("qed") + alert_free * free + sa * clamp((10.0 - c("sa")) / 9.0)


def unusual() -> dict[str, Column]:
    """below, above or within, for each property against the percentiles of known drugs."""
    return {n: F.when(c(n) < low, "below").when(c(n) > high, "above").when(c(n).isNotNull(), "within") for n, (low, high) in PERCENTILES.items()}


def readiness_properties() -> Column:
    """Points of the property part, each property's to two places, 35 at most."""
    return reduce(lambda a, b: a + b, (F.round(F.coalesce(desirability(c(n), low, high), F.lit(0.0)) * points, 2) for n, (low, high, points) in READINESS.items()))


def accessibility_points(sa: Column) -> Column:
    """8 up to a score of 3, then two less for each, none beyond 7."""
    return F.when(sa.isNotNull(), clamp(8.0 - (sa - 3.0) * 2.0, 0.0, 8.0))


def stereocentre_points(total: Column, undefined: Column) -> Column:
    base = F.when(total <= 4, 5.0).when(total <= 8, 5.0 - (total - 4) * 0.75).otherwise(0.0)
    return base * F.when((total > 0) & (undefined > 0.5 * total), 0.5).otherwise(1.0)


def labelled(score: Column) -> Column:
    out = F.lit("Poor")
    for bound, name in reversed(LABELS):
        out = F.when(score >= bound, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def flatness(fsp3: Column) -> Column:
    return banded(fsp3, (0.25, "flat"), (0.42, "moderate"), last="3d")


def proxy_efficiency() -> tuple[Column, Column]:
    """Efficiency from activity with its band, or without activity from drug-likeness over weight with its own."""
    le = F.try_divide(1.37 * c("activity"), c("heavy"))
    proxy = F.try_divide(1000.0 * c("qed"), c("mw"))
    band = F.when(c("activity").isNotNull(), F.when(le >= 0.3, "excellent").when(le >= 0.2, "good").otherwise("poor")).otherwise(F.when(proxy >= 1.5, "excellent").when(proxy >= 0.8, "good").otherwise("poor"))
    return F.coalesce(le, proxy), band
