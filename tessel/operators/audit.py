"""Dataset audits: contradictory labels, differences of two versions, health scores, curated rows, source comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contradictory_labels(df: DataFrame, key: str, value: str, fold: float = 10.0) -> DataFrame:
    """Keys whose positive values differ by more than `fold`: entries, least, most, fold (one decimal).

    Null keys, values that are no numbers, zeros and negatives are left out first.
    """
    v = F.col(value).try_cast("double")
    rows = df.where(F.col(key).isNotNull()).select(key, v.alias("v")).where((F.col("v") > 0) & ~F.isnan("v"))
    groups = rows.groupBy(key).agg(F.count("*").alias("entries"), F.min("v").alias("least"), F.max("v").alias("most"))
    ratio = F.col("most") / F.greatest(F.col("least"), F.lit(1e-10))
    return groups.where((F.col("entries") >= 2) & (ratio > fold)).withColumn("fold", F.round(ratio, 1))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by `order`, as a struct `row`."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), order).alias("row"))


def dataset_diff(primary: DataFrame, comparison: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """added, removed, modified or unchanged for each key of either side, and the changed columns: one full outer join."""
    p = last_wins(primary, key, order).withColumnRenamed("row", "p")
    c = last_wins(comparison, key, order).withColumnRenamed("row", "c")
    both = p.join(c, key, "full_outer")
    changed = F.filter(F.array(*(F.when(~F.col(f"p.{n}").eqNullSafe(F.col(f"c.{n}")), F.lit(n)) for n in columns)), lambda x: x.isNotNull())
    state = F.when(F.col("p").isNull(), "added").when(F.col("c").isNull(), "removed").when(F.size("changed") > 0, "modified").otherwise("unchanged")
    return both.withColumn("changed", changed).select(key, state.alias("state"), F.when(state == "modified", F.array_join("changed", ",")).otherwise("").alias("changed"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("state").agg(F.count("*").alias("n"))


# Weights of the health score's parts.
HEALTH_WEIGHTS = {"parsability": 0.25, "stereo": 0.15, "uniqueness": 0.20, "alerts": 0.20, "consistency": 0.20}


def health(df: DataFrame, parsed: Column, complete: Column, key: Column, flagged: Column, stable: Column) -> DataFrame:
    """Five parts in 0 to 1 and their weighted sum times 100; a part without rows is 1, an empty table all 0."""
    ok = F.coalesce(parsed, F.lit(False))
    agg = df.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("parsed"), F.count_if(ok & complete).alias("complete"), F.count_if(ok & key.isNotNull()).alias("keyed"),
        F.count_distinct(F.when(ok, key)).alias("distinct"), F.count_if(ok & flagged).alias("flagged"), F.count_if(ok & stable).alias("stable"),
    )
    part = lambda a, b: F.when(F.col("total") == 0, 0.0).otherwise(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(1.0)))
    parts = {"parsability": part("parsed", "total"), "stereo": part("complete", "parsed"), "uniqueness": part("distinct", "keyed"), "alerts": F.when(F.col("total") == 0, 0.0).otherwise(1 - F.coalesce(F.try_divide(F.col("flagged"), F.col("parsed")), F.lit(0.0))), "consistency": part("stable", "parsed")}
    score = reduce(lambda a, b: a + b, (parts[n] * w for n, w in HEALTH_WEIGHTS.items())) * 100
    return agg.select("total", "parsed", *(F.round(v, 6).alias(n) for n, v in parts.items()), F.round(score, 4).alias("health"))


def curated(df: DataFrame, index: str, issues: DataFrame) -> DataFrame:
    """Each row with its issues joined by commas (in order; empty without any)."""
    own = issues.groupBy(index).agg(F.array_join(F.array_sort(F.collect_set("issue")), ",").alias("issues"))
    return df.join(own, index, "left").withColumn("issues", F.coalesce("issues", F.lit("")))


def compared_sources(values: DataFrame, key: str, layer: int = 14) -> DataFrame:
    """Verdict for each key over sources (source, value): consistent, minor (the first `layer` characters agree), major, or
    no_data. 14 is the connectivity layer of a structure key."""
    agg = values.groupBy(key).agg(F.count("value").alias("sources"), F.count_distinct("value").alias("full"), F.count_distinct(F.substring("value", 1, layer)).alias("short"))
    verdict = F.when(F.col("sources") < 2, "no_data").when(F.col("full") == 1, "consistent").when(F.col("short") == 1, "minor").otherwise("major")
    return agg.select(key, "sources", verdict.alias("verdict"))


def compared_layers(values: DataFrame, key: str) -> DataFrame:
    """Verdict for each key over layered strings of sources (source, value), and where they part.

    missing: fewer than two values; match: all equal; minor_difference: one formula (the first layer) among them, and they
    part at the connectivity (the second layer, if it starts with c) or in later layers; mismatch: the formulas differ, or
    none has one. Least and greatest are compared, so that a hot key is aggregated before it is shuffled.
    """
    part = F.split("value", "/")
    formula, bonds = F.try_element_at(part, F.lit(2)), F.try_element_at(part, F.lit(3))
    one = lambda v: F.min(v) == F.max(v)
    agg = values.groupBy(key).agg(F.count("value").alias("found"), one(F.col("value")).alias("same"), one(formula).alias("formula"), one(F.when(bonds.startswith("c"), bonds)).alias("bonds"))
    formula_ok = F.coalesce("formula", F.lit(False))
    status = F.when(F.col("found") < 2, "missing").when(F.col("same"), "match").when(formula_ok, "minor_difference").otherwise("mismatch")
    parts = F.when(status.isin("missing", "match"), "none").when(~formula_ok, "formula").when(F.coalesce("bonds", F.lit(True)), "later_layers").otherwise("connectivity")
    return agg.select(key, "found", status.alias("status"), parts.alias("parts_at"))


def column_sets(primary: DataFrame, comparison: DataFrame) -> DataFrame:
    """Columns that both versions have, and those of either alone."""
    a, b = primary.columns, comparison.columns
    rows = [(n, "common" if n in b else "removed") for n in a] + [(n, "added") for n in b if n not in a]
    return primary.sparkSession.createDataFrame(rows, "name string, state string")


def property_sets(primary: DataFrame, comparison: DataFrame, properties: str) -> DataFrame:
    """Names in the property maps of two versions' rows: common, removed or added, and how many rows have each.

    Names of a map whose value is null count; null maps have none.
    """
    named = lambda df, n: df.select(F.explode(F.map_keys(properties)).alias("name")).groupBy("name").agg(F.count("*").alias(n))
    both = named(primary, "n_primary").join(named(comparison, "n_comparison"), "name", "full_outer")
    state = F.when(F.col("n_primary").isNull(), "added").when(F.col("n_comparison").isNull(), "removed").otherwise("common")
    return both.select("name", state.alias("state"), *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_primary", "n_comparison")))


def dataset_audit(df: DataFrame, parsed: Column, complete: Column, key: Column, flagged: Column, stable: Column, value: str, numeric_share: float = 0.8) -> DataFrame:
    """The stages of a dataset's audit in one row: health, contradictory labels of `value`, and columns that read as numbers."""
    score = health(df, parsed, complete, key, flagged, stable)
    keyed = df.withColumn("_key", key)
    clashes = contradictory_labels(keyed, "_key", value).agg(F.count("*").alias("contradictions"), F.max("fold").alias("worst_fold"))
    shares = df.agg(*(F.avg(F.when(F.col(n).isNotNull(), F.col(n).cast("string").try_cast("double").isNotNull().cast("int"))).alias(n) for n in df.columns))
    numeric = shares.select(F.array_join(F.filter(F.array(*(F.when(F.col(f"`{n}`") > numeric_share, F.lit(n)) for n in df.columns)), lambda x: x.isNotNull()), ",").alias("numeric"))
    return score.join(F.broadcast(clashes)).join(F.broadcast(numeric))  # one row each
