"""Distribution statistics, correlation, outliers, entropy and histograms, each a few aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators import ordering


def batch_statistics(rows: DataFrame) -> DataFrame:
    """One row of totals, averages, pass rates and score bands. rows: failed, score, qed, sa, lipinski, safe."""
    ok = ~F.col("failed")
    of = lambda name, places: F.round(F.avg(F.when(ok, F.col(name))), places)
    rate = lambda name: F.round(F.try_divide(F.count_if(ok & F.col(name)) * 100.0, F.count(F.when(ok, F.col(name)))), 1)
    band = lambda low, high: F.count_if(ok & (F.col("score") >= low) & (F.col("score") < high))
    return rows.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("errors"),
        of("score", 1).alias("avg_score"), of("qed", 2).alias("avg_qed"), of("sa", 1).alias("avg_sa"),
        rate("lipinski").alias("lipinski_rate"), rate("safe").alias("safety_rate"),
        band(90, 1e9).alias("excellent"), band(70, 90).alias("good"), band(50, 70).alias("moderate"), band(-1e9, 50).alias("poor"),
    )


def unpivoted(df: DataFrame, names: list[str], *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("property"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")).select(*keys, "x.property", "x.value")


def property_stats(df: DataFrame, names: list[str], at_least: int = 2) -> DataFrame:
    """Count, mean, median, deviation, quartiles and range of each column (exact quantiles)."""
    long = unpivoted(df, names).where("value is not null")
    out = long.groupBy("property").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    out = out.join(ordering.quantiles(long, ["property"], "value", (0.25, 0.5, 0.75)).drop("n"), "property")  # a row for each property
    return out.where(F.col("n") >= at_least).select("property", "n", "mean", "std", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "low", "high")


def pearson(df: DataFrame, names: list[str], at_least: int = 10) -> DataFrame:
    """Correlation of each pair over rows that have both; constant columns give 0; one aggregation for all pairs."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]

    def corr(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
        r = F.coalesce(F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)), F.lit(0.0))
        return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both).alias("n"), F.round(r, 4).alias("r"))

    return df.agg(F.array(*(corr(a, b) for a, b in pairs)).alias("all")).select(F.explode("all").alias("x")).select("x.*").where((F.col("n") >= at_least) & (F.abs("r") >= 1e-10))


def iqr_outliers(df: DataFrame, value: str, by: list[str], keys: list[str], at_least: int = 4) -> DataFrame:
    """Rows strictly beyond 1.5 interquartile ranges of their group's quartiles. Groups' fences are joined back."""
    fences = ordering.quantiles(df, by, value, (0.25, 0.75)).where(F.col("n") >= at_least)
    reach = 1.5 * (F.col("q")[1] - F.col("q")[0])
    fences = fences.select(*by, (F.col("q")[0] - reach).alias("low"), (F.col("q")[1] + reach).alias("high"))
    return ordering.with_groups(df, fences, by).where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))).select(*keys, *by, value, "low", "high")


def entropy(counts: DataFrame) -> DataFrame:
    """Shannon entropy (bits) of counts (n), and its share of the largest possible; 0 with one group or none."""
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("groups"))
    p = F.col("n") / F.col("total")
    bits = counts.join(F.broadcast(total)).agg(F.sum(-p * F.log2(p)).alias("bits"), F.max("groups").alias("groups"))  # one row
    h = F.when(F.col("groups") > 1, F.col("bits")).otherwise(0.0)
    return bits.select(F.col("groups"), F.round(h, 6).alias("entropy"), F.round(F.coalesce(F.try_divide(h, F.log2("groups")) * 100, F.lit(0.0)), 4).alias("diversity"))


def top_and_other(df: DataFrame, key: str, n: int) -> DataFrame:
    """Counts of the n commonest keys and of the others together."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    head = counts.orderBy(F.desc("n"), F.asc(key)).limit(n)
    total = df.agg(F.count("*").alias("n"))
    other = total.join(F.broadcast(head.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top")))).select(F.lit("Other").alias(key), (F.col("n") - F.col("top")).alias("n")).where("n > 0")  # one row each
    return head.union(other)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """Counts in equal bins of [low, high], empty ones too; the last holds its right edge; others are left out."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width) + 1, F.lit(bins)).cast("long")
    counts = df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))  # at most `bins` rows


def against_reference(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """A histogram's bins (bin, n) beside a reference distribution's (bin, share): own share, expected share, difference."""
    total = counts.agg(F.sum("n").alias("total"))
    both = counts.join(reference, "bin", "left").join(F.broadcast(total))  # one row
    own = F.coalesce(F.try_divide(F.col("n"), F.col("total")), F.lit(0.0))
    return both.select("bin", "n", F.round(own, 6).alias("share"), F.coalesce("share", F.lit(0.0)).alias("expected"), F.round(own - F.coalesce("share", F.lit(0.0)), 6).alias("gap"))


def report_statistics(rows: DataFrame) -> DataFrame:
    """Totals by the null rules of the two written reports. rows: status, score, ml.

    One averages scores that are there, whatever the row's status, and is null without any; the other averages over the
    successful rows, a missing score counting as 0, and is 0 without any.
    """
    ok = F.col("status") == "success"
    n = F.count_if(ok)
    per = lambda c: F.coalesce(F.try_divide(F.sum(F.when(ok, F.coalesce(c, F.lit(0))).cast("double")), n), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("total"), n.alias("successful"), (F.count("*") - n).alias("errors"),
        F.round(F.avg("score"), 6).alias("page_score"), F.round(F.avg("ml"), 6).alias("page_ml"), F.round(per("score"), 6).alias("sheet_score"), F.round(per("ml"), 6).alias("sheet_ml"),
    )
