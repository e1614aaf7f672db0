"""Places in a global order, in two steps (within the ranges of a range-partitioned sort, and over the ranges' totals, a row
for each), and exact quantiles by selection, so that no task holds a whole column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.sources.staging import drop_staged, small_enough, staged

#: Rows of a range of a sort, about; and rows below which a range is not worth a task.
RANGE_ROWS, LEAST_ROWS = 200_000, 1_000
#: Of the sketch that brackets quantiles: its ranks are right to a share of 1 / ACCURACY.
ACCURACY = 10_000
#: Groups that a join may broadcast (some tens of bytes each); beyond it the join is shuffled.
BROADCAST_GROUPS = 100_000


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df sorted over ranges of about RANGE_ROWS rows, written with each row's range (_part) and place in it (_at).

    Rows that are equal by the order are dealt over ranges too, so that no range grows with a key.
    """
    rows = staged(df.withColumn("_tie", F.monotonically_increasing_id()), "to-order")
    count, most = rows.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, count // LEAST_ROWS), -(-count // RANGE_ROWS))
    place = F.monotonically_increasing_id()
    out = rows.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie").withColumn("_id", place)
    out = staged(out.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"), "ordered")
    drop_staged(rows)
    return out


def with_groups(df: DataFrame, groups: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """df joined with a row for each group, whatever the size of a group."""
    return df.join(F.broadcast(groups) if small_enough(groups, BROADCAST_GROUPS) else groups, on, how)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0, by: str | None = None, total: str | None = None) -> DataFrame:
    """df with each row's place in the order, from `start` on; with `by` (a column without nulls) in its group, and with
    `total` the rows of the group (or of the table) in that column. Rows that are equal by the order get places in any order.
    """
    rows = ranged(df, [by, *order] if by else order)
    group = [by] if by else []
    parts = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each group and range
    every = Window.partitionBy(*group)
    earlier = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + start).alias("_before"), F.sum("_n").over(every).alias(total or "_total"))
    out = with_groups(rows, parts, [*group, "_part"]).withColumn(name, F.col("_at") + F.col("_before"))
    return out.drop("_part", "_at", "_before", "_total")


def quantiles(df: DataFrame, by: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """by, n (values) and q (an array, one for each point): exact quantiles of a group's values, linear between neighbours.

    By selection: a sketch brackets each wanted rank, exact counts say which ranks the bracket holds, and only the values in
    it are sorted: about 4 / ACCURACY of a group's, equal ones once. A bracket that missed its rank becomes the whole range.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    edges = [min(1.0, max(0.0, p + d)) for p in points for d in (-2 / ACCURACY, 2 / ACCURACY)]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", edges, ACCURACY).alias("_e"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    sketch = staged(sketch, "brackets")
    at = [F.lit(p) * (F.col("n") - 1) for p in points]
    below = lambda i: F.count_if(F.col("_v") < F.col("_e")[2 * i])
    upto = lambda i: F.count_if(F.col("_v") <= F.col("_e")[2 * i + 1])
    met = with_groups(rows, sketch, by).groupBy(*by).agg(*(f(i).alias(f"{n}{i}") for i in range(len(points)) for f, n in ((below, "_b"), (upto, "_u"))))
    sound = lambda i: (F.col(f"_b{i}") <= F.floor(at[i])) & (F.col(f"_u{i}") > F.ceil(at[i]))
    wanted = F.array(*(
        F.struct(F.lit(p).alias("p"), at[i].alias("at"), F.when(sound(i), F.col("_e")[2 * i]).otherwise(F.col("_min")).alias("low"), F.when(sound(i), F.col("_e")[2 * i + 1]).otherwise(F.col("_max")).alias("high"), F.when(sound(i), F.col(f"_b{i}")).otherwise(0).alias("below"))
        for i, p in enumerate(points)
    ))
    brackets = staged(sketch.join(met, by).select(*by, "n", wanted.alias("_w")), "brackets")
    within = [F.col("_v").between(F.col("_w")[i]["low"], F.col("_w")[i]["high"]) for i in range(len(points))]
    inside = F.array_compact(F.array(*(F.when(w, F.col("_w")[i]) for i, w in enumerate(within))))
    values = with_groups(rows, brackets, by).where(reduce(Column.__or__, within)).select(*by, "n", "_v", F.explode(inside).alias("w"))
    counts = values.groupBy(*by, "n", "w.p", "w.at", "w.below", "_v").agg(F.count("*").alias("_k"))
    end = F.col("below") + F.sum("_k").over(Window.partitionBy(*by, "p").orderBy("_v"))
    pick = lambda r: F.max(F.when((F.col("_end") - F.col("_k") <= r) & (r < F.col("_end")), F.col("_v").cast("double")))
    ends = counts.withColumn("_end", end).groupBy(*by, "n", "p", "at").agg(pick(F.floor("at")).alias("low"), pick(F.ceil("at")).alias("high"))
    each = ends.withColumn("v", F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at")))
    return each.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("q"))
