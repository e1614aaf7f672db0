"""Structure-data files: a row for each record, tags as properties, counts from the connection table; and its writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.functions.text import sanitized
from tessel.sources.delimited import numbered

END = "$$$$\n"


def read(spark: SparkSession, path: str) -> DataFrame:
    """name, n_atoms, n_bonds, properties, block, index, parse_error; records without a table are rows with an error.

    Records are split by Spark's reader on their end mark, so a large file is many partitions.
    """
    records = numbered(spark.read.text(path, lineSep=END).where("trim(value) <> ''"))
    body = F.regexp_replace("value", "\r\n?", "\n")
    head = F.split(body, "\n")
    counts = F.try_element_at(head, F.lit(4))
    parts = F.split(body, r"\n> +<")
    tag = lambda p: F.struct(F.regexp_extract(p, r"^([^>]*)>", 1).alias("k"), sanitized(F.trim(F.regexp_replace(F.regexp_replace(p, r"^[^>]*>[^\n]*\n", ""), r"\n+$", "")), 10_000).alias("v"))
    tags = F.transform(F.slice(parts, F.lit(2), F.size(parts)), tag)
    last = F.filter(tags, lambda x, i: ~F.exists(F.slice(tags, i + 2, F.greatest(F.size(tags), F.lit(1))), lambda y: y["k"] == x["k"]))
    number = lambda at: F.trim(F.substring(counts, at, 3)).try_cast("int")
    error = F.when(~body.contains("M  END"), "no end of the connection table").when(number(1).isNull() | number(4).isNull(), "malformed counts line")
    title = F.trim(F.element_at(head, 1))
    return records.select(
        F.when(title != "", title).otherwise(F.concat(F.lit("mol_"), F.col("index").cast("string"))).alias("name"), number(1).alias("n_atoms"), number(4).alias("n_bonds"),
        F.map_from_entries(last).alias("properties"), F.element_at(parts, 1).alias("block"), "index", error.alias("parse_error"),
    )


def columns(rows: DataFrame) -> list[str]:
    """All tags, in order."""
    return [r[0] for r in rows.select(F.explode(F.map_keys("properties")).alias("k")).distinct().orderBy("k").collect()]


def prevalidated(spark: SparkSession, path: str) -> DataFrame:
    """Issues by record: (index, line, severity, issue), with the line on which the record starts.

    Lines before a record are summed in two steps: within blocks of records, and over the blocks (a row each).
    """
    rows = numbered(spark.read.text(path, lineSep=END).where("trim(value) <> ''")).select("index", "value", (F.size(F.split("value", "\n"))).alias("lines"))
    rows = rows.withColumn("block", F.floor(F.col("index") / 4096))
    own = Window.partitionBy("block").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("block").agg(F.sum("lines").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.withColumn("within", F.coalesce(F.sum("lines").over(own), F.lit(0))).join(before.select("block", "before"), "block")
    counts = F.split(F.trim(F.coalesce(F.try_element_at(F.split("value", "\n"), F.lit(4)), F.lit(""))), r"\s+")
    issue = lambda when, severity, name: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("issue")))
    found = F.filter(F.array(issue(~F.col("value").contains("M  END"), "error", "missing_end"), issue(F.size(counts) < 2, "warning", "malformed_counts"), issue(F.col("value").contains("\ufffd"), "warning", "encoding")), lambda x: x.isNotNull())
    return placed.select("index", (F.col("before") + F.col("within") + 1).alias("line"), F.explode(found).alias("x")).select("index", "line", "x.severity", "x.issue")


def record(block: Column, properties: Column) -> Column:
    """Text of a record without its end mark."""
    tags = F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(F.lit("> <"), e["key"], F.lit(">\n"), F.coalesce(e["value"], F.lit("")), F.lit("\n\n")))
    return F.concat(F.rtrim(block), F.lit("\n"), F.array_join(tags, ""))


def write(rows: DataFrame, path: str) -> None:
    rows.select(record(F.col("block"), F.col("properties")).alias("value")).write.text(path, lineSep=END)
