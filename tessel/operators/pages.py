"""A result in a stored order: sorted and written once, so that a page reads the files that hold it and counts nothing.

Rows are numbered in the order and written in files of `file_rows`; a row of the summary has how many there are. A page's
files follow from its row numbers, so neither a listing nor a scan is needed, however long the result.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.operators.ordering import numbered

FILE_ROWS = 10_000


def store(df: DataFrame, order: list[str], folder: str, file_rows: int = FILE_ROWS) -> None:
    """Write df in an order whose columns tell all rows apart (ascending, nulls first)."""
    rows = numbered(df, order, "row").withColumn("file", F.floor(F.col("row") / file_rows))
    rows.repartition("file").sortWithinPartitions("file", "row").write.partitionBy("file").mode("overwrite").parquet(f"{folder}/rows")
    spark = df.sparkSession
    summary = spark.read.schema("row long").parquet(f"{folder}/rows").agg(F.count("*").alias("total"))
    summary.select("total", F.lit(file_rows).alias("file_rows"), F.lit(df.schema.json()).alias("columns")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/summary")


class Stored:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        own = spark.read.parquet(f"{folder}/summary").first()
        self.total, self.file_rows, self.columns = own["total"], own["file_rows"], T.StructType.fromJson(json.loads(own["columns"]))

    def page(self, number: int, size: int) -> DataFrame:
        """The page's rows with their numbers, rows and pages that there are; empty beyond the last page."""
        if number < 1 or size < 1:
            raise ValueError("pages and their sizes begin at 1")
        first, end = (number - 1) * size, min(number * size, self.total)
        schema = T.StructType([*self.columns.fields, T.StructField("row", T.LongType())])
        if first >= end:
            rows = self.spark.createDataFrame([], schema)
        else:
            files = [f"{self.folder}/rows/file={i}" for i in range(first // self.file_rows, (end - 1) // self.file_rows + 1)]
            rows = self.spark.read.schema(schema).parquet(*files).where((F.col("row") >= first) & (F.col("row") < end))
        return rows.withColumn("total", F.lit(self.total)).withColumn("pages", F.lit(-(-self.total // size)))
