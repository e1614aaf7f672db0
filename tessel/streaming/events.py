"""Structured Streaming: file-drop ingestion through the batch operators, windows, rate limits, deduplication, progress.

Beyond the reference, which has no event time; window semantics are Spark's, with watermarks for late rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType


def dropped_files(spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet", each: int = 16) -> DataFrame:
    """Rows of files as they are dropped in a folder."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", each).load(folder)


def tumbling(stream: DataFrame, at: str, size: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def over_limit(stream: DataFrame, at: str, size: str, late: str, key: str, most: int) -> DataFrame:
    """Keys with more than `most` rows in a window."""
    return tumbling(stream, at, size, late, key).where(F.col("n") > most)


def first_seen(stream: DataFrame, at: str, late: str, *keys: str) -> DataFrame:
    """Rows whose keys did not come within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def batch_job(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch operator over what arrived and keep its result by batch; a batch that runs again replaces its own."""

    def each(df: DataFrame, batch: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Totals(StreamingQueryListener):
    """Rows, the last rate and the end of every query, however long it runs (a query itself keeps its last triggers alone)."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.rate: dict[str, float] = {}
        self.ended: dict[str, str] = {}

    def onQueryStarted(self, event):
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event):
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows
        self.rate[key] = event.progress.processedRowsPerSecond

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended[str(event.id)] = "failed" if event.exception else "complete"


def progress(query: StreamingQuery, totals: Totals) -> dict:
    """Rows so far, rows a second of the last trigger, whether the query goes on, and how it ended."""
    key = str(query.id)
    return {"processed": totals.rows.get(key, 0), "rate": totals.rate.get(key, 0.0), "active": query.isActive, "status": totals.ended.get(key)}
