"""Progress of a running job in a table: a stream that upserts its status after each batch, and how the table is read.

The table is a folder of one-row files, one for each job and batch; a batch that runs again replaces its own file, and what
is older than the last two is deleted, so that it has a few rows a job however long the job runs. A trigger interval bounds
the updates to two a second. Statuses end: running ones an hour after their last update, terminal ones after a day.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Between updates; updates that the estimate of the rest looks at; seconds that running and terminal statuses live.
INTERVAL, RECENT, RUNNING_S, ENDED_S = "500 milliseconds", 10, 3600, 86_400
TERMINAL = ("complete", "failed", "cancelled")
ROW = "job string, batch long, status string, processed long, total long, at double, recent array<struct<processed:long,at:double>>, error string"
#: The batch of a terminal row: after all others.
LAST = (1 << 63) - 1


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, folder: str) -> list[int]:
    path, files = _files(spark, folder)
    return sorted(int(x.getPath().getName()[6:]) for x in (files.listStatus(path) if files.exists(path) else ()) if x.getPath().getName().startswith("batch="))


class Status:
    """One job's status. Every method may run again after a failure: rows are written by batch."""

    def __init__(self, spark: SparkSession, folder: str, job: str, total: int, now: Callable[[], float] = time.time):
        self.spark, self.job, self.total, self.now = spark, job, total, now
        self.table, self.folder = folder, f"{folder}/job={job}"

    def _before(self, batch: int) -> dict:
        earlier = [b for b in _batches(self.spark, self.folder) if b < batch]
        found = self.spark.read.schema(ROW).parquet(f"{self.folder}/batch={earlier[-1]}").first() if earlier else None
        return found.asDict(recursive=True) if found else {"processed": 0, "recent": []}

    def _put(self, batch: int, row: dict) -> None:
        values = [(self.job, batch, row["status"], row["processed"], self.total, row["at"], [tuple(r.values()) for r in row["recent"]], row.get("error"))]
        self.spark.createDataFrame(values, ROW).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        if batch != LAST:
            for old in [b for b in _batches(self.spark, self.folder) if b < batch][:-1]:
                path, files = _files(self.spark, f"{self.folder}/batch={old}")
                files.delete(path, True)

    def started(self) -> None:
        """A pending row, unless the job has one already (a restart)."""
        path, files = _files(self.spark, f"{self.folder}/batch={LAST}")
        files.delete(path, True)
        if not _batches(self.spark, self.folder):
            self._put(-1, {"status": "pending", "processed": 0, "at": self.now(), "recent": []})

    def update(self, batch: int, rows: int) -> None:
        before, at = self._before(batch), self.now()
        done = before["processed"] + rows
        self._put(batch, {"status": "processing", "processed": done, "at": at, "recent": [*before["recent"], {"processed": done, "at": at}][-RECENT:]})

    def ended(self, status: str, error: str | None = None) -> None:
        if status not in TERMINAL:
            raise ValueError(f"{status} is no terminal status; there are {', '.join(TERMINAL)}")
        self._put(LAST, {**self._before(LAST), "status": status, "at": self.now(), "error": error})


def start(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, status: Status, checkpoint: str, interval: str = INTERVAL) -> StreamingQuery:
    """Run a batch operator over what arrives, at most once an interval; its result and the job's status are kept by batch."""
    status.started()

    def each(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            work(df).write.mode("overwrite").parquet(f"{out}/batch={batch}")
            status.update(batch, df.count())
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def watched(query: StreamingQuery, status: Status, cancelled: Callable[[], bool] = lambda: False, every: float = 0.2) -> str:
    """Wait until all rows are done, the query fails, or the job is cancelled; writes and returns the terminal status."""
    try:
        while status._before(LAST)["processed"] < status.total:
            if cancelled():
                query.stop()
                status.ended("cancelled")
                return "cancelled"
            if query.awaitTermination(every):
                break
        query.stop()
    except StreamingQueryException as e:
        status.ended("failed", str(e).splitlines()[0][:500])
        return "failed"
    done = "complete" if status._before(LAST)["processed"] >= status.total else "cancelled"
    status.ended(done)
    return done


def _rest(processed: Column, total: Column, recent: Column) -> Column:
    """Seconds that the rest takes at the rate of the recent updates; null without a rate."""
    first, last = recent[0], F.element_at(recent, -1)
    rate = F.try_divide(last["processed"] - first["processed"], last["at"] - first["at"])
    return F.when((F.size(recent) > 1) & (rate > 0), F.floor((total - processed) / rate))


def statuses(spark: SparkSession, folder: str, now: float | None = None) -> DataFrame:
    """Each job's latest status, with percent done and seconds left; those whose life has ended are left out."""
    rows = spark.read.schema(ROW).option("recursiveFileLookup", "true").parquet(folder)
    latest = rows.groupBy("job").agg(F.max_by(F.struct("*"), "batch").alias("r")).select("r.*")
    ended = F.col("status").isin(*TERMINAL)
    alive = F.col("at") + F.when(ended, ENDED_S).otherwise(RUNNING_S) > F.lit(time.time() if now is None else now)
    left = F.when(F.col("status") == "complete", 0).otherwise(_rest(F.col("processed"), F.col("total"), F.col("recent")))
    percent = F.when(F.col("total") > 0, F.floor(F.col("processed") * 100 / F.col("total"))).otherwise(0)
    return latest.where(alive).select("job", "status", "processed", "total", F.when(F.col("status") == "complete", 100).otherwise(percent).alias("percent"), left.alias("seconds_left"), "at", "error")
