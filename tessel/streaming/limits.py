"""A rate limiter with violations and bans: a rule that is folded over each key's rows, in a stream and over a table.

A key may have `most` rows in a fixed window; further ones are limited, and each is a violation. Violations count from the
first one on for twice the length of a ban; as many as `strikes` ban the key, which clears them. Rows of a banned key are
banned: they count neither for the window nor as violations. Rows with neither key nor time get no verdict and are left out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Microseconds: start of the window, its rows, violations, time of the first of them, end of the ban.
STATE = "start long, n int, strikes int, first long, until long"
NEW = (-(1 << 62), 0, 0, 0, -(1 << 62))


@dataclass(frozen=True)
class Rule:
    window: int  # seconds
    most: int
    strikes: int
    ban: int  # seconds

    def judged(self, state: tuple, at: int) -> tuple[str, tuple]:
        """Verdict on a row at `at` microseconds, and the key's state after it. A row that is older than the window of the
        state counts in that window."""
        start, n, strikes, first, until = state
        if at < until:
            return "banned", state
        own = at - at % (self.window * 1_000_000)
        if own > start:
            start, n = own, 0
        if n < self.most:
            return "allowed", (start, n + 1, strikes, first, until)
        if strikes and at >= first + 2 * self.ban * 1_000_000:
            strikes = 0
        if not strikes:
            first = at
        strikes += 1
        if strikes >= self.strikes:
            return "limited", (start, n, 0, 0, at + self.ban * 1_000_000)
        return "limited", (start, n, strikes, first, until)

    def expiry(self, state: tuple) -> int:
        """When the state says no more than a new one, in milliseconds."""
        start, _, strikes, first, until = state
        return -(-max(start + self.window * 1_000_000, until, first + 2 * self.ban * 1_000_000 if strikes else 0) // 1000)


def verdicts(df: DataFrame, key: str, at: str, tie: str, rule: Rule) -> DataFrame:
    """key, at, tie and verdict of a table's rows, in order of time (ties by `tie`).

    A key's rows are a sequence, so one task reads them, sorted (a sort that spills) and as a stream: its memory is a state,
    however many rows a key has.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, NEW
        for batch in batches:
            out = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column("_us").to_pylist(), strict=True):
                if k != now:
                    now, state = k, NEW
                verdict, state = rule.judged(state, t)
                out.append(verdict)
            kept = batch.select([key, at, tie])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.string())], [key, at, tie, "verdict"])

    rows = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("_us"))
    schema = rows.drop("_us").withColumn("verdict", F.lit("")).schema
    return rows.repartition(key).sortWithinPartitions(key, "_us", tie).mapInArrow(fold, schema)


def _micros(t: dt.datetime) -> int:
    """Of the naive local time that a row's timestamp comes as."""
    return round(t.timestamp() * 1_000_000)


class Limiter(StatefulProcessor):
    """Judges a key's rows as they come (those of a batch in order of time) and forgets the key when its state expires."""

    def __init__(self, rule: Rule, key: str, at: str, tie: str):
        self.rule, self.key, self.at, self.tie = rule, key, at, tie

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("limit", STATE)

    def handleInputRows(self, key, rows, timerValues):
        state = tuple(self.state.get()) if self.state.exists() else NEW
        for row in sorted(rows, key=lambda r: (r[self.at], r[self.tie])):
            verdict, state = self.rule.judged(state, _micros(row[self.at]))
            yield Row(**{self.key: key[0], self.at: row[self.at], self.tie: row[self.tie], "verdict": verdict})
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(self.rule.expiry(state), timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter(())


def limited(stream: DataFrame, key: str, at: str, tie: str, rule: Rule, late: str) -> DataFrame:
    """key, at, tie and verdict of a stream's rows, as they come. Where rows come in order of time, whatever the batches,
    verdicts are those of the table. The session needs the RocksDB state store (`ROCKSDB`)."""
    fields = stream.select(key, at, tie).withColumn("verdict", F.lit("")).schema
    rows = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, tie).withWatermark(at, late)
    return rows.groupBy(key).transformWithState(Limiter(rule, key, at, tie), fields, "Append", "eventTime")


#: State store that keyed state with timers needs.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
