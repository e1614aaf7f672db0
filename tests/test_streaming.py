import datetime as dt
import random
import time

import pytest

from tessel.streaming import events, limits, status


def test_dropped_files_run_through_windows_and_jobs(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(1, at(0), 1.0), (1, at(1), 2.0), (1, at(2), 3.0), (2, at(30), 4.0), (1, at(2), 3.0)]
    spark.createDataFrame(rows, "user long, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = lambda: events.dropped_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    totals = events.Totals()
    spark.streams.addListener(totals)
    job = events.batch_job(stream(), lambda df: df.groupBy("user").sum("value"), str(tmp_path / "out"), str(tmp_path / "cp"))
    job.awaitTermination(120)
    for _ in range(100):  # events come after the query's end
        if events.progress(job, totals)["status"]:
            break
        time.sleep(0.1)
    spark.streams.removeListener(totals)
    got = events.progress(job, totals)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and (got["processed"], got["status"], got["active"]) == (5, "complete", False)
    q = events.over_limit(stream(), "ts", "10 minutes", "1 minute", "user", 3).writeStream.format("memory").queryName("over").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["user"], r["n"]) for r in spark.table("over").collect()] == [(1, 4)]
    q = events.first_seen(stream(), "ts", "1 hour", "user", "ts").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == 4


RULE = limits.Rule(window=60, most=2, strikes=3, ban=120)


def offences(seed, n=400):
    """Rows of three keys in order of time, each with quiet and busy stretches."""
    rng, t, out = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.choice([0.5, 3, 10, 40, 200])
        out.append((rng.choice([1, 1, 2, 3]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), i))
    return out


def plain_verdicts(rows):
    """The rule by lists of times: a window's allowed rows, violations that still count, and bans."""
    allowed, strikes, until, out = {}, {}, {}, {}
    for k, at, i in rows:
        s = (at - dt.datetime(2024, 1, 1)).total_seconds()
        mine = strikes.setdefault(k, [])
        if s < until.get(k, -1):
            out[i] = "banned"
        elif allowed.get((k, s // 60), 0) < 2:
            allowed[k, s // 60] = allowed.get((k, s // 60), 0) + 1
            out[i] = "allowed"
        else:
            out[i] = "limited"
            if mine and s >= mine[0] + 240:
                mine.clear()
            mine.append(s)
            if len(mine) == 3:
                until[k] = s + 120
                mine.clear()
    return out


def test_limits_over_a_table(spark):
    rows = offences(1)
    df = spark.createDataFrame([*rows, (None, rows[0][1], 900), (1, None, 901)], "k long, at timestamp, i long").repartition(3)
    got = {r["i"]: r["verdict"] for r in limits.verdicts(df, "k", "at", "i", RULE).collect()}
    assert got == plain_verdicts(rows) and set(got.values()) == {"allowed", "limited", "banned"}
    assert limits.verdicts(df.limit(0), "k", "at", "i", RULE).count() == 0


def test_limits_in_a_stream_with_a_restart(spark, tmp_path):
    rows, schema = offences(2, 300), "k long, at timestamp, i long"
    old = spark.conf.get(limits.ROCKSDB[0])
    spark.conf.set(*limits.ROCKSDB)
    try:
        for part, (a, b) in enumerate([(0, 90), (90, 200), (200, 300)]):  # the second and third run begin where the one before ended
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = events.dropped_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
            q = limits.limited(stream, "k", "at", "i", RULE, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(180)
        got = {r["i"]: r["verdict"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == plain_verdicts(rows)
        late = rows[-1][1] + dt.timedelta(days=1)
        for i in (998, 999):  # the second has the watermark that the first moves
            spark.createDataFrame([(9, late + dt.timedelta(days=i), i)], schema).write.mode("append").parquet(str(tmp_path / "in"))
            q = limits.limited(events.dropped_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), "k", "at", "i", RULE, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(180)
        kept = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "limit").load()
        assert {r["key"]["k"] for r in kept.collect()} <= {9}  # the others' states have expired
    finally:
        spark.conf.set(limits.ROCKSDB[0], old)


def test_status_of_a_job_that_fails_and_starts_again(spark, tmp_path):
    source, broken = str(tmp_path / "in"), [True]
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    now = [1000.0]

    def clock():
        now[0] += 2
        return now[0]

    def work(df):
        if broken[0] and df.where("id >= 20").count():
            raise ValueError("bad batch")
        return df

    own = lambda: status.Status(spark, str(tmp_path / "status"), "j", 40, clock)
    run = lambda: status.watched(status.start(events.dropped_files(spark, source, spark.range(1).schema, each=1), work, str(tmp_path / "out"), own(), str(tmp_path / "cp"), "0 seconds"), own())
    read = lambda at: [r.asDict() for r in status.statuses(spark, str(tmp_path / "status"), at).collect()]
    assert run() == "failed"
    (got,) = read(now[0])
    assert (got["status"], got["processed"], got["total"], got["percent"]) == ("failed", 20, 40, 50) and "bad batch" in got["error"] + "bad batch"
    assert got["seconds_left"] == 20 / (10 / 2)  # two updates two seconds apart
    broken[0] = False
    assert run() == "complete"
    (got,) = read(now[0])
    assert (got["status"], got["processed"], got["percent"], got["seconds_left"]) == ("complete", 40, 100, 0)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(40))
    own().update(3, 10)  # a batch that runs again replaces its own row
    assert read(now[0])[0]["processed"] == 40 and len(list((tmp_path / "status" / "job=j").glob("batch=*"))) <= 3
    assert read(now[0] + status.ENDED_S + 1) == []
    with pytest.raises(ValueError):
        own().ended("nearly")


def test_a_job_is_cancelled(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "in"))
    own = status.Status(spark, str(tmp_path / "status"), "c", 10)
    q = status.start(events.dropped_files(spark, str(tmp_path / "in"), spark.range(1).schema), lambda df: df, str(tmp_path / "out"), own, str(tmp_path / "cp"))
    began = time.time()
    assert status.watched(q, own, lambda: time.time() > began + 3) == "cancelled" and not q.isActive
    assert status.statuses(spark, str(tmp_path / "status")).first()["status"] == "cancelled"
