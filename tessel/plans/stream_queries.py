"""Queries over what streams leave behind and over their batch twins, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessel.sources.staging import shared_dir, staged
from tessel.sources.tables import table
from tessel.streaming import events, limits, status

c = F.col
#: Two rows a day; three violations within four days ban for two.
RULE = limits.Rule(window=86_400, most=2, strikes=3, ban=2 * 86_400)


def rate_limit_verdicts(spark, sf_dir):
    """Each event's verdict by the rate limiter with bans, over the whole table."""
    return limits.verdicts(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", RULE).select("event_id", "user_id", "verdict")


def job_status(spark, sf_dir):
    """The status of a job that a stream has run over events (four files, a batch each), as its table is read back, beside
    the rows that it wrote."""
    source = staged(table(spark, sf_dir, "events").repartition(4, "event_id"), "job-input")
    home = f"{shared_dir(spark)}/tessel/job-{uuid.uuid4().hex}"
    own = status.Status(spark, f"{home}/status", "events", source.count())
    stream = events.dropped_files(spark, source.inputFiles()[0].rpartition("/")[0], source.schema, each=1)
    status.watched(status.start(stream, lambda df: df.groupBy("event_type").agg(F.count("*").alias("n")), f"{home}/out", own, f"{home}/checkpoint"), own)
    wrote = spark.read.schema("event_type string, n long").parquet(f"{home}/out").groupBy("event_type").agg(F.sum("n").alias("n"))
    now = status.statuses(spark, f"{home}/status").select("job", "status", "processed", "total", "percent", "seconds_left")
    return wrote.join(F.broadcast(now))  # one job


QUERIES = {"rate_limit_verdicts": rate_limit_verdicts, "job_status": job_status}
_DAY = 86_400_000_000
ORACLE_SQL = {
    "rate_limit_verdicts": f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (
  SELECT user_id, event_id, k, 'allowed' AS verdict, us - us % {_DAY} AS start, 1 AS n, 0 AS strikes, 0::BIGINT AS first, -1::BIGINT AS until FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, event_id, k, verdict, start, n, CASE WHEN verdict = 'limited' AND struck >= {RULE.strikes} THEN 0 WHEN verdict = 'limited' THEN struck ELSE strikes END,
    CASE WHEN verdict <> 'limited' THEN first WHEN struck >= {RULE.strikes} THEN 0 WHEN struck = 1 THEN us ELSE first END, CASE WHEN verdict = 'limited' AND struck >= {RULE.strikes} THEN us + {RULE.ban * 1_000_000} ELSE until END
  FROM (SELECT *, CASE WHEN strikes > 0 AND us < first + {2 * RULE.ban * 1_000_000} THEN strikes + 1 ELSE 1 END AS struck
    FROM (SELECT e.user_id, e.event_id, e.k, e.us, s.strikes, s.first, s.until,
        CASE WHEN e.us < s.until THEN 'banned' WHEN e.us - e.us % {_DAY} > s.start OR s.n < {RULE.most} THEN 'allowed' ELSE 'limited' END AS verdict,
        CASE WHEN e.us >= s.until AND e.us - e.us % {_DAY} > s.start THEN e.us - e.us % {_DAY} ELSE s.start END AS start,
        CASE WHEN e.us < s.until THEN s.n WHEN e.us - e.us % {_DAY} > s.start THEN 1 WHEN s.n < {RULE.most} THEN s.n + 1 ELSE s.n END AS n
      FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)))
SELECT event_id, user_id, verdict FROM s
""",
    "job_status": "SELECT event_type, count(*) AS n, 'events' AS job, 'complete' AS status, (SELECT count(*) FROM events) AS processed, (SELECT count(*) FROM events) AS total, 100 AS percent, 0 AS seconds_left FROM events GROUP BY 1",
}
