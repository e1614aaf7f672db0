"""URL filter by a temporal list join.

A list is dated entries (pattern, action, day): `block` and `allow` put a pattern on the list in that sense from that day
on, `drop` takes it off. Each pattern's entries become validity intervals, and every capture is evaluated against the
entries that were active when it was fetched (an as-of join). A pattern is a domain (matches it and its subdomains) or a
host with a path prefix (whole segments); the longest active pattern decides, block before allow among equals.

Captures are first reduced to distinct (url, day), so a site that is most of the table costs its distinct URLs; their keys
meet the list in an equi-join whose list side is broadcast only when it has at most BROADCAST_ENTRIES rows; beyond it keys
of many captures are dealt over tasks.

A null or unparsable URL or a null day matches nothing and is kept; repeated rows each get a row; several entries of a
pattern on one day: the last action in the order drop, allow, block holds; null patterns are skipped; an empty list keeps
everything, an empty table gives an empty result; a very long URL has as many keys as labels and path segments; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm.common import dealt_join, small_enough

#: The list that the registered query applies: (pattern, action, first day).
LIST = [
    ("casino-win.example.com", "block", "2023-06-01"),
    ("free-bets.example.com", "block", "2024-02-01"),
    ("free-bets.example.com", "drop", "2024-07-01"),
    ("free-bets.example.com", "block", "2024-10-01"),
    ("cheap-pills.example.com", "block", "2024-03-15"),
    ("cheap-pills.example.com/de", "allow", "2024-05-01"),
    ("ads-track.example.com", "block", "2023-01-01"),
    ("spam-farm.example.com", "block", "2023-01-01"),
    ("spam-farm.example.org", "block", "2023-01-01"),
    ("adult-x.example.net", "block", "2024-01-10"),
    ("blog.adult-x.example.net/en", "allow", "2024-08-01"),
    ("blog.adult-x.example.net/en", "drop", "2024-11-01"),
]
BROADCAST_ENTRIES = 100_000
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?(/[^?#]*)?"


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, since, until (exclusive, null: open) of each entry that is active for a day or more."""
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    day = entries.where("pattern is not null and day is not null").groupBy("pattern", "day").agg(F.max_by("action", rank).alias("action"))
    following = Window.partitionBy("pattern").orderBy("day")
    return day.withColumn("until", F.lead("day").over(following)).where(F.col("action") != "drop").select("pattern", "action", F.col("day").alias("since"), "until")


def keys(url: Column) -> Column:
    """Every pattern that could match a URL: its host and parent domains of two labels or more, and host and path."""
    host = F.lower(F.regexp_extract(url, _URL, 1))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.regexp_extract(url, _URL, 2), "/"), lambda p: p != "")
    paths = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat_ws("/", host, F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host != "", F.concat(domains, F.when(F.size(parts) > 0, paths).otherwise(F.array().cast("array<string>"))))


def evaluated(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, day) with blocked, and the pattern and first day of the entry that decided."""
    active = intervals(entries)
    seen = captures.select("url", "day").where("url is not null and day is not null").distinct()
    keyed = seen.select("url", "day", F.explode(keys(F.col("url"))).alias("pattern"))
    # a host of a third of all pages is one key: beyond a broadcast its captures are dealt over tasks
    both = keyed.join(F.broadcast(active), "pattern") if small_enough(active, BROADCAST_ENTRIES) else dealt_join(keyed, active, ["pattern"], "inner")
    met = both.where((F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    order = F.struct(F.length("pattern"), (F.col("action") == "block").cast("int"), "pattern", "since")
    verdict = met.groupBy("url", "day").agg(F.max_by(F.struct("pattern", "action", "since"), order).alias("v"))
    return captures.select("page_id", "url", "day").join(verdict, ["url", "day"], "left").select("page_id", "url", "day", F.coalesce((F.col("v.action") == "block").cast("int"), F.lit(0)).alias("blocked"), F.col("v.pattern").alias("pattern"), F.col("v.since").alias("since"))


def op1_temporal_list(spark, sf_dir):
    """The table has no fetch day: page_id's remainder by 366 stands for it, as days from 2024-01-01."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("day"))
    entries = spark.createDataFrame(LIST, "pattern string, action string, day string").withColumn("day", F.col("day").cast("date"))
    return evaluated(captures, entries)


OP1_SQL = f"""
WITH entries(pattern, action, day) AS (VALUES {", ".join(f"('{p}', '{a}', DATE '{d}')" for p, a, d in LIST)}),
active AS (
  SELECT * FROM (SELECT pattern, action, day AS since, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until FROM entries)
  WHERE action <> 'drop'),
captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day,
    lower(regexp_extract(url, '{_URL}', 1)) AS host, regexp_extract(url, '{_URL}', 2) AS path FROM pages),
parts AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS steps FROM captures),
keyed AS (
  SELECT page_id, url, day, unnest(list_concat(
    list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: array_to_string(list_slice(labels, i, len(labels)), '.')),
    list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(list_slice(steps, 1, i), '/')))) AS pattern
  FROM parts WHERE host <> ''),
met AS (
  SELECT page_id, k.pattern, action, since, row_number() OVER (PARTITION BY page_id ORDER BY length(k.pattern) DESC, action = 'block' DESC, k.pattern DESC) AS r
  FROM keyed k JOIN active a ON k.pattern = a.pattern AND k.day >= a.since AND (a.until IS NULL OR k.day < a.until))
SELECT c.page_id, c.url, c.day, CASE WHEN m.action = 'block' THEN 1 ELSE 0 END AS blocked, m.pattern, m.since
FROM captures c LEFT JOIN (SELECT * FROM met WHERE r = 1) m ON c.page_id = m.page_id
"""
