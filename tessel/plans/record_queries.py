"""Queries over structure notations, exports' groupings and agreement of pipelines, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.functions import structures as X
from tessel.operators import checks, screen, view
from tessel.plans.table_queries import _SCORE, RULES, documents, scored
from tessel.sources.tables import table

c = F.col


def notations(spark, sf_dir):
    """Line notations made of parts: a chain, and a salt, a ring or an isotope by key."""
    key = F.pmod("p_partkey", F.lit(6))
    tail = F.when(key == 0, "").when(key == 1, ".Cl").when(key == 2, "(=O)[O-].[Na+]").when(key == 3, "c1ccccc1").when(key == 4, "[2H]").otherwise("[NH3+].O")
    chain = F.expr("repeat('C', cast(1 + pmod(p_size, 9) as int))")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(chain, tail).alias("smiles"))


def structure_counts(spark, sf_dir):
    s = c("smiles")
    return notations(spark, sf_dir).select("p_partkey", F.size(X.fragments(s)).cast("long").alias("fragments"), X.heavy_atoms(s).cast("long").alias("heavy"), X.formal_charge(s).cast("long").alias("charge"), X.without_isotopes(s).alias("plain"))


def salt_inventory(spark, sf_dir):
    f = notations(spark, sf_dir).select(F.explode(X.fragments(c("smiles"))).alias("f")).select(X.fragment_kind(c("f")).alias("kind"))
    return f.groupBy("kind").agg(F.count("*").alias("n"))


def structure_issues(spark, sf_dir):
    return checks.summary(checks.checked(notations(spark, sf_dir), X.checks()))


def pipeline_agreement(spark, sf_dir):
    """Three clean-up pipelines of a text and three properties: whether all agree, and how many of the properties do."""
    t = c("text")
    forms = {"trimmed": F.trim(t), "lowered": F.lower(t), "spaced": F.regexp_replace(t, "[ \t\n]+", " ")}
    values = F.array(*(F.struct(F.lit(p).alias("property"), v(x).cast("string").alias("value")) for x in forms.values() for p, v in (("length", F.length), ("md5", F.md5), ("words", lambda y: F.size(F.split(y, " "))))))
    long = documents(spark, sf_dir).select("doc_id", F.explode(values).alias("x")).select("doc_id", "x.property", "x.value")
    agree = long.groupBy("doc_id", "property").agg((F.count_distinct("value") == 1).alias("same"))
    return agree.groupBy("doc_id").agg(F.count_if("same").alias("agreeing"), F.bool_and("same").alias("all_agree"))


def screen_summary(spark, sf_dir):
    """For each source of rules, the documents that pass it and those that do not."""
    d = documents(spark, sf_dir)
    hit = screen.hits(d, c("text"), RULES, "doc_id").groupBy("source").agg(F.count_distinct("doc_id").alias("failed"), F.count("*").alias("hits"))
    total = d.agg(F.count_distinct("doc_id").alias("total"))
    return hit.join(F.broadcast(total)).select("source", "hits", "failed", (c("total") - c("failed")).alias("passed"))  # one row


def critical_issues(spark, sf_dir):
    """The first 20 rows with a failed critical check, lowest scores first."""
    bad = scored(spark, sf_dir).where(F.exists("checks", lambda k: (k["severity"] == "critical") & ~k["passed"]))
    return bad.orderBy("score", "l_orderkey", "l_linenumber").limit(20).select("l_orderkey", "l_linenumber", "score")


def group_numbers(spark, sf_dir):
    """Parts with their brand's number in alphabetical order (the brands are ranked apart, then joined)."""
    part = table(spark, sf_dir, "part")
    brands = part.select("p_brand").distinct().withColumn("group_id", F.dense_rank().over(Window.orderBy("p_brand")))
    return part.select("p_partkey", "p_brand").join(brands, "p_brand")


def expired_events(spark, sf_dir):
    """Events more than 20 days older than the newest, by type: what a purge would drop."""
    e = table(spark, sf_dir, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    return e.join(F.broadcast(newest)).where(c("ts") < c("newest") - F.expr("INTERVAL 20 DAYS")).groupBy("event_type").agg(F.count("*").alias("n"))  # one row


def cache_keys(spark, sf_dir):
    """Keys of customers' validation results: version, name and the hash of the sorted checks."""
    names = F.array_join(F.array_sort(F.array(F.lit("valence"), F.lit("parsability"), F.lit("connectivity"))), ",")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(":", F.lit("v1"), "c_name", F.substring(F.sha2(names, 256), 1, 16)).alias("key"))


def audit_outcomes(spark, sf_dir):
    """Outcome of each order's lines as one batch, and its worst line's."""
    by = scored(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(c("score") < 40).alias("failed"), F.min("score").alias("worst"))
    return by.select("l_orderkey", view.batch_outcome(c("n"), c("failed")).alias("batch"), view.outcome(c("worst")).alias("worst"))


def settled_statuses(spark, sf_dir):
    """Orders' statuses after an update; F is terminal."""
    o = table(spark, sf_dir, "orders")
    old, new = o.where("o_orderkey % 3 <> 0").select("o_orderkey", c("o_orderstatus").alias("status")), o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("Z").alias("status"))
    return view.settled_statuses(old, new, "o_orderkey", ("F",))


QUERIES = {f.__name__: f for f in (structure_counts, salt_inventory, structure_issues, pipeline_agreement, screen_summary, critical_issues, group_numbers, expired_events, cache_keys, audit_outcomes, settled_statuses)}

_NOTES = "n AS (SELECT p_partkey, repeat('C', (1 + p_size % 9)::INTEGER) || CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '.Cl' WHEN 2 THEN '(=O)[O-].[Na+]' WHEN 3 THEN 'c1ccccc1' WHEN 4 THEN '[2H]' ELSE '[NH3+].O' END AS smiles, p_partkey % 6 AS k, 1 + p_size % 9 AS chain FROM part)"
_BAD = "NOT l_quantity <= 45"
_HIT = " UNION ALL ".join(f"SELECT doc_id, '{r.source}' AS source FROM documents WHERE regexp_matches(lower(text), '{r.pattern}')" for r in RULES)
_FORMS = ("trim(text)", "lower(text)", "regexp_replace(text, '[ \t\n]+', ' ', 'g')")
_PROPS = " UNION ALL ".join(f"SELECT doc_id, '{p}' AS property, {e.format(f)}::VARCHAR AS value FROM documents" for f in _FORMS for p, e in (("length", "length({})"), ("md5", "md5({})"), ("words", "len(string_split({}, ' '))")))
_ISSUES = {
    ("connectivity", "warning"): "k IN (1, 2, 5)",
    ("solvent_contamination", "warning"): "k = 5",
    ("metal", "warning"): "k = 2",
    ("isotope_label_detection", "info"): "k = 4",
    ("trivial_molecule", "error"): "heavy <= 3",
    ("charged_species", "info"): "k = 5",
}
ORACLE_SQL = {
    "structure_counts": f"WITH {_NOTES} SELECT p_partkey, len(string_split(smiles, '.')) AS fragments, (chain + CASE k WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 6 WHEN 5 THEN 2 ELSE 0 END)::BIGINT AS heavy, (CASE k WHEN 5 THEN 1 ELSE 0 END)::BIGINT AS charge, regexp_replace(smiles, '\\[[0-9]+', '[', 'g') AS plain FROM n",
    "salt_inventory": f"WITH {_NOTES}, f AS (SELECT unnest(string_split(smiles, '.')) AS f FROM n) SELECT CASE WHEN f IN ('Cl', '[Na+]') THEN 'counterion' WHEN f IN ('O', 'CO', 'CCO') THEN 'solvent' WHEN len(regexp_extract_all(replace(f, '[2H]', ''), '\\[[^\\]]*\\]|Br|Cl|[BCNOPSFIbcnops]')) >= 6 THEN 'drug' ELSE 'unknown' END AS kind, count(*) AS n FROM f GROUP BY 1",
    "structure_issues": f"WITH {_NOTES}, h AS (SELECT *, chain + CASE k WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 6 WHEN 5 THEN 2 ELSE 0 END AS heavy FROM n) " + " UNION ALL ".join(f"SELECT '{n}' AS name, '{s}' AS severity, count(*) AS n FROM h WHERE {w} HAVING count(*) > 0" for (n, s), w in _ISSUES.items()),
    "pipeline_agreement": f"WITH p AS ({_PROPS}), a AS (SELECT doc_id, property, count(DISTINCT value) = 1 AS same FROM p GROUP BY 1, 2) SELECT doc_id, count(*) FILTER (same) AS agreeing, bool_and(same) AS all_agree FROM a GROUP BY 1",
    "screen_summary": f"SELECT source, count(*) AS hits, count(DISTINCT doc_id) AS failed, (SELECT count(DISTINCT doc_id) FROM documents) - count(DISTINCT doc_id) AS passed FROM ({_HIT}) GROUP BY 1",
    "critical_issues": f"SELECT l_orderkey, l_linenumber, greatest(0, 100 - 50 - 20 * (NOT l_discount < 0.08)::INT - 5 * (NOT l_tax < 0.06)::INT - 5 * (l_returnflag = 'R')::INT)::BIGINT AS score FROM lineitem WHERE {_BAD} ORDER BY 3, 1, 2 LIMIT 20",
    "group_numbers": "SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand)::INTEGER AS group_id FROM part",
    "expired_events": "SELECT event_type, count(*) AS n FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 20 DAY GROUP BY 1",
    "audit_outcomes": f"WITH s AS (SELECT l_orderkey, {_SCORE} AS score FROM lineitem) SELECT l_orderkey, CASE WHEN count(*) FILTER (score < 40) = 0 THEN 'pass' WHEN count(*) FILTER (score < 40) * 2 < count(*) THEN 'warn' ELSE 'fail' END AS batch, CASE WHEN min(score) >= 70 THEN 'pass' WHEN min(score) >= 40 THEN 'warn' ELSE 'fail' END AS worst FROM s GROUP BY 1",
    "settled_statuses": "WITH p AS (SELECT o_orderkey, o_orderstatus AS was FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, 'Z' AS now FROM orders WHERE o_orderkey % 2 = 0) SELECT coalesce(p.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN was = 'F' OR now IS NULL THEN was ELSE now END AS status FROM p FULL JOIN n ON p.o_orderkey = n.o_orderkey",
    "cache_keys": "SELECT c_custkey, concat_ws(':', 'v1', c_name, substr(sha256('connectivity,parsability,valence'), 1, 16)) AS key FROM customer",
}
