"""Queries over stored profiles, routed lookups, differences of structs and pages of a stored order, and their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from tessel.functions import descriptors as D
from tessel.operators import differences, lookups, pages
from tessel.operators.differences import Field
from tessel.operators.profile_store import Profiles
from tessel.plans import score_queries
from tessel.sources.staging import shared_dir
from tessel.sources.tables import table

c = F.col
PAGE, SIZE = 3, 50
MPO = {"name": "mine", "properties": [{"property": "LogP", "low": 0, "high": 5, "weight": 2}, {"property": "TPSA", "low": 20, "high": 140, "shape": "ramp"}, {"property": "Fsp3", "low": 0, "high": 0.42, "shape": "step", "weight": 1.0}]}
FIRST = {"name": "mine", "thresholds": {"mw": {"min": 0, "max": 400}}}


def _folder(spark, name):
    return f"{shared_dir(spark)}/tessel/{name}-{uuid.uuid4().hex}"


def stored_profiles(spark, sf_dir):
    """Order lines scored by profiles that are read back from a table: a preset, and the second version of one's own."""
    own = Profiles(spark, _folder(spark, "profiles"))
    own.seed()
    own.create(json.dumps(FIRST))
    own.update(json.dumps(MPO))
    rows = D.from_lineitem(table(spark, sf_dir, "lineitem"))
    return rows.select(*D.KEYS, F.round(own.score("mine"), 6).alias("mpo"), F.round(own.score("Lead-like"), 4).alias("lead"))


def routed_lookup(spark, sf_dir):
    """Customers' identifiers of several types, looked up in parts, customers and pages; what a type does not know is a name."""
    part, customer, page = (table(spark, sf_dir, t) for t in ("part", "customer", "pages"))
    k = c("c_custkey")
    asked = customer.select(k, F.when(k % 5 == 0, F.concat(F.lit(" chembl"), k)).when(k % 5 == 1, F.concat(F.lit("CID:"), k)).when(k % 5 == 2, c("c_name")).when(k % 5 == 3, F.concat(F.lit("DB"), F.lpad((k % 100000).cast("string"), 5, "0"))).otherwise(F.concat(F.lit("https://en.wikipedia.org/wiki/"), k)).alias("identifier"))
    sources = [
        lookups.Source("parts", part, {"chembl_id": F.concat(F.lit("CHEMBL"), "p_partkey"), "name": c("p_name")}, c("p_brand")),
        lookups.Source("customers", customer, {"pubchem_cid": k, "name": c("c_name"), "chembl_id": F.concat(F.lit("CHEMBL"), k)}, c("c_mktsegment")),
        lookups.Source("pages", page, {"wikipedia": F.concat(F.lit("https://en.wikipedia.org/wiki/"), "page_id")}, c("page_id")),
    ]
    return lookups.resolved(asked, "c_custkey", "identifier", sources)


#: Four comparisons as declarations of the one rule.
CLEANED = [Field("heavy", "count"), Field("rings", "count"), Field("mw", "percent", 2), Field("hbd", "key")]
ROUND_TRIP = [Field("charge", "loss"), Field("arom", "loss"), Field("rings", "loss"), Field("heavy", "key"), Field("charge", "key")]
PROPERTIES = [Field("mw", "delta", 2), Field("logp", "delta", 2), Field("tpsa", "delta", 2), Field("hba", "delta"), Field("hbd", "delta")]
SCORES = [Field("qed", "delta", 3), Field("sa", "delta", 2), Field("fsp3", "loss", 3), Field("rotb", "key")]


def _ends(spark, sf_dir):
    """Descriptors of each order's first and last line; orders of one line have no second side."""
    rows = D.from_lineitem(table(spark, sf_dir, "lineitem"))
    record = F.struct("l_linenumber", *(n for n in rows.columns if n not in D.KEYS))  # lines with one number: by the others
    both = rows.groupBy("l_orderkey").agg(F.min(record).alias("before"), F.max(record).alias("after"), F.count("*").alias("n"))
    return both.select("l_orderkey", "before", F.when(c("n") > 1, c("after")).alias("after"))


def _difference(fields, name):
    def query(spark, sf_dir):
        d = _ends(spark, sf_dir).select("l_orderkey", differences.difference(c("before"), c("after"), fields).alias("d")).select("l_orderkey", "d.*")
        return d.withColumn("losses", F.concat_ws(",", "losses")).withColumn("n_changed", F.size("changed").cast("long")).drop("changed")

    query.__name__ = name
    return query


cleaning_difference, round_trip_difference, property_difference, score_difference = (_difference(f, n) for f, n in ((CLEANED, "cleaning_difference"), (ROUND_TRIP, "round_trip_difference"), (PROPERTIES, "property_difference"), (SCORES, "score_difference")))


def stored_page(spark, sf_dir):
    """A page of orders by price, from an order that is stored once."""
    folder = _folder(spark, "order")
    pages.store(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey", "o_orderstatus"), ["o_totalprice", "o_orderkey"], folder)
    return pages.Stored(spark, folder).page(PAGE, SIZE)


QUERIES = {f.__name__: f for f in (stored_profiles, routed_lookup, cleaning_difference, round_trip_difference, property_difference, score_difference, stored_page)}

_LEAD = {"mw": (200.0, 450.0), "logp": (-1.0, 4.0), "rotb": (0.0, 7.0)}


def _sql(fields):
    """SQL of a difference over the first (a) and last (b) line."""
    out, losses, keys, changed = [], [], [], []
    for f in fields:
        a, b = f"a.{f.name}", f"b.{f.name}"
        if f.kind in ("delta", "count", "loss"):
            out.append(f"round({b} - {a}, {f.places}) AS {f.name}_delta")
        if f.kind == "percent":
            out.append(f"round(CASE WHEN {a} = 0 THEN 0.0 ELSE ({b} - {a}) / {a}::DOUBLE * 100 END, {f.places}) AS {f.name}_percent")
        if f.kind == "count":
            out += [f"CASE WHEN {b} IS NOT NULL THEN greatest({b} - {a}, 0) END AS {f.name}_added", f"CASE WHEN {b} IS NOT NULL THEN greatest({a} - {b}, 0) END AS {f.name}_removed"]
        if f.kind == "loss":
            losses.append(f"CASE WHEN {b} < {a} THEN '{f.name}' END")
        if f.kind == "key":
            keys.append(f"{a} IS NOT DISTINCT FROM {b}")
        changed.append(f"(b.l_orderkey IS NOT NULL AND {a} IS DISTINCT FROM {b})::INT")
    return f"""WITH {D.SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, mw, logp, tpsa, hbd, hba, rotb, rings, arom, fsp3, heavy, mr, qed, charge, sa, activity, basic_n) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM descriptors)
      SELECT a.l_orderkey, {", ".join(out)}{", " if out else ""}concat_ws(',', {", ".join(losses) or "NULL"}) AS losses, {" + ".join(changed)} AS n_changed, {" AND ".join(["b.l_orderkey IS NOT NULL", *keys])} AS identical, b.l_orderkey IS NOT NULL AS comparable
      FROM (SELECT * FROM e WHERE k = 1) a LEFT JOIN (SELECT * FROM e WHERE k = n AND n > 1) b ON a.l_orderkey = b.l_orderkey"""


ORACLE_SQL = {
    "stored_profiles": score_queries.ORACLE_SQL["mpo_custom"].replace(" AS mpo FROM descriptors", " AS mpo, round(power(" + " * ".join(score_queries._des(n, *r) for n, r in _LEAD.items()) + ", 1.0 / 3.0) * 100, 4) AS lead FROM descriptors"),
    "routed_lookup": """
WITH q AS (SELECT c_custkey, c_custkey % 5 AS k, c_name, c_mktsegment FROM customer),
a AS (SELECT c_custkey, k, CASE k WHEN 0 THEN ' chembl' || c_custkey WHEN 1 THEN 'CID:' || c_custkey WHEN 2 THEN c_name WHEN 3 THEN 'DB' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') ELSE 'https://en.wikipedia.org/wiki/' || c_custkey END AS identifier,
  CASE k WHEN 0 THEN 'chembl_id' WHEN 1 THEN 'pubchem_cid' WHEN 2 THEN CASE WHEN contains(c_name, '#') THEN 'smiles' ELSE 'name' END WHEN 3 THEN 'drugbank_id' ELSE 'wikipedia' END AS type, c_mktsegment FROM q),
n AS (SELECT lower(p_name) AS id, min(p_brand) AS brand FROM part GROUP BY 1), m AS (SELECT lower(c_name) AS id, min(c_mktsegment) AS segment FROM customer GROUP BY 1)
SELECT c_custkey, identifier, type, CASE k WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN n.id IS NOT NULL OR m.id IS NOT NULL ELSE page_id IS NOT NULL END AS resolved,
  CASE k WHEN 0 THEN coalesce(p_brand, c_mktsegment) WHEN 1 THEN c_mktsegment WHEN 4 THEN page_id::VARCHAR ELSE coalesce(brand, segment) END AS answer,
  CASE k WHEN 0 THEN CASE WHEN p_partkey IS NOT NULL THEN 'parts' ELSE 'customers' END WHEN 1 THEN 'customers' WHEN 4 THEN CASE WHEN page_id IS NOT NULL THEN 'pages' END ELSE CASE WHEN n.id IS NOT NULL THEN 'parts' WHEN m.id IS NOT NULL THEN 'customers' END END AS source,
  CASE k WHEN 0 THEN 'chembl_id' WHEN 1 THEN 'pubchem_cid' WHEN 4 THEN CASE WHEN page_id IS NOT NULL THEN 'wikipedia' END ELSE CASE WHEN n.id IS NOT NULL OR m.id IS NOT NULL THEN 'name' END END AS found_as
FROM a LEFT JOIN part ON k = 0 AND p_partkey = c_custkey LEFT JOIN (SELECT DISTINCT page_id FROM pages) pg ON k = 4 AND page_id = c_custkey LEFT JOIN n ON k IN (2, 3) AND n.id = lower(identifier) LEFT JOIN m ON k IN (2, 3) AND m.id = lower(identifier)
""",
    **{n: _sql(f) for n, f in (("cleaning_difference", CLEANED), ("round_trip_difference", ROUND_TRIP), ("property_difference", PROPERTIES), ("score_difference", SCORES))},
    "stored_page": f"SELECT o_totalprice, o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row, count(*) OVER () AS total, ceil(count(*) OVER () / {SIZE}.0)::BIGINT AS pages FROM orders ORDER BY o_totalprice, o_orderkey LIMIT {SIZE} OFFSET {(PAGE - 1) * SIZE}",
}
