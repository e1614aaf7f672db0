"""Queries over issues, contradictory entries, presets that act and property names of two versions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import audit, funnel, issues, screen
from tessel.plans.record_queries import notations
from tessel.sources.tables import table

c = F.col
RULES = [
    screen.Rule("symbols", "[#*$%&]{3}", "format", "warning", "PAINS"),
    screen.Rule("mail", "[a-z0-9.]+@[a-z0-9]", "private", "critical", "Brenk"),
    screen.Rule("digits", "[0-9]{6}", "private", "warning", "Brenk"),
    screen.Rule("licence", "license", "legal", "info", "Kazius"),
    screen.Rule("letters", "[a-z]{14}", "format", "info", "NIBR"),
]
_OK = "length(text) > 40"


def issue_rows(spark, sf_dir):
    t = c("text")
    alerts = F.regexp_like(t, F.lit("[#*$%&]{3}")).cast("int") + F.regexp_like(t, F.lit("[0-9]{6}")).cast("int")
    return issues.issue_rows(table(spark, sf_dir, "documents"), "doc_id", "text", F.expr(_OK), t.endswith("."), F.md5(t), alerts, t == F.trim(t))


def contradictory_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", (c("l_orderkey") * 8 + c("l_linenumber")).alias("index"))
    return issues.contradictory_entries(rows, "l_partkey", "l_quantity", "index")


def curation_steps(spark, sf_dir):
    x = funnel.curated_by(notations(spark, sf_dir), "smiles", "2d").select("p_partkey", F.explode("steps").alias("x"))
    return x.select("p_partkey", "x.step", "x.status", F.coalesce("x.after", F.lit("")).alias("after"))


def preset_alerts(spark, sf_dir):
    """Alerts of each document under each preset's catalogues."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = [funnel.preset_alerts(d, "text", RULES, "doc_id", p).select("doc_id", F.lit(p).alias("preset"), "alerts") for p in funnel.PRESETS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def catalogue_listing(spark, sf_dir):
    """Catalogues with their rules by severity, and how many hits they have in the documents."""
    hits = screen.hits(table(spark, sf_dir, "documents"), c("text"), RULES, "doc_id").groupBy("source").agg(F.count("*").alias("hits"))
    return screen.catalogue_listing(screen.rule_table(spark, RULES)).join(hits, "source", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))


def property_sets(spark, sf_dir):
    """Brands as property names: of small parts, and of dear ones."""
    part = table(spark, sf_dir, "part").withColumn("properties", F.create_map("p_brand", "p_size"))
    return audit.property_sets(part.where("p_size < 6"), part.where("p_retailprice > 1000"), "properties")


QUERIES = {f.__name__: f for f in (issue_rows, contradictory_entries, curation_steps, preset_alerts, catalogue_listing, property_sets)}

_HITS = " UNION ALL ".join(f"SELECT doc_id, '{r.source}' AS source FROM documents WHERE regexp_matches(lower(text), '{r.pattern}')" for r in RULES)
_named = lambda p: ", ".join(f"'{r.source}'" for r in funnel.preset_rules(RULES, p)) or "''"
_n = lambda s: f"count(*) FILTER (severity = '{s}') AS {s}"

ORACLE_SQL = {
    "issue_rows": rf"""WITH r AS (SELECT doc_id AS row_index, text AS smiles, coalesce({_OK}, false) AS ok, regexp_matches(text, '[#*$%&]{{3}}')::INT + regexp_matches(text, '[0-9]{{6}}')::INT AS n, row_number() OVER (PARTITION BY text, coalesce({_OK}, false) ORDER BY doc_id) AS nth FROM documents)
      SELECT row_index, smiles, 'parse_failure' AS issue_type, 'critical' AS severity, 'SMILES could not be parsed: ''' || coalesce(smiles, '') || '''' AS description FROM r WHERE NOT ok
      UNION ALL SELECT row_index, smiles, 'undefined_stereo', 'warning', 'Molecule has undefined stereocenters' FROM r WHERE ok AND NOT ends_with(smiles, '.')
      UNION ALL SELECT row_index, smiles, 'alert_hit', 'warning', 'Triggered ' || n || ' structural alert(s)' FROM r WHERE ok AND n > 0
      UNION ALL SELECT row_index, smiles, 'std_disagreement', 'info', 'Standardization pipelines disagree' FROM r WHERE ok AND smiles <> trim(smiles)
      UNION ALL SELECT row_index, '', 'duplicate', 'info', 'Duplicate InChIKey: ' || md5(smiles) FROM r WHERE ok AND nth > 1""",
    "contradictory_entries": """WITH g AS (SELECT l_partkey, round(max(l_quantity) / greatest(min(l_quantity), 1e-10), 1) AS fold FROM lineitem WHERE l_quantity > 0 GROUP BY 1 HAVING count(*) >= 2 AND max(l_quantity) / greatest(min(l_quantity), 1e-10) > 10)
      SELECT row_number() OVER (ORDER BY fold DESC, l_partkey, l_quantity, l_orderkey * 8 + l_linenumber) - 1 AS place, l_partkey, l_orderkey * 8 + l_linenumber AS index, l_quantity::DOUBLE AS activity, fold FROM lineitem JOIN g USING (l_partkey) WHERE l_quantity > 0""",
    "curation_steps": r"""WITH n AS (SELECT p_partkey, p_partkey % 6 AS k, 1 + p_size % 9 AS chain FROM part),
      a AS (SELECT *, repeat('C', chain::INT) || CASE k WHEN 1 THEN '.Cl' WHEN 2 THEN '(=O)[O-].[Na+]' WHEN 3 THEN 'c1ccccc1' WHEN 4 THEN '[2H]' WHEN 5 THEN '[NH3+].O' ELSE '' END AS s0 FROM n),
      b AS (SELECT *, CASE WHEN k = 1 AND chain = 1 THEN 'Cl' WHEN k = 0 OR k = 3 OR k = 4 THEN s0 ELSE split_part(s0, '.', 1) END AS s1 FROM a), d AS (SELECT *, replace(s1, '[2H]', '[H]') AS s2 FROM b)
      SELECT p_partkey, 'desalt' AS step, CASE WHEN s0 = s1 THEN 'no_change' ELSE 'applied' END AS status, s1 AS after FROM d UNION ALL SELECT p_partkey, 'stereo', 'no_change', s1 FROM d
      UNION ALL SELECT p_partkey, 'isotope', CASE WHEN s1 = s2 THEN 'no_change' ELSE 'applied' END, s2 FROM d UNION ALL SELECT p_partkey, unnest(['metals', 'normalize', 'neutralize', 'tautomer']), 'skipped', '' FROM d""",
    "preset_alerts": f"WITH h AS ({_HITS}) " + " UNION ALL ".join(f"SELECT d.doc_id, '{p}' AS preset, count(h.source) AS alerts FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id AND h.source IN ({_named(p)}) GROUP BY 1" for p in funnel.PRESETS),
    "catalogue_listing": f"WITH h AS ({_HITS}), r AS (SELECT * FROM (VALUES " + ", ".join(f"('{r.source}', '{r.severity}', '{r.group}')" for r in RULES) + f") v(source, severity, concern)) SELECT source, count(*) AS rules, {_n('critical')}, {_n('warning')}, {_n('info')}, string_agg(DISTINCT concern, ',' ORDER BY concern) AS concerns, (SELECT count(*) FROM h WHERE h.source = r.source) AS hits FROM r GROUP BY 1",
    "property_sets": "WITH a AS (SELECT p_brand AS name, count(*) AS n_primary FROM part WHERE p_size < 6 GROUP BY 1), b AS (SELECT p_brand AS name, count(*) AS n_comparison FROM part WHERE p_retailprice > 1000 GROUP BY 1) SELECT name, CASE WHEN n_primary IS NULL THEN 'added' WHEN n_comparison IS NULL THEN 'removed' ELSE 'common' END AS state, coalesce(n_primary, 0) AS n_primary, coalesce(n_comparison, 0) AS n_comparison FROM a FULL JOIN b USING (name)",
}
