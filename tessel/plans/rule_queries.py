"""Queries over names, presets, exports and composed flows, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import descriptors as D
from tessel.functions import scoring as S
from tessel.functions import text as T
from tessel.operators import audit, dedup, export_columns, flow, funnel, pairs, screen, stats, view
from tessel.plans.score_queries import PROFILE, WEIGHTS
from tessel.plans.table_queries import _SCORE, LINE_CHECKS, RULES, documents, scored
from tessel.sources.tables import table

c = F.col


def _names(spark, sf_dir):
    t = lambda n, col: table(spark, sf_dir, n).select(c(col).alias("v"))
    return t("part", "p_name").union(t("part", "p_brand")).union(t("customer", "c_mktsegment")).union(t("pages", "url")).union(t("nation", "n_name"))


def name_kinds(spark, sf_dir):
    """Names by what they look like: notation or systematic name, format, and whether they may head a column."""
    kinds = _names(spark, sf_dir).select(T.notation_or_name(c("v")).alias("kind"), T.format_of(c("v")).alias("format"), T.column_name_ok(c("v")).alias("column_ok"))
    return kinds.groupBy("kind", "format", "column_ok").agg(F.count("*").alias("n"))


def pattern_severities(spark, sf_dir):
    """Part names as pattern names, and as descriptions with a code."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.pmod("p_partkey", F.lit(5)) == 0, F.concat(c("p_name"), F.lit(" Epoxide"))).otherwise(c("p_name"))
    code = F.when(F.pmod("p_partkey", F.lit(7)) == 6, "x").otherwise(F.pmod("p_partkey", F.lit(4)).cast("string"))
    full = F.when(F.pmod("p_partkey", F.lit(11)) == 0, c("p_name")).otherwise(F.concat(F.lit("SET|| "), c("p_name"), F.lit(" ||"), code, F.lit("||0||0")))
    described = T.piped(full)
    return p.select("p_partkey", T.severity_of(name).alias("severity"), described["name"].alias("name"), described["severity"].alias("coded"))


def view_keys(spark, sf_dir):
    """Cache keys of orders' views, some parameters missing."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.view_key(c("o_orderkey").cast("string"), c("o_orderstatus"), F.when(F.pmod("o_orderkey", F.lit(3)) > 0, c("o_orderpriority")), F.lit("score")).alias("key"))


def likeness(spark, sf_dir):
    d = D.from_lineitem(table(spark, sf_dir, "lineitem"))
    share = lambda x, n: (F.pmod(x, F.lit(n)) / n).cast("double")
    rows = d.withColumns({"ring_share": share("hba", 10), "oxygen_share": share("rotb", 12), "nitrogen_share": share("hbd", 16), "halogens": F.pmod("rotb", F.lit(5)), "chiral": F.pmod("hba", F.lit(4))})
    return rows.select(*D.KEYS, S.likeness().alias("likeness"), S.likeness_band(S.likeness()).alias("band"), S.density_points(c("tpsa"), F.lit(256)).alias("density"))


def radar_comparison(spark, sf_dir):
    return S.radar_comparison(D.from_lineitem(table(spark, sf_dir, "lineitem")), *D.KEYS, places=6)


def _bit_scores(spark):
    """A score for each bit of the embeddings' fingerprints: a row for each dimension."""
    return spark.range(64).select(c("id").cast("int").alias("part"), F.concat(F.lit("g"), F.pmod("id", F.lit(4)).cast("string")).alias("group"), ((F.pmod("id", F.lit(9)) - 4) / 8.0).alias("score")).where("part % 5 <> 0")


def likeness_breakdown(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("bits", pairs.on_bits(c("embedding")))
    return S.contributions(e, "vec_id", "bits", _bit_scores(spark))


def column_sets(spark, sf_dir):
    a = table(spark, sf_dir, "customer").withColumnsRenamed({"c_custkey": "key", "c_name": "name"})
    b = table(spark, sf_dir, "supplier").withColumnsRenamed({"s_suppkey": "key", "s_name": "name"})
    return audit.column_sets(a.select("key", "name", "c_acctbal"), b.select("key", "name", "s_acctbal"))


def curation_duplicates(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("key", F.md5(dedup.normalized(c("text"))))
    return funnel.first_kept(d, F.length("text") > 40, "key", "doc_id").select("doc_id", "status", F.coalesce("reason", F.lit("")).alias("reason"))


def curation_composition(spark, sf_dir):
    d = D.from_lineitem(table(spark, sf_dir, "lineitem")).withColumns({"heavy": c("heavy") * 3 - 16, "mw": c("mw") * 2.5, "carbon": c("hba") > 0})
    return d.select(*D.KEYS, F.coalesce(funnel.composition_reason(), F.lit("")).alias("reason"))


def preset_scores(spark, sf_dir):
    """The composite score of every preset's weights."""
    d = D.from_lineitem(table(spark, sf_dir, "lineitem"))
    return d.select(*D.KEYS, *(F.round(S.composite(*w, alerts=(c("hba") == 13).cast("int")), 6).alias(n) for n, w in funnel.WEIGHTS.items()))


def _alerts(spark, sf_dir):
    return flow.processed(documents(spark, sf_dir), flow.Options([], rules=RULES, text="text"))


def alert_counts(spark, sf_dir):
    d = _alerts(spark, sf_dir)
    return d.select("doc_id", *(view.alert_count(s).cast("long").alias(f"n_{s}") for s in ("a", "b")))


def alert_filter(spark, sf_dir):
    return view.with_alert(_alerts(spark, sf_dir), "B").select("doc_id")


def sorted_view(spark, sf_dir):
    """The second page of lines with most failed checks first."""
    rows = scored(spark, sf_dir).withColumn("index", c("l_orderkey") * 8 + c("l_linenumber"))
    return view.sorted_page(rows, "issues", "index", 2, 50, True).select("index", "score")


def report_statistics(spark, sf_dir):
    rows = scored(spark, sf_dir).select(F.when(F.pmod("l_orderkey", F.lit(97)) == 0, "error").otherwise("success").alias("status"), F.when(F.pmod("l_partkey", F.lit(10)) > 0, c("score")).alias("score"), F.when(F.pmod("l_suppkey", F.lit(4)) > 0, c("l_quantity")).alias("ml"))
    return stats.report_statistics(rows)


def reference_histogram(spark, sf_dir):
    """Prices against a reference distribution that falls in equal steps."""
    own = stats.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.0, 50000.0)
    return stats.against_reference(own, spark.range(1, 20).select(c("id").alias("bin"), ((21 - c("id")) / 210.0).alias("share")))


def suggestions(spark, sf_dir):
    """For each document the three rules of most confidence (the longest patterns) that it meets."""
    hit = screen.hits(documents(spark, sf_dir), c("text"), RULES, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("rule")).alias("o"), "rule"))).alias("r"))
    return hit.select("doc_id", F.array_join(F.transform(F.slice("r", 1, 3), lambda x: x["rule"]), ",").alias("top"))


def rule_table_screen(spark, sf_dir):
    """The rule screen with its rules as a table."""
    return screen.table_hits(documents(spark, sf_dir), c("text"), screen.rule_table(spark, RULES), "doc_id").select("doc_id", "rule", "concern", "severity", "source")


def rule_index_screen(spark, sf_dir):
    """Documents against a rule for each benchmark item: its first three words, lower-cased, with blanks between."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 1, 3)
    rules = table(spark, sf_dir, "benchmark").select(c("item_id").cast("string").alias("rule"), F.array_join(words, r"\s+").alias("pattern"), F.lit("benchmark").alias("concern"), F.lit("warning").alias("severity"), F.lit("items").alias("source"))
    return screen.table_hits(documents(spark, sf_dir), c("text"), rules.where("length(pattern) > 0"), "doc_id").select("doc_id", "rule")


EXPORT = [
    export_columns.Declared("identity", "name", "c_name"),
    export_columns.Declared("identity", "segment", "c_mktsegment"),
    export_columns.Declared("validation", "score", "validation.overall_score"),
    *(export_columns.Declared("validation", k.name, k.name, "check") for k in LINE_CHECKS),
    export_columns.Declared("descriptors", "mw", "properties.mw|druglikeness.mw", "either"),
    export_columns.Declared("descriptors", "logp", "properties.logp|druglikeness.logp", "either"),
    export_columns.Declared("druglikeness", "lipinski", "druglikeness.lipinski", "verdict"),
]


def export_flat(spark, sf_dir):
    """Nested records of order lines as flat export columns; 0 or missing in one place falls back to the other."""
    n = scored(spark, sf_dir).join(D.from_lineitem(table(spark, sf_dir, "lineitem")), ["l_orderkey", "l_linenumber"])
    n = n.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"), "left").join(table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment"), c("o_custkey") == c("c_custkey"), "left")
    some = F.when(c("hba") > 3, c("charge"))
    records = n.select("l_orderkey", "l_linenumber", "c_name", "c_mktsegment", "checks", F.struct(c("score").alias("overall_score")).alias("validation"), F.struct(some.alias("mw"), some.alias("logp")).alias("properties"), F.struct(c("rings").alias("mw"), c("arom").alias("logp"), F.when(c("hbd") > 0, c("hbd") < 5).alias("lipinski")).alias("druglikeness"))
    flat = export_columns.flat_rows(records, EXPORT, "l_orderkey", "l_linenumber")
    return flat.select("l_orderkey", "l_linenumber", *(c(f"`{d.name}`").alias(f"{d.section}_{d.header}") for d in EXPORT))


def batch_flow(spark, sf_dir):
    """Checks, scores, alerts and statistics of order lines, composed."""
    rows = D.from_lineitem(table(spark, sf_dir, "lineitem")).join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_partkey"), ["l_orderkey", "l_linenumber"])
    options = flow.Options(LINE_CHECKS, scores={"lipinski": S.lipinski_violations() <= 1, "profile": S.profile_score(PROFILE, WEIGHTS)})
    return flow.batch(rows, options, F.pmod("l_partkey", F.lit(89)) == 0, c("rings") < 6)


def audit_flow(spark, sf_dir):
    """The audit of documents, composed: health, contradictory sizes of equal openings, numeric columns."""
    d = documents(spark, sf_dir).withColumn("lead", F.lower(F.substring_index("text", " ", 2)))
    return audit.dataset_audit(d, F.length("text") > 40, c("text").rlike(r"\.$"), c("lead"), c("text").rlike("[#*$%&]{3}"), c("text") == F.trim("text"), "n_chars")


QUERIES = {f.__name__: f for f in (name_kinds, pattern_severities, view_keys, likeness, radar_comparison, likeness_breakdown, column_sets, curation_duplicates, curation_composition, preset_scores, alert_counts, alert_filter, sorted_view, report_statistics, reference_histogram, suggestions, rule_table_screen, rule_index_screen, export_flat, batch_flow, audit_flow)}

_D = f"WITH {D.SQL} "
_NORM = r"regexp_replace(lower(trim(text)), '[ \t\n\r\f\x0B]+', ' ', 'g')"
_V = "v AS (SELECT p_name AS v FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT url FROM pages UNION ALL SELECT n_name FROM nation)"
_like = lambda name, rows: f"CASE {rows} ELSE 0.0 END::DOUBLE"
_HIT = " UNION ALL ".join(f"SELECT doc_id, '{r.name}' AS rule, '{r.group}' AS concern, '{r.severity}' AS severity, '{r.source}' AS source FROM documents WHERE regexp_matches(lower(text), '{r.pattern}')" for r in RULES)
_COMP = lambda w: f"round({w[0]}::DOUBLE + {w[1]}::DOUBLE * qed + {w[2]}::DOUBLE * (CASE WHEN hba = 13 THEN 0.0 ELSE 1.0 END)::DOUBLE + {w[3]}::DOUBLE * least(greatest((10.0 - sa) / 9.0, 0.0), 1.0), 6)"
_DES = lambda n, low, high: f"(CASE WHEN {n} BETWEEN {low} AND {high} THEN 1.0 WHEN {n} < {low} THEN greatest(0.0, 1.0 - ({low} - {n}) / {high - low}) ELSE greatest(0.0, 1.0 - ({n} - {high}) / {high - low}) END)::DOUBLE"
_ESOL = "(0.16::DOUBLE - 0.63::DOUBLE * logp - 0.0062::DOUBLE * mw + 0.066::DOUBLE * rotb - 0.74::DOUBLE * least(1.0, 6.0::DOUBLE * arom / heavy))"
_FAILED = "(NOT l_quantity <= 45)::INT + (NOT l_discount < 0.08)::INT + (NOT l_tax < 0.06)::INT + (l_returnflag = 'R')::INT + (NOT l_linestatus = 'O')::INT"
_some = "CASE WHEN hba > 3 AND charge <> 0 THEN charge::VARCHAR ELSE {}::VARCHAR END"
ORACLE_SQL = {
    "name_kinds": f"""WITH {_V}, t AS (SELECT v, trim(v) AS t FROM v)
      SELECT CASE WHEN regexp_matches(t, '[()\\[\\]=#@/\\\\]') THEN 'smiles' WHEN contains(t, ' ') OR regexp_matches(lower(t), '({"|".join(T.NAME_ENDINGS)})$') OR regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9,-]*-[a-zA-Z0-9,-]*$') OR regexp_matches(t, '^[a-zA-Z]{{4,}}$') THEN 'iupac' ELSE 'ambiguous' END AS kind,
        CASE WHEN t LIKE 'InChI=%' THEN 'inchi' WHEN contains(t, 'M  END') OR contains(substr(t, 1, 50), chr(10)) THEN 'mol' ELSE 'smiles' END AS format,
        length(v) BETWEEN 1 AND 256 AND NOT regexp_matches(v, '[<>"''\\\\/;`]') AS column_ok, count(*) AS n FROM t GROUP BY 1, 2, 3""",
    "pattern_severities": f"""WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' Epoxide' ELSE p_name END AS nm FROM part)
      SELECT p_partkey, CASE WHEN regexp_matches(lower(nm), '{"|".join(T.CRITICAL_WORDS)}') THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN p_partkey % 11 = 0 THEN p_name ELSE trim(p_name) END AS name,
        CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 6 THEN 'warning' ELSE CASE p_partkey % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'critical' ELSE 'warning' END END AS coded FROM p""",
    "view_keys": "SELECT o_orderkey, 'batch:view:' || o_orderkey || ':' || substr(md5(concat_ws('|', coalesce(o_orderstatus, 'None'), CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority::VARCHAR ELSE 'None' END, 'score')), 1, 12) AS key FROM orders",
    "likeness": _D
    + """, f AS (SELECT *, (hba % 10) / 10.0::DOUBLE AS ring, (rotb % 12) / 12.0::DOUBLE AS oxy, (hbd % 16) / 16.0::DOUBLE AS nit, rotb % 5 AS hal, hba % 4 AS chi FROM descriptors),
      s AS (SELECT l_orderkey, l_linenumber, tpsa / 256.0::DOUBLE AS d, round(least(3.0, greatest(-3.0, 1.5 * ((CASE WHEN nit > 0.3 THEN -0.3 ELSE 0.0 END)::DOUBLE - 0.3::DOUBLE * least(hal, 3)
        + (CASE WHEN ring >= 0.2 AND ring <= 0.6 THEN 0.5 WHEN ring > 0.6 THEN -0.3 ELSE 0.0 END)::DOUBLE + (CASE WHEN oxy >= 0.1 AND oxy <= 0.5 THEN 0.5 WHEN oxy > 0.5 THEN 0.3 ELSE 0.0 END)::DOUBLE
        + (CASE WHEN fsp3 > 0.4 THEN 0.5 WHEN fsp3 > 0.25 THEN 0.3 ELSE -0.2 END)::DOUBLE + (CASE WHEN chi >= 3 THEN 0.5 WHEN chi >= 1 THEN 0.2 ELSE 0.0 END)::DOUBLE
        + (CASE WHEN mw BETWEEN 200 AND 800 THEN 0.3 WHEN mw < 150 THEN -0.2 ELSE 0.0 END)::DOUBLE))), 6) + 0.0::DOUBLE AS likeness FROM f)
      SELECT l_orderkey, l_linenumber, likeness, CASE WHEN likeness >= 2 THEN 'strongly natural' WHEN likeness >= 1 THEN 'natural' WHEN likeness >= 0.3 THEN 'moderately natural' WHEN likeness >= -0.3 THEN 'mixed' WHEN likeness >= -1 THEN 'moderately synthetic' WHEN likeness >= -2 THEN 'synthetic' ELSE 'strongly synthetic' END AS band,
        CASE WHEN d BETWEEN 0.01 AND 0.3 THEN 5.0 WHEN d < 0.01 THEN round(5.0 * (d / 0.01), 2) WHEN d <= 0.45 THEN round(5.0 * (1.0 - (d - 0.30) / 0.15), 2) ELSE 0.0 END::DOUBLE AS density FROM s""",
    "radar_comparison": _D
    + f", m AS (SELECT *, {_ESOL} AS esol FROM descriptors) SELECT l_orderkey, l_linenumber, false AS is_reference, "
    + ", ".join(f"round({_DES(n, low, high)}, 6) AS {a}" for a, (n, low, high) in S.RADAR_AXES.items())
    + " FROM m UNION ALL SELECT NULL, NULL, true, "
    + ", ".join(f"round({_DES(f'({S.REFERENCE_PROFILE[n]}::DOUBLE)', low, high)}, 6)" for a, (n, low, high) in S.RADAR_AXES.items()),
    "likeness_breakdown": """WITH f AS (SELECT vec_id, unnest(list_filter(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN i - 1 END), lambda x: x IS NOT NULL)) AS part FROM embeddings),
      e AS (SELECT vec_id, part, 'g' || (part % 4) AS grp, ((part % 9) - 4) / 8.0::DOUBLE AS score FROM f WHERE part < 64 AND part % 5 <> 0),
      g AS (SELECT vec_id, grp, round(sum(score), 4) AS s FROM e GROUP BY 1, 2),
      r AS (SELECT vec_id, string_agg(grp || ':' || printf('%.4f', s), ',' ORDER BY -s, grp) AS groups FROM g GROUP BY 1),
      t AS (SELECT vec_id, round(sum(score), 4) AS total, count(*) AS known, array_to_string(list(part ORDER BY abs(score) DESC, part)[1:5], ',') AS top FROM e GROUP BY 1)
      SELECT vec_id, total, known, groups, top FROM t JOIN r USING (vec_id)""",
    "column_sets": "SELECT * FROM (VALUES ('key', 'common'), ('name', 'common'), ('c_acctbal', 'removed'), ('s_acctbal', 'added')) v(name, state)",
    "curation_duplicates": f"""WITH d AS (SELECT doc_id, length(text) > 40 AS ok, {_NORM} AS k FROM documents), f AS (SELECT *, min(CASE WHEN ok THEN doc_id END) OVER (PARTITION BY k) AS first FROM d)
      SELECT doc_id, CASE WHEN ok AND doc_id <> first THEN 'duplicate' WHEN ok THEN 'ok' ELSE 'rejected' END AS status, CASE WHEN ok AND doc_id <> first THEN 'Duplicate of molecule ' || first || ' (index ' || first || ')' ELSE '' END AS reason FROM f""",
    "curation_composition": _D
    + """SELECT l_orderkey, l_linenumber, CASE WHEN heavy * 3 - 16 < 3 THEN 'Too few heavy atoms: ' || (heavy * 3 - 16)::INT || ' < 3 (minimum)' WHEN heavy * 3 - 16 > 100 THEN 'Too many heavy atoms: ' || (heavy * 3 - 16)::INT || ' > 100 (maximum)'
        WHEN mw * 2.5 > 1500 THEN 'Molecular weight too high: ' || printf('%.1f', mw * 2.5) || ' > 1500.0 (maximum)' WHEN NOT hba > 0 THEN 'No carbon atoms found (inorganic molecule rejected)' ELSE '' END AS reason FROM descriptors""",
    "preset_scores": _D + "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{_COMP(w)} AS {n}" for n, w in funnel.WEIGHTS.items()) + " FROM descriptors",
    "alert_counts": f"SELECT d.doc_id, count(*) FILTER (h.source = 'a') AS n_a, count(*) FILTER (h.source = 'b') AS n_b FROM documents d LEFT JOIN ({_HIT}) h USING (doc_id) GROUP BY 1",
    "alert_filter": f"SELECT DISTINCT doc_id FROM ({_HIT}) WHERE source = 'b'",
    "sorted_view": f"SELECT l_orderkey * 8 + l_linenumber AS index, {_SCORE} AS score FROM lineitem ORDER BY {_FAILED} DESC, 1 LIMIT 50 OFFSET 50",
    "report_statistics": f"""WITH r AS (SELECT l_orderkey % 97 <> 0 AS ok, CASE WHEN l_partkey % 10 > 0 THEN {_SCORE} END AS score, CASE WHEN l_suppkey % 4 > 0 THEN l_quantity END AS ml FROM lineitem)
      SELECT count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS errors, round(avg(score), 6) AS page_score, round(avg(ml), 6) AS page_ml,
        round(sum(coalesce(score, 0)) FILTER (ok) / count(*) FILTER (ok)::DOUBLE, 6) AS sheet_score, round(sum(coalesce(ml, 0)) FILTER (ok) / count(*) FILTER (ok)::DOUBLE, 6) AS sheet_ml FROM r""",
    "reference_histogram": "WITH h AS (SELECT b.bin, count(l.l_orderkey) AS n FROM (SELECT unnest(range(1, 21)) AS bin) b LEFT JOIN lineitem l ON l.l_extendedprice BETWEEN 0 AND 50000 AND least(floor(l.l_extendedprice / 2500.0) + 1, 20) = b.bin GROUP BY 1), s AS (SELECT *, n / sum(n) OVER ()::DOUBLE AS own, CASE WHEN bin < 20 THEN (21 - bin) / 210.0::DOUBLE ELSE 0.0 END AS expected FROM h) SELECT bin, n, round(own, 6) AS share, expected, round(own - expected, 6) AS gap FROM s",
    "suggestions": f"SELECT doc_id, array_to_string(list(rule ORDER BY -length(rule), rule)[1:3], ',') AS top FROM ({_HIT}) GROUP BY 1",
    "rule_table_screen": _HIT,
    "rule_index_screen": r"WITH r AS (SELECT item_id::VARCHAR AS rule, array_to_string(regexp_extract_all(lower(text), '[a-z]+')[1:3], '\s+') AS pattern FROM benchmark) SELECT doc_id, rule FROM documents JOIN r ON length(pattern) > 0 AND regexp_matches(lower(text), pattern)",
    "export_flat": f"""{_D}, n AS (SELECT d.*, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, {_SCORE} AS score, c_name, c_mktsegment FROM descriptors d JOIN lineitem USING (l_orderkey, l_linenumber) LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey)
      SELECT l_orderkey, l_linenumber, coalesce(c_name, 'N/A') AS identity_name, coalesce(c_mktsegment, 'N/A') AS identity_segment, score::VARCHAR AS validation_score, CASE WHEN l_quantity <= 45 THEN 'Pass' ELSE 'Fail' END AS validation_quantity, CASE WHEN l_discount < 0.08 THEN 'Pass' ELSE 'Fail' END AS validation_discount,
        CASE WHEN l_tax < 0.06 THEN 'Pass' ELSE 'Fail' END AS validation_tax, CASE WHEN l_returnflag <> 'R' THEN 'Pass' ELSE 'Fail' END AS validation_returned, CASE WHEN l_linestatus = 'O' THEN 'Pass' ELSE 'Fail' END AS validation_open,
        {_some.format("rings")} AS descriptors_mw, {_some.format("arom")} AS descriptors_logp, CASE WHEN hbd = 0 THEN 'N/A' WHEN hbd < 5 THEN 'Pass' ELSE 'Fail' END AS druglikeness_lipinski FROM n""",
    "batch_flow": f"""{_D}, r AS (SELECT d.*, l_partkey % 89 = 0 AS failed, {_SCORE} AS score, ((mw > 500)::INT + (logp > 5)::INT + (hbd > 5)::INT + (hba > 10)::INT) <= 1 AS lip, rings < 6 AS safe FROM descriptors d JOIN lineitem USING (l_orderkey, l_linenumber)), k AS (SELECT * FROM r WHERE NOT failed)
      SELECT (SELECT count(*) FROM r) AS total, count(*) AS successful, (SELECT count(*) FROM r WHERE failed) AS errors, round(avg(score), 1) AS avg_score, round(avg(qed), 2) AS avg_qed, round(avg(sa), 1) AS avg_sa, round(100.0::DOUBLE * count(*) FILTER (lip) / count(*), 1) AS lipinski_rate, round(100.0::DOUBLE * count(*) FILTER (safe) / count(*), 1) AS safety_rate,
        count(*) FILTER (score >= 90) AS excellent, count(*) FILTER (score >= 70 AND score < 90) AS good, count(*) FILTER (score >= 50 AND score < 70) AS moderate, count(*) FILTER (score < 50) AS poor FROM k""",
    "audit_flow": f"""WITH d AS (SELECT *, lower(array_to_string(string_split(text, ' ')[1:2], ' ')) AS lead FROM documents),
      a AS (SELECT count(*) AS total, count(*) FILTER (length(text) > 40) AS parsed, count(*) FILTER (length(text) > 40 AND regexp_matches(text, '\\.$')) AS complete, count(DISTINCT CASE WHEN length(text) > 40 THEN lead END) AS keys, count(*) FILTER (length(text) > 40 AND regexp_matches(text, '[#*$%&]{{3}}')) AS flagged, count(*) FILTER (length(text) > 40 AND text = trim(text)) AS stable FROM d),
      p AS (SELECT total, parsed, parsed / total::DOUBLE AS parsability, complete / parsed::DOUBLE AS stereo, keys / parsed::DOUBLE AS uniqueness, 1 - flagged / parsed::DOUBLE AS alerts, stable / parsed::DOUBLE AS consistency FROM a),
      g AS (SELECT max(n_chars) / greatest(min(n_chars), 1e-10) AS fold FROM d WHERE n_chars > 0 GROUP BY lead HAVING count(*) >= 2 AND max(n_chars) / greatest(min(n_chars), 1e-10) > 10)
      SELECT total, parsed, round(parsability, 6) AS parsability, round(stereo, 6) AS stereo, round(uniqueness, 6) AS uniqueness, round(alerts, 6) AS alerts, round(consistency, 6) AS consistency, round((parsability * 0.25::DOUBLE + stereo * 0.15::DOUBLE + uniqueness * 0.20::DOUBLE + alerts * 0.20::DOUBLE + consistency * 0.20::DOUBLE) * 100, 4) AS health,
        (SELECT count(*) FROM g) AS contradictions, (SELECT round(max(fold), 1) FROM g) AS worst_fold, 'doc_id,n_chars' AS numeric FROM p""",
}
