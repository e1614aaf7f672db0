"""Queries over the relational tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import descriptors as D
from tessel.functions import scoring as S
from tessel.functions import text as T
from tessel.operators import audit, checks, dedup, funnel, screen, stats, view
from tessel.sources.tables import table

c = F.col

LINE_CHECKS = [
    checks.Check("quantity", "critical", lambda: c("l_quantity") <= 45),
    checks.Check("discount", "error", lambda: c("l_discount") < 0.08),
    checks.Check("tax", "warning", lambda: c("l_tax") < 0.06),
    checks.Check("returned", "warning", lambda: c("l_returnflag") != "R"),
    checks.Check("open", "info", lambda: c("l_linestatus") == "O"),
]
_FAILS = {"quantity": "NOT l_quantity <= 45", "discount": "NOT l_discount < 0.08", "tax": "NOT l_tax < 0.06", "returned": "NOT l_returnflag <> 'R'", "open": "NOT l_linestatus = 'O'"}
_SCORE = "greatest(0, 100 - 50 * (NOT l_quantity <= 45)::INT - 20 * (NOT l_discount < 0.08)::INT - 5 * (NOT l_tax < 0.06)::INT - 5 * (l_returnflag = 'R')::INT)::BIGINT"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def scored(spark, sf_dir):
    return checks.checked(lines(spark, sf_dir), LINE_CHECKS)


def batch_statistics(spark, sf_dir):
    rows = scored(spark, sf_dir).select(
        (c("l_shipdate").isNull() | (F.pmod("l_orderkey", F.lit(97)) == 0)).alias("failed"), "score", (F.pmod("l_suppkey", F.lit(100)) / 100.0).alias("qed"),
        (1.0 + F.pmod("l_orderkey", F.lit(80)) / 10.0).alias("sa"), (c("l_quantity") <= 40).alias("lipinski"), (c("l_tax") < 0.05).alias("safe"),
    )
    return stats.batch_statistics(rows)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def quality_score(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    brands = part.groupBy("p_brand").agg(F.count("*").alias("n"))
    shares = part.agg((F.count_if(c("p_size") > 0) * 100.0 / F.count("*")).alias("valid"), (F.count_if(c("p_retailprice") < 1500) * 100.0 / F.count("*")).alias("rule"))
    both = stats.entropy(brands).join(F.broadcast(shares))  # one row each
    return both.select(F.round(c("valid"), 4).alias("valid"), "diversity", F.round(c("rule"), 4).alias("rule"), F.round(0.40 * c("valid") + 0.35 * c("diversity") + 0.25 * c("rule"), 3).alias("quality"))


def history_view(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    picked = e.where((c("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (c("ts") < F.lit("2024-01-20").cast("timestamp_ntz")) & (c("event_type") == "purchase") & c("props").contains("1"))
    return picked.orderBy(c("ts").desc(), "event_id").offset(20).limit(50).select("event_id", "user_id", "value")


def result_view_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey")).where((c("o_totalprice") >= 50000) & (c("c_mktsegment") == "BUILDING"))
    return view.page(rows.select("o_orderkey", "c_name", "o_totalprice"), c("o_totalprice"), "o_orderkey", 3, 25, True)


def audit_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"), "left")
    return o.select((c("o_orderkey") + 1).alias("row_number"), view.flat(c("c_name")).alias("name"), view.flat(c("c_mktsegment")).alias("segment"), view.pass_fail(c("c_acctbal") > 0).alias("solvent"), view.pass_fail(F.when(c("o_orderstatus") != "P", c("o_orderstatus") == "F")).alias("filled"))


def subset_reindex(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").where(c("c_acctbal") > 9000).select(c("c_custkey").alias("o_custkey"))
    return view.reindexed(view.subset(table(spark, sf_dir, "orders"), customers, "o_custkey").select("o_orderkey", "o_custkey"), "o_orderkey")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def versions(spark, sf_dir):
    """Orders as they were, and a later version: some gone, some new, some changed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    later = o.where(F.pmod("o_orderkey", F.lit(10)) != 3)
    later = later.withColumn("o_totalprice", F.when(F.pmod("o_orderkey", F.lit(7)) == 0, c("o_totalprice") + 1).otherwise(c("o_totalprice"))).withColumn("o_orderstatus", F.when(F.pmod("o_orderkey", F.lit(11)) == 0, F.lit("X")).otherwise(c("o_orderstatus")))
    new = o.where(F.pmod("o_orderkey", F.lit(10)) == 5).withColumn("o_orderkey", -c("o_orderkey") - 1)
    return o.withColumn("at", F.lit(0)), later.union(new).withColumn("at", F.lit(1))


def dataset_diff(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    return audit.dataset_diff(old, new, "o_orderkey", "at", ["o_orderstatus", "o_totalprice", "o_orderpriority"])


def contradictory_documents(spark, sf_dir):
    return audit.contradictory_labels(lines(spark, sf_dir).withColumn("quantity", c("l_quantity").cast("string")), "l_partkey", "quantity")


def health_score(spark, sf_dir):
    d = documents(spark, sf_dir)
    return audit.health(d, F.length("text") > 40, c("text").rlike(r"\.$"), F.sha2(dedup.normalized(c("text")), 256), c("text").rlike("[#*$%&]{3}"), c("text") == F.trim("text"))


def issue_rows(d):
    found = F.filter(F.array(F.when(F.length("text") <= 100, "short"), F.when(c("text").rlike("[#*$%&]{3}"), "symbols"), F.when(c("text").rlike("[A-Z]{12}"), "capitals")), lambda x: x.isNotNull())
    return d.select("doc_id", F.explode(found).alias("issue"))


def curated_rows(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "lang", "text")
    return audit.curated(d.select("doc_id", "lang"), "doc_id", issue_rows(d))


def funnel_rows(spark, sf_dir, preset="drug_like"):
    rows = D.from_lineitem(lines(spark, sf_dir)).withColumn("key", F.pmod("l_orderkey", F.lit(1000)) * 8 + c("l_linenumber")).withColumn("index", c("l_orderkey") * 8 + c("l_linenumber"))
    return funnel.filtered(rows, funnel.PRESETS[preset], c("heavy") > 6, c("charge") < 2, (c("hba") == 13).cast("int"), ["key"], "index", c("qed"))


RULES = [
    screen.Rule("Symbols", "[#*$%&]{3}", "format", "warning", "a"),
    screen.Rule("symbols", "[#*]{3}", "format", "critical", "b"),
    screen.Rule("Mail", "[a-z0-9.]+@[a-z0-9]", "private", "critical", "a"),
    screen.Rule("Licence", "license", "legal", "info", "b"),
    screen.Rule("Digits run", "[0-9]{6}", "private", "warning", "b"),
]
TOPICS = [("idiot|moron|clown", "insult"), ("licen[sc]e", "legal"), ("[0-9]{6}", "numeric"), ("[|]", "table")]


def compared_sources(spark, sf_dir):
    initial = lambda t, key, v, s: table(spark, sf_dir, t).groupBy(c(key).alias("nation")).agg(F.max(v).alias("value")).select("nation", F.lit(s).alias("source"), "value")
    n = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("nation"), F.lit("n").alias("source"), c("n_name").alias("value"))
    return audit.compared_sources(initial("customer", "c_nationkey", "c_mktsegment", "c").union(initial("supplier", "s_nationkey", "s_name", "s")).union(n), "nation")


def layer_diff(spark, sf_dir):
    """Layers of page URLs' paths against those of the page before in the same residue class of ids."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("x/"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)).alias("path"))
    a = p.where("page_id % 2 = 0").select((c("page_id") / 2).cast("long").alias("pair"), T.layers(c("path")).alias("x"))
    b = p.where("page_id % 2 = 1").select(((c("page_id") - 1) / 2).cast("long").alias("pair"), T.layers(c("path")).alias("y"))
    both = a.join(b, "pair").select("pair", "x", "y", F.explode(F.array_union(F.map_keys("x"), F.map_keys("y"))).alias("layer"))
    left, right = F.try_element_at("x", "layer"), F.try_element_at("y", "layer")
    return both.select("pair", "layer", F.coalesce(left, F.lit("")).alias("left_value"), F.coalesce(right, F.lit("")).alias("right_value"), left.eqNullSafe(right).alias("same"))


def identifiers(spark, sf_dir):
    values = (
        table(spark, sf_dir, "part").select(c("p_name").alias("v"))
        .union(table(spark, sf_dir, "pages").select("url"))
        .union(table(spark, sf_dir, "orders").select(F.concat(F.lit("CHEMBL"), c("o_orderkey").cast("string"))))
        .union(table(spark, sf_dir, "customer").select(c("c_custkey").cast("string")))
        .union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("DB"), F.lpad(c("s_suppkey").cast("string"), 5, "0"))))
    )
    return values.select(T.identifier_type(c("v")).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def numeric_columns(spark, sf_dir):
    """Share of values that read as numbers, of several columns as strings; above 0.8 numeric."""
    p = table(spark, sf_dir, "part")
    names = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    long = p.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c(n).cast("string").alias("v")) for n in names))).alias("x")).select("x.*").where("v is not null and v <> ''")
    share = F.avg(c("v").try_cast("double").isNotNull().cast("int"))
    return long.groupBy("name").agg(F.round(share, 6).alias("share"), (share > 0.8).alias("numeric"))


def rate_limits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n")).where("n > 2").select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


def sessions(spark, sf_dir, gap="6 hours"):
    e = table(spark, sf_dir, "events")
    w = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))


def eta(spark, sf_dir):
    """Rate over a user's last ten events: how far event ids moved over how many seconds."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    secs = F.unix_timestamp(c("ts").cast("timestamp"))
    moved, took = c("event_id") - F.first("event_id").over(w), secs - F.first(secs).over(w)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.coalesce(F.try_divide(moved.cast("double"), took.cast("double")), F.lit(0.0)), 8).alias("rate"))


QUERIES = {
    "batch_statistics": batch_statistics,
    "check_engine_scores": lambda s, d: scored(s, d).select("l_orderkey", "l_linenumber", "score"),
    "issue_summary": lambda s, d: checks.summary(scored(s, d)),
    "property_stats": lambda s, d: stats.property_stats(lines(s, d), NUMBERS),
    "pearson_matrix": lambda s, d: stats.pearson(lines(s, d), NUMBERS),
    "iqr_outliers": lambda s, d: stats.iqr_outliers(documents(s, d).withColumn("size", c("n_chars").cast("double")), "size", ["lang"], ["doc_id"]),
    "quality_score": quality_score,
    "entropy_topn_other": lambda s, d: stats.top_and_other(table(s, d, "part"), "p_brand", 10),
    "histogram_fixed": lambda s, d: stats.histogram(lines(s, d), "l_extendedprice", 0.0, 50000.0),
    "history_view": history_view,
    "history_stats": lambda s, d: view.history_totals(table(s, d, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")), "event_type", "day"),
    "result_view_page": result_view_page,
    "result_filter": lambda s, d: view.filtered(scored(s, d).withColumn("status", F.when(c("l_quantity") > 48, "error").otherwise("success")), "success", 40, 90, "tax").select("l_orderkey", "l_linenumber", "score"),
    "bookmark_tags": lambda s, d: documents(s, d).where(view.contains_all(c("text"), ["the ", "th", "."]) & (c("source") == "src1")).select("doc_id"),
    "audit_columns": audit_columns,
    "subset_reindex": subset_reindex,
    "dedup_groups": lambda s, d: dedup.by_level(documents(s, d), "doc_id", "text"),
    "dedup_all_levels": lambda s, d: dedup.level_totals(documents(s, d), "doc_id", "text"),
    "dedup_annotate": lambda s, d: dedup.annotated(documents(s, d), "doc_id", "text"),
    "registration_collisions": lambda s, d: dedup.registration(documents(s, d), [dedup.normalized(c("text")), c("lang")]),
    "contradictory_labels": contradictory_documents,
    "dataset_diff": dataset_diff,
    "diff_counts": lambda s, d: audit.diff_counts(dataset_diff(s, d)),
    "health_score": health_score,
    "curated_rows": curated_rows,
    "funnel_stages": lambda s, d: funnel.stage_counts(funnel_rows(s, d), funnel.ALL_STAGES),
    "funnel_molecules": lambda s, d: funnel_rows(s, d, "fragment_like").select("l_orderkey", "l_linenumber", F.coalesce("stage", F.lit("passed")).alias("stage"), F.coalesce("reason", F.lit("")).alias("reason")),
    "qsar_steps": lambda s, d: funnel.stepped(documents(s, d), "text").select("doc_id", F.explode("steps").alias("x")).select("doc_id", "x.step", "x.status"),
    "qsar_summary": lambda s, d: funnel.stepped(documents(s, d), "text").select(F.explode("steps").alias("x")).groupBy("x.step", "x.status").agg(F.count("*").alias("n")),
    "rule_screen": lambda s, d: screen.hits(documents(s, d), c("text"), RULES, "doc_id").select("doc_id", "rule", "concern", "severity", "source"),
    "concern_groups": lambda s, d: screen.unified(screen.hits(documents(s, d), c("text"), RULES, "doc_id"), "doc_id"),
    "taxonomy_counts": lambda s, d: screen.category_counts(documents(s, d), c("text"), TOPICS),
    "suspicious_scan": lambda s, d: screen.suspicious(table(s, d, "pages"), c("html"), "page_id"),
    "identifier_types": identifiers,
    "layer_diff": layer_diff,
    "numeric_columns": numeric_columns,
    "cross_source_compare": compared_sources,
    "rate_limit_windows": rate_limits,
    "session_windows": sessions,
    "eta_moving": eta,
}

_NORM = r"regexp_replace(lower(trim(text)), '[ \t\n\r\f\x0B]+', ' ', 'g')"
_LEVELS = {"exact": "text", "normalized": _NORM, "words": f"array_to_string(list_sort(list_distinct(string_split({_NORM}, ' '))), ' ')", "letters": "regexp_replace(lower(text), '[^a-z]+', '', 'g')"}
_GROUPS = " UNION ALL ".join(f"SELECT '{n}' AS level, sha256({e}) AS key, min(doc_id) AS representative, count(*)::BIGINT AS members FROM documents WHERE text IS NOT NULL GROUP BY 2 HAVING count(*) > 1" for n, e in _LEVELS.items())
_q = lambda n, p: f"quantile_cont({n}, {p})"
_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
_DIFF = """
 old AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders),
 new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM old WHERE o_orderkey % 10 <> 3
   UNION ALL SELECT -o_orderkey - 1, o_orderstatus, o_totalprice, o_orderpriority FROM old WHERE o_orderkey % 10 = 5),
 diff AS (SELECT coalesce(p.o_orderkey, c.o_orderkey) AS o_orderkey, p.o_orderkey IS NULL AS added, c.o_orderkey IS NULL AS removed,
   concat_ws(',', CASE WHEN p.o_orderstatus IS DISTINCT FROM c.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN p.o_totalprice IS DISTINCT FROM c.o_totalprice THEN 'o_totalprice' END, CASE WHEN p.o_orderpriority IS DISTINCT FROM c.o_orderpriority THEN 'o_orderpriority' END) AS changed
   FROM old p FULL JOIN new c ON p.o_orderkey = c.o_orderkey),
 named AS (SELECT o_orderkey, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN changed <> '' THEN 'modified' ELSE 'unchanged' END AS state, CASE WHEN NOT added AND NOT removed THEN changed ELSE '' END AS changed FROM diff)
"""


def _funnel(bounds):
    beyond = lambda n, low, high: " OR ".join([*([f"{n} < {low}"] if low is not None else []), *([f"{n} > {high}"] if high is not None else [])])
    tests = " ".join(f"WHEN {beyond(n, *b)} THEN '{'sa:sa' if n == 'sa' else f'property:{n}'}'" for n, b in bounds.items())
    return f"""WITH {D.SQL},
    judged AS (SELECT *, (l_orderkey % 1000) * 8 + l_linenumber AS key, l_orderkey * 8 + l_linenumber AS index, CASE WHEN NOT heavy > 6 THEN 'parse:not parsed' WHEN NOT charge < 2 THEN 'valence:valence' WHEN hba = 13 THEN 'alerts:alert match'
      {tests} END AS r, qed >= {funnel.NOVELTY} AS known FROM descriptors),
    firsts AS (SELECT *, min(CASE WHEN r IS NULL THEN index END) OVER (PARTITION BY key) AS first FROM judged),
    final AS (SELECT l_orderkey, l_linenumber, CASE WHEN r IS NOT NULL THEN r WHEN index <> first THEN 'dedup:Duplicate of row ' || (first + 1) WHEN known THEN 'novelty:known' ELSE 'passed:' END AS r FROM firsts)"""


_HITS = " UNION ALL ".join(f"SELECT doc_id, '{r.name}' AS rule, '{r.group}' AS concern, '{r.severity}' AS severity, '{r.source}' AS source, {screen.RANK[r.severity]} AS rank FROM documents WHERE regexp_matches(lower(text), '{r.pattern}')" for r in RULES)
_STEPS = """s AS (SELECT doc_id, text AS t0, trim(text) AS t1, lower(trim(text)) AS t2, regexp_replace(lower(trim(text)), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g') AS t3 FROM documents),
 t AS (SELECT *, regexp_replace(t3, '[#*$%&|]+', '', 'g') AS t4 FROM s),
 steps AS (""" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS step, CASE WHEN t{i} = t{i + 1} THEN 'no_change' ELSE 'applied' END AS status FROM t" for i, n in enumerate(("trim", "lower", "spaces", "symbols"))) + ")"
_IDENT = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in T.IDENTIFIERS)
_FOUND = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(html), '{p}') THEN '{n}' END" for n, p in screen.SUSPICIOUS.items()) + "], lambda x: x IS NOT NULL)"
_part = lambda a, b: f"coalesce({a}::DOUBLE / nullif({b}, 0), 1.0)"

ORACLE_SQL = {
    "batch_statistics": f"""WITH r AS (SELECT l_shipdate IS NULL OR l_orderkey % 97 = 0 AS failed, {_SCORE} AS score, (l_suppkey % 100) / 100.0::DOUBLE AS qed, 1.0::DOUBLE + (l_orderkey % 80) / 10.0::DOUBLE AS sa, l_quantity <= 40 AS lip, l_tax < 0.05 AS safe FROM lineitem),
      k AS (SELECT * FROM r WHERE NOT failed)
      SELECT (SELECT count(*) FROM r) AS total, count(*) AS successful, (SELECT count(*) FROM r WHERE failed) AS errors, round(avg(score), 1) AS avg_score, round(avg(qed), 2) AS avg_qed, round(avg(sa), 1) AS avg_sa,
        round(100.0::DOUBLE * count(*) FILTER (lip) / count(*), 1) AS lipinski_rate, round(100.0::DOUBLE * count(*) FILTER (safe) / count(*), 1) AS safety_rate,
        count(*) FILTER (score >= 90) AS excellent, count(*) FILTER (score >= 70 AND score < 90) AS good, count(*) FILTER (score >= 50 AND score < 70) AS moderate, count(*) FILTER (score < 50) AS poor FROM k""",
    "check_engine_scores": f"SELECT l_orderkey, l_linenumber, {_SCORE} AS score FROM lineitem",
    "issue_summary": " UNION ALL ".join(f"SELECT '{k.name}' AS name, '{k.severity}' AS severity, count(*) AS n FROM lineitem WHERE {_FAILS[k.name]} HAVING count(*) > 0" for k in LINE_CHECKS),
    "property_stats": " UNION ALL ".join(f"SELECT '{n}' AS property, count(*) AS n, avg({n}) AS mean, stddev_samp({n}) AS std, {_q(n, 0.25)} AS q1, {_q(n, 0.5)} AS median, {_q(n, 0.75)} AS q3, {_q(n, 0.75)} - {_q(n, 0.25)} AS iqr, min({n}) AS low, max({n}) AS high FROM lineitem" for n in NUMBERS),
    "pearson_matrix": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 4) AS r FROM lineitem" for a, b in _PAIRS) + ") WHERE abs(r) >= 1e-10",
    "iqr_outliers": "WITH d AS (SELECT doc_id, lang, n_chars::DOUBLE AS size FROM documents), q AS (SELECT lang, quantile_cont(size, 0.25) AS a, quantile_cont(size, 0.75) AS b FROM d GROUP BY 1 HAVING count(*) >= 4) SELECT doc_id, d.lang, size, a - 1.5::DOUBLE * (b - a) AS low, b + 1.5::DOUBLE * (b - a) AS high FROM d JOIN q USING (lang) WHERE size < a - 1.5::DOUBLE * (b - a) OR size > b + 1.5::DOUBLE * (b - a)",
    "quality_score": """WITH k AS (SELECT count(*) AS n FROM part GROUP BY p_brand), t AS (SELECT sum(n) AS t, count(*) AS g FROM k),
      e AS (SELECT CASE WHEN max(g) > 1 THEN sum(-(n / t) * log2(n / t)) ELSE 0 END AS h, max(g) AS g FROM k, t),
      s AS (SELECT count(*) FILTER (p_size > 0) * 100.0::DOUBLE / count(*) AS valid, count(*) FILTER (p_retailprice < 1500) * 100.0::DOUBLE / count(*) AS rule FROM part),
      d AS (SELECT round(coalesce(h / nullif(log2(g), 0) * 100, 0), 4) AS diversity, valid, rule FROM e, s)
      SELECT round(valid, 4) AS valid, diversity, round(rule, 4) AS rule, round(0.40::DOUBLE * valid + 0.35::DOUBLE * diversity + 0.25::DOUBLE * rule, 3) AS quality FROM d""",
    "entropy_topn_other": "WITH k AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1), b AS (SELECT CASE WHEN r <= 10 THEN p_brand ELSE 'Other' END AS p_brand, n FROM k) SELECT p_brand, sum(n)::BIGINT AS n FROM b GROUP BY 1",
    "histogram_fixed": "SELECT b.bin, count(l.l_orderkey) AS n FROM (SELECT unnest(range(1, 21)) AS bin) b LEFT JOIN lineitem l ON l.l_extendedprice BETWEEN 0 AND 50000 AND least(floor(l.l_extendedprice / 2500.0) + 1, 20) = b.bin GROUP BY 1",
    "history_view": "SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type = 'purchase' AND contains(props, '1') ORDER BY ts DESC, event_id LIMIT 50 OFFSET 20",
    "history_stats": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, grouping(event_type, strftime(ts, '%Y-%m-%d')) AS level FROM events GROUP BY GROUPING SETS ((), (event_type), (strftime(ts, '%Y-%m-%d')))",
    "result_view_page": "WITH r AS (SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 50000 AND c_mktsegment = 'BUILDING') SELECT *, (SELECT count(*)::INTEGER FROM r) AS total, (SELECT ceil(count(*) / 25.0)::INTEGER FROM r) AS pages FROM r ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50",
    "result_filter": f"SELECT l_orderkey, l_linenumber, {_SCORE} AS score FROM lineitem WHERE NOT l_quantity > 48 AND {_SCORE} >= 40 AND {_SCORE} <= 90 AND NOT l_tax < 0.06",
    "bookmark_tags": "SELECT doc_id FROM documents WHERE contains(text, 'the ') AND contains(text, 'th') AND contains(text, '.') AND source = 'src1'",
    "audit_columns": "SELECT o_orderkey + 1 AS row_number, coalesce(c_name, 'N/A') AS name, coalesce(c_mktsegment, 'N/A') AS segment, CASE WHEN c_acctbal > 0 THEN 'Pass' WHEN NOT c_acctbal > 0 THEN 'Fail' ELSE 'N/A' END AS solvent, CASE o_orderstatus WHEN 'F' THEN 'Pass' WHEN 'O' THEN 'Fail' ELSE 'N/A' END AS filled FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "subset_reindex": "SELECT o_orderkey, o_custkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::INTEGER AS new_index FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)",
    "dedup_groups": _GROUPS,
    "dedup_all_levels": f"SELECT level, count(*) AS groups, sum(members - 1)::BIGINT AS duplicates, (SELECT count(*) FROM documents WHERE text IS NOT NULL) - sum(members - 1)::BIGINT AS unique_rows FROM ({_GROUPS}) GROUP BY 1",
    "dedup_annotate": f"WITH a AS (SELECT doc_id, min(doc_id) OVER w AS representative, count(*) OVER w AS members, doc_id <> min(doc_id) OVER w AS duplicate FROM documents WINDOW w AS (PARTITION BY {_NORM})) SELECT *, dense_rank() OVER (ORDER BY representative) AS group_id FROM a",
    "registration_collisions": f"SELECT sum(n)::BIGINT AS total, count(*) AS unique_hashes, count(*) FILTER (n > 1) AS collisions FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(concat_ws('|', {_NORM}, lang)))",
    "contradictory_labels": "SELECT l_partkey, count(*) AS entries, min(l_quantity) AS least, max(l_quantity) AS most, round(max(l_quantity) / greatest(min(l_quantity), 1e-10), 1) AS fold FROM lineitem WHERE l_quantity > 0 GROUP BY 1 HAVING count(*) >= 2 AND max(l_quantity) / greatest(min(l_quantity), 1e-10) > 10",
    "dataset_diff": f"WITH {_DIFF} SELECT * FROM named",
    "diff_counts": f"WITH {_DIFF} SELECT state, count(*) AS n FROM named GROUP BY 1",
    "health_score": f"""WITH a AS (SELECT count(*) AS total, count(*) FILTER (length(text) > 40) AS parsed, count(*) FILTER (length(text) > 40 AND regexp_matches(text, '\\.$')) AS complete,
        count(DISTINCT CASE WHEN length(text) > 40 THEN {_NORM} END) AS keys, count(*) FILTER (length(text) > 40 AND regexp_matches(text, '[#*$%&]{{3}}')) AS flagged, count(*) FILTER (length(text) > 40 AND text = trim(text)) AS stable FROM documents),
      p AS (SELECT total, parsed, {_part("parsed", "total")} AS parsability, {_part("complete", "parsed")} AS stereo, {_part("keys", "parsed")} AS uniqueness, 1 - coalesce(flagged::DOUBLE / nullif(parsed, 0), 0) AS alerts, {_part("stable", "parsed")} AS consistency FROM a)
      SELECT total, parsed, round(parsability, 6) AS parsability, round(stereo, 6) AS stereo, round(uniqueness, 6) AS uniqueness, round(alerts, 6) AS alerts, round(consistency, 6) AS consistency,
        round((parsability * 0.25::DOUBLE + stereo * 0.15::DOUBLE + uniqueness * 0.20::DOUBLE + alerts * 0.20::DOUBLE + consistency * 0.20::DOUBLE) * 100, 4) AS health FROM p""",
    "curated_rows": "SELECT doc_id, lang, array_to_string(list_sort(list_filter([CASE WHEN length(text) <= 100 THEN 'short' END, CASE WHEN regexp_matches(text, '[#*$%&]{3}') THEN 'symbols' END, CASE WHEN regexp_matches(text, '[A-Z]{12}') THEN 'capitals' END], lambda x: x IS NOT NULL)), ',') AS issues FROM documents",
    "funnel_stages": _funnel(funnel.PRESETS["drug_like"])
    + ", n AS (SELECT i, s, (SELECT count(*) FROM final) AS total, (SELECT count(*) FROM final WHERE split_part(r, ':', 1) = s) AS gone FROM (VALUES "
    + ", ".join(f"({i + 1}, '{s}')" for i, s in enumerate(funnel.ALL_STAGES))
    + ") v(i, s)), m AS (SELECT *, sum(gone) OVER (ORDER BY i) AS upto FROM n) SELECT i::BIGINT AS stage_index, s AS stage, (total - upto + gone)::BIGINT AS n_in, (total - upto)::BIGINT AS n_passed, gone AS n_rejected FROM m",
    "funnel_molecules": _funnel(funnel.PRESETS["fragment_like"]) + " SELECT l_orderkey, l_linenumber, split_part(r, ':', 1) AS stage, split_part(r, ':', 2) AS reason FROM final",
    "qsar_steps": f"WITH {_STEPS} SELECT * FROM steps",
    "qsar_summary": f"WITH {_STEPS} SELECT step, status, count(*) AS n FROM steps GROUP BY 1, 2",
    "rule_screen": f"SELECT doc_id, rule, concern, severity, source FROM ({_HITS})",
    "concern_groups": f"WITH h AS ({_HITS}), m AS (SELECT doc_id, concern, regexp_replace(lower(rule), '[ -]', '_', 'g') AS name, max(rank) AS rank, count(*) AS raw FROM h GROUP BY 1, 2, 3) SELECT doc_id, sum(raw)::BIGINT AS raw, count(*) AS deduped, count(DISTINCT concern) AS concerns, CASE max(rank) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS worst FROM m GROUP BY 1",
    "taxonomy_counts": "SELECT topic, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS topic FROM documents WHERE regexp_matches(lower(text), '{p}')" for p, t in TOPICS) + " UNION ALL SELECT 'unclassified' FROM documents WHERE NOT (" + " OR ".join(f"regexp_matches(lower(text), '{p}')" for p, _ in TOPICS) + ")) GROUP BY 1",
    "suspicious_scan": f"SELECT page_id, array_to_string(list_sort({_FOUND}), ',') AS findings, len({_FOUND}) AS n FROM pages",
    "identifier_types": f"WITH v AS (SELECT trim(p_name) AS t FROM part UNION ALL SELECT trim(url) FROM pages UNION ALL SELECT 'CHEMBL' || o_orderkey FROM orders UNION ALL SELECT c_custkey::VARCHAR FROM customer UNION ALL SELECT 'DB' || lpad(s_suppkey::VARCHAR, 5, '0') FROM supplier) SELECT CASE WHEN t = '' THEN 'name' {_IDENT} ELSE 'name' END AS type, count(*) AS n FROM v GROUP BY 1",
    "layer_diff": """WITH p AS (SELECT page_id, list_filter(string_split('x/' || regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/')[2:], lambda x: x <> '') AS parts FROM pages),
      e AS (SELECT page_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM p),
      k AS (SELECT page_id, i, CASE WHEN regexp_matches(substr(part, 1, 1), '[A-Z0-9]') THEN 'formula' ELSE substr(part, 1, 1) END AS layer, CASE WHEN regexp_matches(substr(part, 1, 1), '[A-Z0-9]') THEN part ELSE substr(part, 2) END AS v FROM e),
      l AS (SELECT page_id, layer, arg_max(v, i) AS v FROM k GROUP BY 1, 2),
      ids AS (SELECT (page_id // 2)::BIGINT AS pair FROM pages GROUP BY 1 HAVING count(*) = 2),
      a AS (SELECT (page_id // 2)::BIGINT AS pair, layer, v FROM l WHERE page_id % 2 = 0), b AS (SELECT ((page_id - 1) // 2)::BIGINT AS pair, layer, v FROM l WHERE page_id % 2 = 1),
      f AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.layer, b.layer) AS layer, a.v AS x, b.v AS y FROM a FULL JOIN b ON a.pair = b.pair AND a.layer = b.layer)
      SELECT f.pair, layer, coalesce(x, '') AS left_value, coalesce(y, '') AS right_value, x IS NOT DISTINCT FROM y AS same FROM f JOIN ids USING (pair)""",
    "numeric_columns": "SELECT name, round(avg((try_cast(v AS DOUBLE) IS NOT NULL)::INT), 6) AS share, avg((try_cast(v AS DOUBLE) IS NOT NULL)::INT) > 0.8 AS numeric FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, {n}::VARCHAR AS v FROM part" for n in ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")) + ") WHERE v IS NOT NULL AND v <> '' GROUP BY 1",
    "cross_source_compare": "WITH v AS (SELECT c_nationkey AS nation, max(c_mktsegment) AS value FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, max(s_name) FROM supplier GROUP BY 1 UNION ALL SELECT n_nationkey, n_name FROM nation) SELECT nation, count(value) AS sources, CASE WHEN count(value) < 2 THEN 'no_data' WHEN count(DISTINCT value) = 1 THEN 'consistent' WHEN count(DISTINCT substr(value, 1, 14)) = 1 THEN 'minor' ELSE 'major' END AS verdict FROM v GROUP BY 1",
    "rate_limit_windows": "SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2",
    "session_windows": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k",
    "eta_moving": "SELECT event_id, user_id, round(coalesce((event_id - first_value(event_id) OVER w)::DOUBLE / nullif(epoch(date_trunc('second', ts)) - first_value(epoch(date_trunc('second', ts))) OVER w, 0), 0), 8) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
}
