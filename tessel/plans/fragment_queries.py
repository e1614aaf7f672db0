"""Queries over fragments, layered strings of sources, ranked matches, duplicate reports and verdicts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import fragments
from tessel.operators import audit, dedup, pairs, screen
from tessel.plans.pair_queries import parts, vectors
from tessel.plans.table_queries import _NORM, RULES, documents
from tessel.sources import sinks
from tessel.sources.tables import table

c = F.col
#: Parts have a counterpart by key: each known fragment, then others that no table names.
COUNTERPARTS = (*(n for n, _, _ in fragments.KNOWN), "CCN", "[Fe+3]", "CCCCCCCCCCCC", "N")


def salted(spark, sf_dir):
    """Chains of carbon with a counterpart each; every seventh has two of it."""
    tail = F.element_at(F.array(*(F.lit(n) for n in COUNTERPARTS)), (F.pmod("p_partkey", F.lit(len(COUNTERPARTS))) + 1).cast("int"))
    chain = F.expr("repeat('C', cast(1 + pmod(p_size, 9) as int))")
    twice = F.when(F.pmod("p_partkey", F.lit(7)) == 0, F.concat(F.lit("."), tail)).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(chain, F.lit("."), tail, twice).alias("smiles"))


def fragment_roles(spark, sf_dir):
    """Every fragment that desalting removes: its name, role and how often."""
    gone = salted(spark, sf_dir).select(F.explode(fragments.desalted(c("smiles"))["removed"]).alias("r")).select("r.*")
    return gone.groupBy("fragment", "name", "role").agg(F.count("*").alias("n"))


def desalted_parts(spark, sf_dir):
    both = salted(spark, sf_dir).select("p_partkey", fragments.desalted(c("smiles")).alias("d"))
    return both.select("p_partkey", "d.parent", F.array_join(F.transform("d.removed", lambda r: F.concat(r["fragment"], F.lit(":"), r["role"])), " ").alias("removed"))


def layered(spark, sf_dir):
    """Layered strings of parts as three sources tell them: some lack one, some part in a layer."""
    p = table(spark, sf_dir, "part")
    key = c("p_partkey")
    made = lambda formula, bonds, rest: F.concat_ws("/", F.lit("X=1S"), formula, bonds, rest)
    formula, bonds, rest = F.replace("p_brand", F.lit("#"), F.lit("")), F.concat(F.lit("c"), "p_size"), F.concat(F.lit("h"), "p_type")
    values = {
        "a": F.when(key % 11 != 0, made(formula, bonds, rest)),
        "b": F.when(key % 5 != 0, made(formula, F.when(key % 3 == 0, F.lit("c0")).otherwise(bonds), F.when(key % 7 == 0, F.lit("h0")).otherwise(rest))),
        "c": F.when(key % 2 == 0, made(F.when(key % 4 == 0, F.lit("Y")).otherwise(formula), bonds, rest)),
    }
    rows = F.array(*(F.struct(F.lit(n).alias("source"), v.alias("value")) for n, v in values.items()))
    return p.select("p_partkey", F.explode(rows).alias("r")).select("p_partkey", "r.source", "r.value")


def dedup_summary(spark, sf_dir):
    d = documents(spark, sf_dir).where("doc_id is not null")
    return dedup.summary(d, "doc_id", "text", dedup.annotated(d, "doc_id", "text")).select("group_id", "representative", "members", F.md5("representative_text").alias("text_md5"))


QUERIES = {
    "fragment_roles": fragment_roles,
    "desalted_parts": desalted_parts,
    "layer_verdicts": lambda s, d: audit.compared_layers(layered(s, d), "p_partkey"),
    "mmp_ranked": lambda s, d: pairs.best_matches(parts(s, d), "p_partkey", "tokens", "p_retailprice", 1000),
    "dedup_summary": dedup_summary,
    "fingerprint_columns": lambda s, d: sinks.bit_columns(vectors(s, d), "vec_id", "bits", 16),
    "screen_verdicts": lambda s, d: screen.verdicts(documents(s, d), c("text"), RULES, "doc_id"),
}

_KNOWN = "known(notation, name, role) AS (VALUES " + ", ".join(f"('{n}', '{name}', '{role}')" for n, name, role in fragments.KNOWN) + ")"
_TAILS = "[" + ", ".join(f"'{n}'" for n in COUNTERPARTS) + "]"
_REMOVED = f"""WITH {_KNOWN}, t AS (SELECT p_partkey, repeat('C', (1 + p_size % 9)::INTEGER) AS chain, {_TAILS}[1 + p_partkey % {len(COUNTERPARTS)}] AS tail FROM part),
  f AS (SELECT p_partkey, 0 AS spot, chain AS f FROM t UNION ALL SELECT p_partkey, 1, tail FROM t UNION ALL SELECT p_partkey, 2, tail FROM t WHERE p_partkey % 7 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY len(regexp_extract_all(f, '\\[[^\\]]*\\]|Br|Cl|[BCNOPSFIbcnops]')) DESC, len(f) DESC, f DESC, spot DESC) AS place FROM f),
  k AS (SELECT r.*, name, coalesce(role, 'unknown') AS role FROM r LEFT JOIN known ON f = notation)"""
_LAYERED = """v AS (SELECT p_partkey, replace(p_brand, '#', '') AS f, 'c' || p_size AS b, 'h' || p_type AS h FROM part),
  l AS (SELECT p_partkey, f, b, h FROM v WHERE p_partkey % 11 <> 0
    UNION ALL SELECT p_partkey, f, CASE WHEN p_partkey % 3 = 0 THEN 'c0' ELSE b END, CASE WHEN p_partkey % 7 = 0 THEN 'h0' ELSE h END FROM v WHERE p_partkey % 5 <> 0
    UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Y' ELSE f END, b, h FROM v WHERE p_partkey % 2 = 0),
  g AS (SELECT p.p_partkey, count(f) AS found, count(DISTINCT f || '/' || b || '/' || h) AS n, count(DISTINCT f) AS nf, count(DISTINCT b) AS nb FROM part p LEFT JOIN l ON p.p_partkey = l.p_partkey GROUP BY 1)"""
ORACLE_SQL = {
    "fragment_roles": f"{_REMOVED} SELECT f AS fragment, name, role, count(*) AS n FROM k WHERE place > 1 GROUP BY 1, 2, 3",
    "desalted_parts": f"{_REMOVED} SELECT p_partkey, max(f) FILTER (place = 1) AS parent, coalesce(string_agg(f || ':' || role, ' ' ORDER BY spot) FILTER (place > 1), '') AS removed FROM k GROUP BY 1",
    "layer_verdicts": f"WITH {_LAYERED} SELECT p_partkey, found, CASE WHEN found < 2 THEN 'missing' WHEN n = 1 THEN 'match' WHEN nf = 1 THEN 'minor_difference' ELSE 'mismatch' END AS status, CASE WHEN found < 2 OR n = 1 THEN 'none' WHEN nf <> 1 THEN 'formula' WHEN nb <= 1 THEN 'later_layers' ELSE 'connectivity' END AS parts_at FROM g",
    "mmp_ranked": """WITH t AS (SELECT p_partkey AS id, p_retailprice AS v, string_split(concat_ws(' ', p_brand, p_type, p_size::VARCHAR), ' ') AS tk FROM part),
      n AS (SELECT id, v, tk, unnest(range(1, len(tk) + 1)) AS i FROM t),
      k AS (SELECT id, v, tk, tk[i] AS token, array_to_string(list_transform(tk, lambda u, j: CASE WHEN j = i THEN '*' ELSE u END), ' ') AS core FROM n),
      m AS (SELECT a.id AS a, b.id AS b, a.core, a.token AS a_token, b.token AS b_token, round(abs(a.v - b.v), 4) AS gap, a.tk AS x, b.tk AS y, row_number() OVER (PARTITION BY a.id, b.id ORDER BY a.core) AS r FROM k a JOIN k b ON a.core = b.core AND a.id < b.id AND a.token <> b.token)
      SELECT a, b, core, a_token, b_token, gap, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM m WHERE r = 1 ORDER BY similarity DESC, a, b LIMIT 1000""",
    "dedup_summary": f"WITH g AS (SELECT min(doc_id) AS representative, count(*) AS members FROM documents GROUP BY {_NORM}) SELECT dense_rank() OVER (ORDER BY representative) AS group_id, representative, members, md5(text) AS text_md5 FROM g JOIN documents ON doc_id = representative",
    "fingerprint_columns": "SELECT vec_id, " + ", ".join(f"(embedding[{i + 1}] > 0)::TINYINT AS bit_{i}" for i in range(16)) + " FROM embeddings",
    "screen_verdicts": "WITH s AS (" + " UNION ALL ".join(f"SELECT doc_id, '{s}' AS source, {' + '.join(f'''coalesce(regexp_matches(lower(text), '{r.pattern}'), false)::BIGINT''' for r in RULES if r.source == s)} AS matches FROM documents" for s in ("a", "b")) + ") SELECT doc_id, source, matches, matches = 0 AS passed, sum(matches) OVER (PARTITION BY doc_id) = 0 AS all_passed FROM s",
}
