"""Merkle manifest of a table: a leaf for each row, a tree for each source, a tree over the sources' roots.

Leaves of a source stand in order of doc_id. A window over (source, parent) collects the hashes of each run of FAN nodes in
order, whole frame: the array is the parent's preimage and holds each node's siblings. One row of a run goes on as the
parent, so that a level has a FAN-th of the rows of the one below. Going down again, each node gets the path of its parent
and its own siblings before it; a path is as long as the tree is high. Places in a source come from a range-partitioned
sort, so that no task holds a source, however large; windows and joins are by (source, parent): FAN rows each.

Nulls are hashed as `-` (a null source is a source of its own, before the others; null ids come first and are never
tampered with); empty texts are hashed as length 0; a very long text is hashed whole by its row's task; rows with equal ids
stand in order of their leaves, and equal rows have equal leaves in any order (each has the proof of its own place); an
empty table gives no rows; columns beyond the five are no part of a leaf, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm.common import documents, drop_staged, staged
from tessel.operators.ordering import numbered

#: Nodes of a run, which become one parent.
FAN = 16
#: What a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Of rows whose id's checksum this divides, the manifest tells how a tampered text would fold.
TAMPERED = 5
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; `-` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(field(text if c == "text" else F.col(c)) for c in FIELDS)), 256)


def leaves(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """doc_id, source, grp (the source, never null), hash, and where `tampered` holds the leaf of the changed text."""
    one = lambda c: F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c)
    rows = docs.select(*(one(c) for c in FIELDS))
    return rows.select("doc_id", "source", field(F.col("source")).alias("grp"), leaf(F.col("text")).alias("hash"), F.when(tampered, leaf(changed)).alias("changed"))


def in_runs(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, idx, hash, n: nodes of the group at this level) with their parent's place and the hashes of their run.

    The last node of a group is alone in its run, of parent -1: nothing is above it in its tree.
    """
    rows = nodes.withColumn("parent", F.when(F.col("n") > 1, F.floor(F.col("idx") / FAN)).otherwise(-1))
    run = Window.partitionBy("grp", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("run", F.collect_list("hash").over(run))


def parents(nodes: DataFrame) -> DataFrame:
    """A node for each run: the run's first row stands for it."""
    firsts = in_runs(nodes.where("n > 1")).where(F.col("idx") % FAN == 0)
    return firsts.select("grp", "source", F.col("parent").alias("idx"), F.sha2(F.array_join("run", ""), 256).alias("hash"), F.ceil(F.col("n") / FAN).alias("n"))


def tree(nodes: DataFrame) -> list[DataFrame]:
    """The levels of all groups' trees from the nodes up; a group ends at the level where it has one node."""
    levels = [nodes]
    while not levels[-1].where("n > 1").isEmpty():
        levels.append(staged(parents(levels[-1]), "merkle-level"))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """The last node of each group, and its level."""
    ends = [level.where("n = 1").select("grp", "source", "hash", F.lit(i).alias("level")) for i, level in enumerate(levels)]
    out = ends[0]
    for more in ends[1:]:
        out = out.union(more)
    return out


def proven(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes with the paths of their parents (above: grp, parent, path, ...), their own siblings before it."""
    rows = in_runs(nodes)
    at = (F.col("idx") % FAN).cast("int")
    own = F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("left"), F.array_join(F.slice("run", at + 2, F.lit(FAN)), "").alias("right"))
    return rows.join(above, ["grp", "parent"]).withColumn("path", F.when(F.col("n") > 1, F.concat(F.array(own), F.col("path"))).otherwise(F.col("path"))).drop("run", "parent")


def descended(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The nodes of the lowest level with their paths. top: grp, level, path and what else the nodes get of their group's top."""
    keep = [c for c in top.columns if c not in ("grp", "level")]
    above = None
    for i in range(len(levels) - 1, -1, -1):
        ends = top.where(F.col("level") == i).select("grp", F.lit(-1).cast("long").alias("parent"), *keep)
        here = proven(levels[i], ends if above is None else above.unionByName(ends))
        above = here.select("grp", F.col("idx").alias("parent"), *keep)
    return here


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, start, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None) -> DataFrame:
    """Each row's leaf, its source's root, the table's root, the digest of its proof, the root that its proof folds to from
    the changed text where `tampered` holds (else from its own leaf), and whether that is the root."""
    tampered = F.lit(False) if tampered is None else tampered
    made = staged(leaves(docs, tampered, F.col("text") if changed is None else changed), "merkle-leaves")
    nodes = staged(numbered(made, ["doc_id", "hash"], "idx", by="grp", total="n"), "merkle-nodes")
    drop_staged(made)
    levels = tree(nodes)
    ends = staged(tops(levels), "merkle-tops")
    roots = staged(numbered(ends.withColumnRenamed("grp", "own"), ["source"], "idx", by=None, total="n").withColumn("grp", F.lit("")), "merkle-roots")
    over = tree(roots)
    root = tops(over).select("grp", "level", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    top = descended(over, root).select(F.col("own").alias("grp"), "path", "root", F.col("hash").alias("subroot")).join(ends.select("grp", "level"), "grp")
    rows = descended(levels, top)
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    rows = rows.withColumn("folded_root", folded(F.col("path"), F.coalesce("changed", "hash")))
    return rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def op11_merkle_manifest(spark, sf_dir):
    """The manifest of documents; where TAMPERED divides the checksum of a row's id, its text's A-Z are lower-cased."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return manifest(documents(spark, sf_dir), tampered, lowered(F.col("text")))


def _levels(name: str, at: int) -> str:
    """SQL of a tree's levels: groups with one node stay as they are."""
    out = []
    for i in range(at):
        out.append(f"""{name}{i}w AS (SELECT *, CASE WHEN n > 1 THEN idx // {FAN} ELSE -1 END AS parent, string_agg(hash, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS body,
  coalesce(string_agg(hash, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(hash, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{i} WINDOW run AS (PARTITION BY grp, CASE WHEN n > 1 THEN idx // {FAN} ELSE -1 END ORDER BY idx)),
{name}{i + 1} AS (SELECT grp, CASE WHEN n > 1 THEN parent ELSE 0 END AS idx, CASE WHEN n > 1 THEN sha256(body) ELSE hash END AS hash, CASE WHEN n > 1 THEN (n + {FAN - 1}) // {FAN} ELSE 1 END AS n FROM {name}{i}w WHERE idx % {FAN} = 0)""")
    return ",\n".join(out)


def _paths(name: str, at: int, start: str) -> str:
    """SQL of the same levels downwards: p is the digests' text, s the steps of the fold."""
    out, above = [], start
    for i in range(at - 1, -1, -1):
        out.append(f"""{name}{i}p AS (SELECT w.*, CASE WHEN w.n > 1 THEN w.l || w.r ELSE '' END || a.p AS p, CASE WHEN w.n > 1 THEN [{{'l': w.l, 'r': w.r}}] ELSE [] END || a.s AS s FROM {name}{i}w w JOIN {above} a ON a.grp = w.grp AND a.idx = CASE WHEN w.n > 1 THEN w.parent ELSE 0 END)""")
        above = f"{name}{i}p"
    return ",\n".join(out)


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END" for c in (text if f == "text" else f for f in FIELDS)) + ")"


#: CRC-32 in SQL: the reflected polynomial 0xEDB88320, a byte and then eight shifts at a time.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"
#: Levels that the SQL has: enough for 16^6 rows of a source, and as many sources.
_HIGH = 6
OP11_SQL = f"""
WITH d AS (SELECT doc_id, source, {_leaf("text")} AS hash, CASE WHEN {_CRC} % {TAMPERED} = 0 AND text IS NOT NULL THEN {_leaf("low")} END AS changed
  FROM (SELECT *, translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS low FROM documents)),
a0 AS (SELECT *, coalesce('s' || source, '-') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d),
{_levels("a", _HIGH)},
b0 AS (SELECT '' AS grp, t.grp AS own, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM a{_HIGH} t JOIN (SELECT DISTINCT grp, source FROM a0) USING (grp)),
{_levels("b", _HIGH)},
top AS (SELECT grp, 0 AS idx, hash AS root, '' AS p, CAST([] AS STRUCT(l VARCHAR, r VARCHAR)[]) AS s FROM b{_HIGH}),
{_paths("b", _HIGH, "top")},
subs AS (SELECT own AS grp, 0 AS idx, hash AS subroot, p, s FROM b0p),
{_paths("a", _HIGH, "subs")},
f AS (SELECT *, list_reduce(list_prepend({{'l': coalesce(changed, hash), 'r': ''}}, s), lambda h, x: {{'l': sha256(x.l || h.l || x.r), 'r': ''}}).l AS folded FROM a0p)
SELECT doc_id, hash AS leaf, subroot, root, sha256(f.p) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM f JOIN subs USING (grp) CROSS JOIN (SELECT root FROM top)
"""
