"""Quality by hierarchical empirical Bayes.

A document classifier (logistic regression on shape features of the text, fitted to TRAIN_ROWS labelled documents of
either class at most, a documented bound) gives each document's evidence. Grouped aggregation sums that evidence over
sites (host) and their sections (host and path): a site's rate is shrunk to the global rate and a section's to its site's,
by prior strengths that the moments of the groups' rates give, so sparse sites say little. A document's score is its own
evidence with the global prior odds replaced by its section's posterior odds, where site and section are the others there:
its own evidence is taken out of both sums first, so it counts once. Evidence is rounded to PLACES and summed as decimals,
so that the sums do not depend on the order of a shuffle.

The documents table has no URLs: `source` stands for the host and `lang` for the section of its path, as in pages' URLs.
Null or missing hosts and sections are groups of their own; null and empty texts have their features too (all 0); rows
that repeat each get a row; a very long text is one row of counts; without labels of both classes the classifier says 1/2 throughout; an empty table gives an
empty result; other columns are ignored, whatever their names; a score of just KEEP is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import documents, small_enough, staged, string_buffers, text_only, words
from tessel.llm.quality_rules import repeat_words

TRAIN_ROWS, STEPS, RIDGE = 2000, 25, 1.0
#: A document is kept at this score or more.
KEEP = 0.5
#: Decimal places of the evidence.
PLACES = 9
#: Groups that a join may broadcast; beyond it the join is shuffled.
BROADCAST_GROUPS = 200_000
#: Bounds of a prior's strength, in documents.
STRENGTH = (2.0, 1000.0)
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[10], _CLASS[32], _CLASS[128:] = 1, 2, 3, 4, 5, 6
for _c, _s in ((7, b"#*$%&|<>{}[]=~^_\\/+"), (8, b".,;:!?'\"()-")):
    _CLASS[list(_s)] = _c
N_FEATURES = 16


def shape(text: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Shares of byte classes, and lengths and repetition of words."""
    count = np.bincount(_CLASS[text], minlength=9)
    n, w = max(1, len(text)), max(1, len(word))
    distinct = len(np.unique(word))
    return np.array([1.0, *(count / n), np.log1p(len(word)), size.sum() / w / 10, (size.std() if len(size) else 0) / 10, distinct / w, repeat_words(word) / w, count[1] / max(1, count[1] + count[2])])


def features(batches):
    for batch in batches:
        raw, off = string_buffers(batch.column("text"))
        out = np.zeros((len(batch), N_FEATURES))
        for i in range(len(batch)):
            start, end, ids, _ = words(raw, off[i : i + 2], True)
            out[i] = shape(raw[off[i] : off[i + 1]], ids, end - start)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(list(out), pa.list_(pa.float64()))], [*(c for c in batch.schema.names if c != "text"), "x"])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton steps with a ridge, over standardised columns, folded back to the raw ones; last the offset."""
    middle, spread = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate(((x - middle) / spread, np.ones((len(x), 1))), 1)
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(z @ w).clip(-30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(w))
        w -= np.linalg.solve(h, z.T @ (p - y) + RIDGE * w)
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * middle / spread).sum())


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray | None:
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("y")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    hashed = F.xxhash64("doc_id")
    sample = known.where("y = 0").orderBy(hashed, "doc_id").limit(rows).union(known.where("y = 1").orderBy(hashed, "doc_id").limit(rows))
    got = text_only(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y").mapInArrow(features, "doc_id long, y int, x array<double>").orderBy("doc_id").limit(2 * rows).collect()  # 2 * rows at most
    y = np.array([r["y"] for r in got], float)
    if not 0 < y.sum() < len(y):
        return None
    return logistic(np.array([r["x"] for r in got]), y)


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _joined(df: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    return df.join(F.broadcast(groups) if small_enough(groups, BROADCAST_GROUPS) else groups, on, "left")


def strength(groups: DataFrame, rate: str, prior: str) -> float:
    """Documents that the prior counts for: by the moments of the groups' rates around their prior."""
    m = groups.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col(rate) - F.col(prior)) ** 2).alias("between"), F.sum(F.col("n") * F.col(prior) * (1 - F.col(prior))).alias("within")).first()
    if not m["k"] or m["k"] < 2:
        return STRENGTH[1]
    within = m["within"] / m["n"]
    # E[n (r - p)^2] is about p(1-p) per group from sampling, and n var from true differences
    true = max(0.0, (m["between"] - m["k"] * within) / m["n"])
    return float(min(STRENGTH[1], max(STRENGTH[0], within / true - 1 if true > 0 else STRENGTH[1])))


def scored(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, evidence (the classifier's probability), site and section rates, score and kept of each row.

    `host` and `path` name the columns of sites and their sections.
    """
    weights = fitted(docs, labels)
    part = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")).alias
    rows = text_only(docs, part(host)("host"), part(path)("path")).mapInArrow(features, "doc_id long, host string, path string, x array<double>")
    if weights is None:
        rows = rows.select("doc_id", "host", "path", F.lit(0.5).alias("evidence"))
    else:
        terms = sum((F.col("x")[i] * F.lit(float(w)) for i, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
        rows = rows.select("doc_id", "host", "path", (1 / (1 + F.exp(-F.least(F.greatest(terms, F.lit(-12.0)), F.lit(12.0))))).alias("evidence"))
    rows = staged(rows.withColumn("evidence", F.round("evidence", PLACES)), "evidence")
    total_of = lambda c: F.sum(F.col(c).cast(f"decimal(28,{PLACES})")).alias("s")
    sections = staged(rows.groupBy("host", "path").agg(F.count("*").alias("n"), total_of("evidence")), "sections")
    total = sections.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = min(0.999, max(0.001, float(total["s"] or 0) / total["n"])) if total["n"] else 0.5
    as_rate = lambda df: df.withColumn("s", F.col("s").cast("double")).withColumn("rate", F.col("s") / F.col("n"))
    sites = as_rate(sections.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))).withColumn("prior", F.lit(prior))
    m = strength(sites, "rate", "prior")
    shrunk = lambda s, n, weight, to: (s + weight * to) / (n + weight)
    sites = staged(sites.select("host", F.col("s").alias("site_s"), F.col("n").alias("site_n"), shrunk(F.col("s"), F.col("n"), m, F.lit(prior)).alias("all_rate")), "sites")
    below = as_rate(_joined(sections, sites, ["host"]))
    k = strength(below, "rate", "all_rate")
    below = staged(below.select("host", "path", "s", "n", "site_s", "site_n"), "section-sums")
    out = _joined(rows, below, ["host", "path"])
    # of the others: a document's own evidence is in its logit already
    out = out.withColumn("site_rate", shrunk(F.col("site_s") - F.col("evidence"), F.col("site_n") - 1, m, F.lit(prior)))
    out = out.withColumn("section_rate", shrunk(F.col("s") - F.col("evidence"), F.col("n") - 1, k, F.col("site_rate")))
    logit = _odds(F.col("evidence")) - F.lit(float(np.log(prior / (1 - prior)))) + _odds(F.col("section_rate"))
    out = out.withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", "evidence", "site_rate", "section_rate", "score", (F.col("score") >= KEEP).alias("kept"))


def op3_empirical_bayes(spark, sf_dir):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", held.alias("held_out"), "evidence", "site_rate", "section_rate", "score", "kept", F.col("kept").cast("int").alias("predicted"))
