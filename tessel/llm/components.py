"""Connected components by compacting links within partitions and contracting stars across them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import dealt_join, drop_staged, staged

#: Links that a task compacts at a time.
TOGETHER = 1 << 20


def compacted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One tie (node, least node it reaches) for each node that the ties a-b connect to a lesser one."""
    if not len(a):
        return np.zeros((0, 2), np.int64)
    node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    away = root != np.arange(len(node))
    return np.stack((node[away], node[root[away]]), 1)


def compact(batches):
    """The same connections as a partition's links, as ties to the least node of each group."""

    def ties():
        got = compacted(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += len(batch)
        if n >= TOGETHER:
            yield ties()
            held, n = [], 0
    if held:
        yield ties()


def settled(batches):
    """(node, comp) of each node of all links of a task, roots too."""
    held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if held:
        got = compacted(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        root = np.unique(got[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(got[:, 0], root)), pa.array(np.append(got[:, 1], root))], ["node", "comp"])


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, comp) for each node of links (a, b: long): comp is the smallest node that links reach.

    Up to TOGETHER links are what a task compacts at a time anyway: they need no rounds. Of more, a round compacts the links of each partition, so that a node has one tie per partition at most, hangs each node below
    the least of its ties, ties its other ends to that one, and moves the node up to where its own parent hangs. Rows are
    keyed by the greater end, which no hub is; the step up meets hubs, whose rows are dealt over several tasks.
    """
    # as they come: read again in fewer, larger partitions, they are compacted before the first shuffle
    links = staged(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), label)
    if links.count() <= TOGETHER:
        found = staged(links.coalesce(1).mapInArrow(settled, "node long, comp long"), f"{label}-settled")
        drop_staged(links)
        return found
    while True:
        near = links.mapInArrow(compact, "a long, b long")
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        others = near.join(least, "a").where("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"), F.lit(True).alias("moved"))
        least = staged(least, f"{label}-parents")
        above = least.select(F.col("a").alias("m"), F.col("m").alias("top"))
        up = dealt_join(least, above, ["m"]).select("a", F.coalesce("top", "m").alias("b"), F.col("top").isNotNull().alias("moved"))
        old, links = links, staged(up.union(others).groupBy("a", "b").agg(F.max("moved").alias("moved")), label)
        drop_staged(old, least)
        if links.where("moved").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(links.select("b", "b").distinct())
        links = links.select("a", "b")
