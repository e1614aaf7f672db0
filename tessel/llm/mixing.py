"""Mixing sources to target weights by balanced sampling with the cube method.

Sources share the words of all documents by weight, none beyond MOST times its own. A source whose share is r times its
size takes each document floor(r) times, and once more with probability r - floor(r): the cube method draws those that
come once more, so that their words and their number meet what is wanted of both. Blocks of documents fly first: of three
open probabilities the vector that leaves both totals alone is followed, up or down by a draw, until one of them is 0 or 1,
and the next document takes its place. At most two of a block stay open, and meet those of other blocks in the next round,
so that no task ever holds a source; a source's last two land one total at a time, and the words that this misses are made
good by exchanging one document of the last round for another.

Null and empty texts have size 0 and are taken 0 words; a very long text is counted in its row's task; a null source is a
source, the last; rows that are equal by source, id and size are alike, so it does not matter which is taken (ties); null
ids come first; an empty table gives no rows; other columns are ignored, whatever their names. Blocks are cut by place in
the order of ids, and draws come from a seed, source, round and block: reruns agree, whatever the partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import dealt_join, documents, drop_staged, small_enough, staged
from tessel.operators.ordering import BROADCAST_GROUPS, numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating; and how often a document is taken at most.
WEIGHTS, MOST = (1, 2, 3), 3
#: Documents of a block, and of a task, about.
BLOCK, TASK_ROWS = 1024, 16_384
SEED = 13
ROW = "doc_id long, size long, grp string, source_size long, target double, whole long, part double, idx long, block long, blocks long"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """grp, source_size and target of each source: shares by weight, what is above `most` times a size shared again."""
    sums = sizes.groupBy("grp", "source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sums = staged(numbered(sums, ["last", "source"], "place").select("grp", "source_size", weight.alias("weight")), "mix-sources")
    share = 0.0  # words for each unit of weight
    while True:
        full = F.col("weight") * share > most * F.col("source_size")
        words, gone, weight = sums.agg(F.sum("source_size"), F.sum(F.when(full, most * F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        more = ((words or 0) - (gone or 0)) / weight if weight else share
        if more <= share:
            return sums.select("grp", "source_size", F.least(F.col("weight") * F.lit(share), F.lit(most) * F.col("source_size").cast("double")).alias("target"))
        share = more


def fly(size: list[int], part: list[float], draw) -> list[int]:
    """Move probabilities (in place) to 0 or 1 with their sum and that of size * part unchanged; those still open (two at
    most, of different sizes) are returned."""
    ahead, open_ = 0, []
    while True:
        while len(open_) < 3 and ahead < len(part):
            if 0 < part[ahead] < 1:
                open_.append(ahead)
            ahead += 1
        s = [size[i] for i in open_]
        if len(open_) == 3:
            way = (s[1] - s[2], s[2] - s[0], s[0] - s[1]) if s[0] != s[1] or s[1] != s[2] else (1, -1, 0)
        elif len(open_) == 2 and s[0] == s[1]:
            way = (1, -1)
        else:
            return open_
        open_ = moved(part, open_, way, draw)


def moved(part: list[float], open_: list[int], way: tuple[int, ...], draw) -> list[int]:
    """Follow a vector up or down, with the chances that keep each probability's mean, until one of them is 0 or 1."""
    up = min((1 - part[i]) / w if w > 0 else part[i] / -w for i, w in zip(open_, way, strict=True) if w)
    down = min(part[i] / w if w > 0 else (1 - part[i]) / -w for i, w in zip(open_, way, strict=True) if w)
    step = up if draw() * (up + down) < down else -down
    for i, w in zip(open_, way, strict=True):
        p = part[i] + step * w
        part[i] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
    return [i for i in open_ if 0 < part[i] < 1]


def land(size: list[int], part: list[float], open_: list[int], draw) -> None:
    """The last two of a source: first their words alone are kept, then none; what that misses, an exchange mends."""
    want = sum(size[i] * part[i] for i in open_)
    last = list(open_)
    if len(open_) == 2:
        a, b = (size[i] for i in open_)
        open_ = moved(part, open_, (b, -a) if a or b else (1, -1), draw)
    for i in open_:
        part[i] = float(draw() < part[i])
    exchange(np.array(size), part, sum(size[i] * part[i] for i in last) - want)


def exchange(size: np.ndarray, part: list[float], over: float) -> None:
    """Swap one document that is taken for one that is not, if that brings words that are `over` nearer to 0."""
    chosen = np.array(part) == 1
    own, other = np.flatnonzero(chosen), np.flatnonzero(~chosen)
    if not len(own) or not len(other):
        return
    other = other[np.argsort(size[other], kind="stable")]
    at = np.searchsorted(size[other], size[own] - over)
    at = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(other) - 1)])
    left = np.abs(over + size[other][at] - size[own])
    side, i = np.unravel_index(np.argmin(left), left.shape)
    if left[side, i] < abs(over):
        part[own[i]], part[other[at[side, i]]] = 0.0, 1.0


def flown(turn: int, seed: int):
    """Blocks of a task, each flown by itself; a source's only block lands too."""

    def run(table: pa.Table) -> pa.Table:
        table = table.select([c.split()[0] for c in ROW.split(", ")]).sort_by([("grp", "ascending"), ("block", "ascending"), ("size", "descending"), ("idx", "ascending")])
        grp, block, blocks = (table.column(c).to_pylist() for c in ("grp", "block", "blocks"))
        sizes, parts = table.column("size").to_pylist(), table.column("part").to_pylist()
        at = 0
        while at < len(grp):
            end = at + 1
            while end < len(grp) and (grp[end], block[end]) == (grp[at], block[at]):
                end += 1
            draw = np.random.default_rng([seed, turn, block[at], zlib.crc32(grp[at].encode())]).random
            size, part = sizes[at:end], parts[at:end]
            open_ = fly(size, part, draw)
            if blocks[at] == 1:
                land(size, part, open_, draw)
            parts[at:end], at = part, end
        return table.set_column(table.schema.get_field_index("part"), "part", pa.array(parts, pa.float64()))

    return run


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target of its source, times it is taken, and words taken."""
    source = F.col("source").cast("string")
    grp = F.coalesce(F.concat(F.lit("s"), source), F.lit("-"))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), source.alias("source"), grp.alias("grp"))
    sizes = staged(sizes, "mix-sizes")
    goals = staged(targets(sizes, weights, most), "mix-targets")
    places = staged(numbered(sizes.drop("source"), ["doc_id", "size"], "idx", by="grp", total="n"), "mix-places")
    drop_staged(sizes)
    rows = places.join(F.broadcast(goals), "grp") if small_enough(goals, BROADCAST_GROUPS) else dealt_join(places, goals, ["grp"], "inner")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(rate)).withColumn("part", rate - F.col("whole")).withColumn("block", F.floor(F.col("idx") / block)).withColumn("blocks", F.ceil(F.col("n") / block))
    left = rows.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in ROW.split(", ")))
    shut = (F.col("part") == 0) | (F.col("part") == 1)
    done, turn = left.where(shut), 0
    left = left.where(~shut)
    count = places.count()
    while count:
        tasks = max(64, count // TASK_ROWS)
        out = left.withColumn("task", F.pmod(F.xxhash64("grp", "block"), F.lit(tasks))).groupBy("task").applyInArrow(flown(turn, seed), ROW)
        out = staged(out, "mix-round")
        done = done.union(out.where(shut))
        left = out.where(~shut).withColumn("block", F.floor(F.col("block") / (block // 2))).withColumn("blocks", F.ceil(F.col("blocks") / (block // 2)))
        count, turn = left.count(), turn + 1
    times = F.col("whole") + F.col("part").cast("long")
    return done.select("doc_id", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def op13_cube_mix(spark, sf_dir):
    return mixed(documents(spark, sf_dir))
