"""Sharding by fixed virtual slots [native].

Records hash into a fixed number of slots, the bytes of each slot are summed, and a versioned slot-to-shard map says
where a slot lives. Only the map is edited when shards are added or loads drift; records never hash again. The map has
n_slots rows at most, however large the table, so it is the one thing that the driver sees. Named maps are kept by version
in the shared folder, and the latest one is what the next edit begins with.

Nulls count as empty texts (size 1); a very long text is one large row of its slot; rows that repeat an id and a text share a
slot (so the shard that has it is larger than the others by their bytes, where these are more than a shard's share) and are
numbered one after another (ties between their numbers are theirs alone, as the rows are equal); an empty table gives an
empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessel.llm.common import documents, shared_dir, staged, text_only

N_SLOTS, N_SHARDS = 4096, 8
MAP = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("vslot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("slot_bytes", T.LongType()), T.StructField("slot_rows", T.LongType()), T.StructField("base", T.LongType())])


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32 and virtual slot of each row."""
    return text_only(docs).select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    ).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_loads(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of each slot in use: n_slots entries at most."""
    return [(r[0], r[1], r[2]) for r in rows.groupBy("vslot").agg(F.sum("size"), F.count("*")).collect()]


def new_map(loads: list[tuple[int, int, int]], n_shards: int) -> dict[int, int]:
    """Largest slot first, each to the shard with the fewest bytes so far."""
    heap = [(0, 0, s) for s in range(n_shards)]
    out = {}
    for slot, size, count in sorted(loads, key=lambda x: (-x[1], x[0])):
        used, rows, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (used + size, rows + count, shard))
    return out


def rebalanced(loads: list[tuple[int, int, int]], at: dict[int, int], n_shards: int, slack: float = 0.01) -> dict[int, int]:
    """Edit a map: slots go from the fullest to the emptiest shard while that narrows a gap over slack of the mean.

    Slots that the map lacks go to the emptiest shard. Growing to more shards moves slots into the new ones only as long
    as the others stay even.
    """
    out, used = dict(at), [0] * n_shards
    size = {slot: n for slot, n, _ in loads}
    for slot in sorted(size, key=lambda s: (-size[s], s)):
        if slot in at:
            used[at[slot]] += size[slot]
    for slot in sorted(size.keys() - at.keys(), key=lambda s: (-size[s], s)):
        out[slot] = min(range(n_shards), key=lambda s: (used[s], s))
        used[out[slot]] += size[slot]
    mean = max(1, sum(used) / n_shards)
    by = [sorted((size[k], k) for k, v in out.items() if v == s and k in size) for s in range(n_shards)]
    while True:
        high, low = max(range(n_shards), key=lambda s: (used[s], -s)), min(range(n_shards), key=lambda s: (used[s], s))
        gap = used[high] - used[low]
        fit = [x for x in by[high] if 0 < x[0] <= gap / 2]
        if gap <= slack * mean or not fit:
            return out
        move = fit[-1]
        by[high].remove(move)
        by[low].append(move)
        by[low].sort()
        used[high] -= move[0]
        used[low] += move[0]
        out[move[1]] = low


def _home(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessel/slot-maps/{name}"


def versions(spark: SparkSession, name: str) -> list[int]:
    """Versions that a named map has."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_home(spark, name))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(p.getName()[2:]) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def stored_map(spark: SparkSession, name: str, version: int | None = None) -> DataFrame:
    """A version of a named map, the latest if none is asked for."""
    known = versions(spark, name)
    if not known or version not in (None, *known):
        raise KeyError(f"there is no version {version or 1} of the map {name}")
    return spark.read.schema(MAP).parquet(f"{_home(spark, name)}/v={version or known[-1]}")


def map_table(rows: DataFrame, at: dict[int, int], loads: list[tuple[int, int, int]], version: int, name: str) -> DataFrame:
    """The map, stored under its name and version; base numbers a slot's first row within its shard."""
    out, base = [], {}
    for slot, size, count in sorted(loads):
        shard = at[slot]
        out.append((version, slot, shard, size, count, base.get(shard, 0)))
        base[shard] = base.get(shard, 0) + count
    spark = rows.sparkSession
    spark.createDataFrame(out, MAP).coalesce(1).write.mode("overwrite").parquet(f"{_home(spark, name)}/v={version}")
    return stored_map(spark, name, version)


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each row's shard and its gapless number there: the base of its slot and its rank in the slot."""
    rank = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(rank))
        .join(F.broadcast(slot_map), "vslot")  # N_SLOTS rows at most
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"))
    )


def shard(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, name: str | None = None) -> DataFrame:
    """Rows with shard, number there and the version of the map that says so.

    name: of a map that is kept. Its latest version is edited to today's loads and stored as the next one, so that only the
    slots that drifted, or that go to new shards, move; the first version is made. Without a name the map is a new one.
    """
    spark, name = docs.sparkSession, name or uuid.uuid4().hex
    rows = staged(slotted(docs, n_slots), "slotted")
    loads = slot_loads(rows)
    known = versions(spark, name)
    if not known:
        return placed(rows, map_table(rows, new_map(loads, n_shards), loads, 1, name))
    at = {r["vslot"]: r["shard"] for r in stored_map(spark, name).select("vslot", "shard").collect()}  # n_slots rows at most
    return placed(rows, map_table(rows, rebalanced(loads, at, n_shards), loads, known[-1] + 1, name))


def slot_map_growth(spark, sf_dir):
    """Documents whose map is edited: the shard of version 1, and of version 2 when a shard is added."""
    name = uuid.uuid4().hex
    shard(documents(spark, sf_dir), name=name)
    now = shard(documents(spark, sf_dir), N_SHARDS + 1, name=name)
    before = stored_map(spark, name, 1).select("vslot", F.col("shard").alias("shard_before"))
    return now.join(F.broadcast(before), "vslot").select("doc_id", "size", "shard_before", F.col("shard").alias("shard_after"), "map_version", (F.col("shard") != F.col("shard_before")).alias("moved"))  # N_SLOTS rows at most


def op9_virtual_slots(spark, sf_dir):
    return shard(documents(spark, sf_dir))
