"""Helpers shared by the corpus operators: the shared folder, staged tables and vectorised word hashing."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that the numpy helpers work on at a time; bounds a worker's memory whatever the batch.
BLOCK_BYTES = 1 << 20
#: Rows above which a join key is dealt over so many tasks, and hot keys that may be broadcast.
HOT_ROWS, SALTS, MOST_HOT = 20_000, 32, 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessel/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of staged tables (or of plain selections from them) that nothing will read again; of other tables
    nothing is touched."""
    for df in tables:
        spark = df.sparkSession
        own = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessel")
        files = own.getFileSystem(spark._jsc.hadoopConfiguration())
        root = files.makeQualified(own).toUri().getPath()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.toUri().getPath().startswith(f"{root}/"):
                files.delete(path, True)


def text_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), whatever other columns the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def added(df: DataFrame, name: str, kind: str) -> T.StructType:
    """df's schema with one more column."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than that many and one."""
    return df.limit(rows + 1).count() <= rows


def dealt_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", hot: int = HOT_ROWS) -> DataFrame:
    """big joined with small, where a key may hold any share of big's rows: keys of more than `hot` rows (so at most
    rows / hot of them) are dealt over SALTS tasks, each of which gets small's rows of that key."""
    count, flag, salt = "_key_rows", "_key_hot", "_key_salt"
    crowded = big.groupBy(*on).agg(F.count("*").alias(count)).where(F.col(count) > hot).select(*on, F.lit(True).alias(flag))
    if crowded.isEmpty():
        return big.join(small, on, how)
    mark = F.broadcast(crowded) if small_enough(crowded, MOST_HOT) else crowded
    left = big.join(mark, on, "left").withColumn(salt, F.when(F.col(flag), F.pmod(F.xxhash64(*big.columns), F.lit(SALTS))).otherwise(0))
    right = small.join(mark, on, "left").withColumn(salt, F.explode(F.when(F.col(flag), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))).cast("array<long>")))
    return left.drop(flag).join(right.drop(flag), [*on, salt], how).drop(salt)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds) over uint64 arrays."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, at least n of each."""
    if len(_POW[0]) < n:
        n = max(n, 2 * BLOCK_BYTES)
        for at, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POW[at] = np.multiply.accumulate(steps)
    return _POW[0], _POW[1]


def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if fold:
        values[65:91] = values[97:123]
    return values


_FOLDED, _EXACT = _byte_values(True), _byte_values(False)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def prefix_hash(data: np.ndarray, values: np.ndarray = _EXACT) -> np.ndarray:
    """P with P[e]-P[s], times the inverse power of s, the polynomial hash of data[s:e]."""
    power, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls, without copying its text."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def blocks(off: np.ndarray, most: int = BLOCK_BYTES):
    """Ranges of rows whose texts have about `most` bytes together (a longer row stands alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def words(data: np.ndarray, off: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ([^ \\t\\n\\v\\f\\r]+) of the rows that off cuts data into.

    Returns starts and ends (in data, which begins at off[0]), hashes, and the first word of each row (rows + 1 entries).
    """
    text = data[off[0] : off[-1]]
    rel = off - off[0]
    solid = ~_SPACE[text]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    inner = rel[1:-1]
    inner = inner[(inner > 0) & (inner < len(text))]
    begins[inner] = solid[inner]
    stops[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    prefix = prefix_hash(text, _FOLDED if fold else _EXACT)
    return start, end, span_hash(prefix, start, end), np.searchsorted(start, rel)


def shingles(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of a row's k-word shingles; of its whole sequence where it has fewer words; none without words."""
    n = len(word)
    if not n:
        return word
    size = min(k, n)
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + word[j : n - size + 1 + j])
    return out
