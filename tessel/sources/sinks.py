"""Writers by name: delimited, JSON, Parquet, structure records, duplicate and group reports, property matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators import dedup
from tessel.sources import sdf

EXPORTERS: dict[str, Callable[[DataFrame, str], None]] = {}


def exporter(name: str):
    def register(write):
        EXPORTERS[name] = write
        return write

    return register


def export(df: DataFrame, path: str, kind: str) -> None:
    if kind not in EXPORTERS:
        raise ValueError(f"no exporter {kind}; there are {', '.join(sorted(EXPORTERS))}")
    EXPORTERS[kind](df, path)


@exporter("csv")
def _csv(df: DataFrame, path: str) -> None:
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.csv(path, header=True)


@exporter("json")
def _json(df: DataFrame, path: str) -> None:
    df.write.json(path)


@exporter("parquet")
def _parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


@exporter("sdf")
def _sdf(df: DataFrame, path: str) -> None:
    sdf.write(df, path)


def dedup_report(df: DataFrame, index: str, text: str, path: str) -> None:
    """A table of groups (number, representative and its text, size) and one of rows, with their group's number."""
    dedup.annotated(df, index, text).write.parquet(f"{path}/annotated")
    rows = df.sparkSession.read.parquet(f"{path}/annotated")
    dedup.summary(df, index, text, rows).write.parquet(f"{path}/summary")


def bit_columns(df: DataFrame, key: str, bits: str, width: int) -> DataFrame:
    """The key and one column of 0 or 1 for each bit; null bits give nulls."""
    return df.select(key, *(F.array_contains(bits, i).cast("tinyint").alias(f"bit_{i}") for i in range(width)))


def fingerprint_matrix(df: DataFrame, key: str, bits: str, width: int, path: str) -> None:
    bit_columns(df, key, bits, width).write.parquet(path)
