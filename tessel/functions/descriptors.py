"""Descriptor columns that the scoring expressions read.

Structures need a chemistry kernel for these; the engine takes them as columns. `from_lineitem` gives a deterministic
stand-in over the relational test tables, one row per order line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("l_orderkey", "l_linenumber")


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    mod = lambda c, n: F.pmod(F.col(c), F.lit(n))
    return lineitem.select(
        *KEYS,
        (100.0 + 12.0 * F.col("l_quantity")).alias("mw"),
        (80.0 * F.col("l_discount") - 2.0 + 5.0 * F.col("l_tax")).alias("logp"),
        mod("l_partkey", 180).cast("double").alias("tpsa"),
        mod("l_suppkey", 8).cast("int").alias("hbd"),
        mod("l_partkey", 14).cast("int").alias("hba"),
        mod("l_orderkey", 15).cast("int").alias("rotb"),
        F.col("l_linenumber").cast("int").alias("rings"),
        mod("l_linenumber", 4).cast("int").alias("arom"),
        (mod("l_partkey", 100) / 100.0).alias("fsp3"),
        (F.col("l_quantity") + 5.0).alias("heavy"),
        (30.0 + 2.5 * F.col("l_quantity")).alias("mr"),
        (mod("l_suppkey", 100) / 100.0).alias("qed"),
        (mod("l_linenumber", 3) - 1).cast("int").alias("charge"),
        (1.0 + mod("l_orderkey", 80) / 10.0).alias("sa"),
        (4.0 + mod("l_orderkey", 50) / 10.0).alias("activity"),
        (mod("l_suppkey", 3) == 0).alias("basic_n"),
    )


SQL = """
descriptors AS (SELECT l_orderkey, l_linenumber,
  100.0::DOUBLE + 12.0::DOUBLE * l_quantity AS mw, 80.0::DOUBLE * l_discount - 2.0::DOUBLE + 5.0::DOUBLE * l_tax AS logp,
  CAST(l_partkey % 180 AS DOUBLE) AS tpsa, CAST(l_suppkey % 8 AS INTEGER) AS hbd, CAST(l_partkey % 14 AS INTEGER) AS hba,
  CAST(l_orderkey % 15 AS INTEGER) AS rotb, l_linenumber AS rings, l_linenumber % 4 AS arom,
  CAST(l_partkey % 100 AS DOUBLE) / 100.0::DOUBLE AS fsp3, l_quantity + 5.0::DOUBLE AS heavy, 30.0::DOUBLE + 2.5::DOUBLE * l_quantity AS mr,
  CAST(l_suppkey % 100 AS DOUBLE) / 100.0::DOUBLE AS qed, l_linenumber % 3 - 1 AS charge,
  1.0::DOUBLE + CAST(l_orderkey % 80 AS DOUBLE) / 10.0::DOUBLE AS sa, 4.0::DOUBLE + CAST(l_orderkey % 50 AS DOUBLE) / 10.0::DOUBLE AS activity, l_suppkey % 3 = 0 AS basic_n
  FROM lineitem)
"""
