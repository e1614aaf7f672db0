"""Row-quality engine: declared checks, a severity-weighted score, and issues.

A check is a name, a severity and a predicate that is true for a good row. A predicate that is null counts as failed.
Score: 100 less 50 for each critical, 20 for each error and 5 for each warning that failed, within 0 to 100.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENALTY = {"critical": 50, "error": 20, "warning": 5, "info": 0}


@dataclass(frozen=True)
class Check:
    name: str
    severity: str
    good: Callable[[], Column]


def checked(df: DataFrame, checks: list[Check], only: list[str] | None = None) -> DataFrame:
    """df with checks (array of name, severity, passed) and score; unknown names in `only` are ignored."""
    used = [c for c in checks if only is None or c.name in only]
    results = F.array(*(F.struct(F.lit(c.name).alias("name"), F.lit(c.severity).alias("severity"), F.coalesce(c.good(), F.lit(False)).alias("passed")) for c in used))
    lost = sum((F.when(F.coalesce(c.good(), F.lit(False)), 0).otherwise(PENALTY[c.severity]) for c in used), F.lit(0))
    return df.withColumn("checks", results).withColumn("score", F.greatest(F.lit(0), 100 - lost).cast("long"))


def issues(checked_df: DataFrame, *keys: str) -> DataFrame:
    """A row for each failed check."""
    return checked_df.select(*keys, F.explode(F.filter("checks", lambda c: ~c["passed"])).alias("c")).select(*keys, "c.name", "c.severity")


def summary(checked_df: DataFrame) -> DataFrame:
    """Failed checks by name."""
    return issues(checked_df).groupBy("name", "severity").agg(F.count("*").alias("n"))
