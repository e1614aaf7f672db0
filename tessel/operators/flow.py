"""The batch flow end to end: checks, optional scores and alerts on each row, then the statistics of the batch."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators import checks, screen, stats


@dataclass(frozen=True)
class Options:
    """What a batch computes for each row: named scores, and alerts of a rule list over a text column."""

    checks: list[checks.Check]
    only: list[str] | None = None
    scores: dict[str, Column] = field(default_factory=dict)
    rules: list[screen.Rule] = field(default_factory=list)
    text: str | None = None


def processed(df: DataFrame, options: Options) -> DataFrame:
    """df with checks and score, and what else the options ask for: scores by name, alerts (name, catalog) of its text."""
    out = checks.checked(df, options.checks, options.only)
    if options.rules and options.text:
        low = F.lower(F.col(options.text))
        out = out.withColumn("_low", low)
        found = F.array(*(F.when(F.col("_low").rlike(r.pattern), F.struct(F.lit(r.name).alias("name"), F.lit(r.source).alias("catalog"))) for r in options.rules))
        out = out.withColumn("alerts", F.filter(found, lambda x: x.isNotNull())).drop("_low")
    return out.withColumns(options.scores) if options.scores else out


def batch(df: DataFrame, options: Options, failed: Column, safe: Column) -> DataFrame:
    """One row of statistics over the processed rows; scores must name qed, sa and lipinski."""
    rows = processed(df, options)
    return stats.batch_statistics(rows.select(failed.alias("failed"), "score", "qed", "sa", "lipinski", safe.alias("safe")))
