"""Flat export columns declared in one place: a section, a header, where the value is in a nested record, and how it is shown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators import view


@dataclass(frozen=True)
class Declared:
    """kind: value (missing as N/A), verdict (Pass, Fail, N/A), count (alerts of the catalogue `at`), check (verdict of the
    first check named `at`), either (the first of the paths in `at`, split by |, that is neither missing nor 0)."""

    section: str
    header: str
    at: str
    kind: str = "value"

    @property
    def name(self) -> str:
        return f"{self.section}: {self.header}"


def _either(paths: list[str]) -> Column:
    first = [F.when(F.col(p).cast("double") != 0, F.col(p).cast("string")) for p in paths[:-1]]
    return F.coalesce(*first, F.col(paths[-1]).cast("string"), F.lit(""))


def column(d: Declared) -> Column:
    if d.kind == "verdict":
        return view.pass_fail(F.col(d.at))
    if d.kind == "check":
        return view.check_passed(d.at)
    if d.kind == "count":
        return view.alert_count(d.at).cast("string")
    if d.kind == "either":
        return _either(d.at.split("|"))
    return view.flat(F.col(d.at))


def flat_rows(df: DataFrame, declared: list[Declared], *keys: str) -> DataFrame:
    """One string column for each declaration, headed by section and header."""
    return df.select(*keys, *(column(d).alias(d.name) for d in declared))


def nested_rows(df: DataFrame, declared: list[Declared], *keys: str) -> DataFrame:
    """One struct for each section, with a field for each of its columns."""
    sections = dict.fromkeys(d.section for d in declared)
    return df.select(*keys, *(F.struct(*(column(d).alias(d.header) for d in declared if d.section == s)).alias(s) for s in sections))


def totals(df: DataFrame, declared: list[Declared]) -> DataFrame:
    """Of each declared column, how many rows have a value and how many pass or fail."""
    flat = flat_rows(df, declared)
    long = flat.select(F.explode(F.array(*(F.struct(F.lit(d.section).alias("section"), F.lit(d.header).alias("header"), F.col(f"`{d.name}`").alias("v")) for d in declared))).alias("x")).select("x.*")
    return long.groupBy("section", "header").agg(F.count_if(F.col("v") != "N/A").alias("present"), F.count_if(F.col("v") == "Pass").alias("passed"), F.count_if(F.col("v") == "Fail").alias("failed"))
