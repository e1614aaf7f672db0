"""Duplicate groups at several levels of likeness, their summary and annotation, and registration hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators import issues, ordering


def normalized(text: Column) -> Column:
    """Lower case, ends trimmed, runs of white space as one blank."""
    return F.regexp_replace(F.lower(F.trim(text)), r"[ \t\n\r\f\x0B]+", " ")


LEVELS = {
    "exact": lambda t: t,
    "normalized": normalized,
    "words": lambda t: F.array_join(F.array_sort(F.array_distinct(F.split(normalized(t), " "))), " "),
    "letters": lambda t: F.regexp_replace(F.lower(t), r"[^a-z]+", ""),
}


def by_level(df: DataFrame, index: str, text: str, levels: list[str] | None = None) -> DataFrame:
    """Groups of two or more at each level: level, key hash, representative (least index), members. One shuffle for all."""
    keyed = F.array(*(F.struct(F.lit(n).alias("level"), F.sha2(LEVELS[n](F.col(text)), 256).alias("key")) for n in levels or LEVELS))
    rows = df.where(F.col(text).isNotNull()).select(index, F.explode(keyed).alias("k")).select(index, "k.level", "k.key")
    return rows.groupBy("level", "key").agg(F.min(index).alias("representative"), F.count("*").alias("members")).where("members > 1")


def level_totals(df: DataFrame, index: str, text: str) -> DataFrame:
    """Groups, duplicates and unique rows at each level, of one pass."""
    rows = df.where(F.col(text).isNotNull())
    keyed = F.array(*(F.struct(F.lit(n).alias("level"), F.sha2(of(F.col(text)), 256).alias("key")) for n, of in LEVELS.items()))
    members = rows.select(F.explode(keyed).alias("k")).groupBy("k.level", "k.key").agg(F.count("*").alias("members"))
    by = members.groupBy("level").agg(F.count_if(F.col("members") > 1).alias("groups"), F.sum(F.col("members") - 1).alias("duplicates"), F.sum("members").alias("total"))
    return by.where("groups > 0").select("level", "groups", "duplicates", (F.col("total") - F.col("duplicates")).alias("unique_rows"))


def annotated(df: DataFrame, index: str, text: str, level: str = "normalized") -> DataFrame:
    """Each row's group (group_id, from 1 by first appearance), its representative, the group's size, and whether it is a
    duplicate. Rows without text are groups of their own."""
    key = F.coalesce(F.sha2(LEVELS[level](F.col(text)), 256), F.concat(F.lit("row:"), F.col(index).cast("string")))
    rows = df.select(index, key.alias("key"))
    groups = ordering.numbered(rows.groupBy("key").agg(F.min(index).alias("representative"), F.count("*").alias("members")), ["representative"], "group_id", 1)
    return issues.joined_by_key(rows, groups, "key", "members").select(index, "group_id", "representative", "members", (F.col(index) != F.col("representative")).alias("duplicate"))


def summary(df: DataFrame, index: str, text: str, annotations: DataFrame) -> DataFrame:
    """One row a group of annotated rows: number, representative and its text, size. The members themselves are the
    annotated rows (a group may hold any share of them, so they are not gathered in a row)."""
    heads = annotations.where("NOT duplicate").select("group_id", "representative", "members")
    return heads.join(df.select(F.col(index).alias("representative"), F.col(text).alias("representative_text")), "representative")


def registration(df: DataFrame, parts: list[Column]) -> DataFrame:
    """Rows, distinct registration hashes, and hashes that several rows share."""
    hashed = df.select(F.sha2(F.concat_ws("|", *parts), 256).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    return hashed.agg(F.sum("n").alias("total"), F.count("*").alias("unique_hashes"), F.count_if(F.col("n") > 1).alias("collisions"))
