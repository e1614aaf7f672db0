"""Identifiers of any type looked up in dimension tables: typed, routed and joined once on (type, id).

Sources come in order of priority: of those that know an identifier the first answers. What its own type does not find is
looked for as a name, and what that does not find comes back unresolved.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import identifier_type


@dataclass(frozen=True)
class Source:
    """A table that knows identifiers: by type the column that holds them, and the column of the answer."""

    name: str
    table: DataFrame
    ids: dict[str, Column]
    answer: Column


def normal(identifier: Column) -> Column:
    """An identifier as it is compared: without blanks around it, in lower case, without the prefix of a compound number."""
    return F.regexp_replace(F.lower(F.trim(identifier)), r"^cid:", "")


def directory(sources: list[Source]) -> DataFrame:
    """(type, id) of all sources, once each: source and answer of the first that knows it (ties in a source: the least)."""
    rows = [s.table.select(F.lit(kind).alias("type"), normal(col.cast("string")).alias("id"), F.struct(F.lit(i).alias("rank"), s.answer.cast("string").alias("answer"), F.lit(s.name).alias("source")).alias("known")) for i, s in enumerate(sources) for kind, col in s.ids.items()]
    return reduce(DataFrame.unionByName, rows).where("id is not null and id <> ''").groupBy("type", "id").agg(F.min("known").alias("known"))


def resolved(requests: DataFrame, key: str, identifier: str, sources: list[Source]) -> DataFrame:
    """key (unique), identifier, its type, whether it was found, the answer, its source, and the type that found it.

    Equal identifiers are looked up once, however many requests have them.
    """
    asked = requests.select(key, identifier).withColumn("_id", normal(F.col(identifier)))
    each = asked.where("_id is not null").groupBy("_id").agg(F.min(F.trim(F.col(identifier))).alias("_text")).withColumn("type", identifier_type(F.col("_text")))
    ways = F.when(F.col("type") == "name", F.array(F.lit("name"))).otherwise(F.array("type", F.lit("name")))
    tried = each.select("_id", F.col("type").alias("own"), F.posexplode(ways).alias("turn", "type"))
    found = tried.join(directory(sources).withColumnRenamed("id", "_id"), ["type", "_id"], "left")
    best = found.groupBy("_id", "own").agg(F.min(F.when(F.col("known").isNotNull(), F.struct("turn", "type", "known"))).alias("b"))
    answer = best.select("_id", F.col("own").alias("type"), F.col("b").isNotNull().alias("resolved"), F.col("b.known.answer").alias("answer"), F.col("b.known.source").alias("source"), F.col("b.type").alias("found_as"))
    return asked.join(answer, "_id", "left").select(key, identifier, F.coalesce("type", F.lit("name")).alias("type"), F.coalesce("resolved", F.lit(False)).alias("resolved"), "answer", "source", "found_as")
