"""Issues of a dataset as rows, entries of contradictory labels in order, and a join by a key that may be hot.

Null keys have no duplicates; an empty table has no issues; of rows that repeat an index only later ones are duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators import audit, ordering

#: A key is hot with more than a thousandth of the grouped rows, so there are fewer than a thousand hot keys.
HOT_SHARE = 1000


def joined_by_key(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined (inner) with one group row for each key; size: rows of the group.

    Rows of hot keys meet their group by a broadcast of fewer than HOT_SHARE rows, so that no task gets a hot key whole; the
    rest is an ordinary join, to which hot rows do not go.
    """
    total = groups.agg(F.sum(size).alias("_all"))
    marked = groups.join(F.broadcast(total)).withColumn("_hot", F.col(size) * HOT_SHARE > F.col("_all")).drop("_all")  # one row
    hot, cold = marked.where("_hot").drop("_hot"), marked.where("NOT _hot").drop("_hot")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").where(F.col(key).isNotNull())
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def issue_rows(df: DataFrame, index: str, text: str, parsed: Column, complete: Column, key: Column, alerts: Column, agree: Column) -> DataFrame:
    """row_index, smiles, issue_type, severity, description: what costs a dataset its health score.

    parse_failure (critical), undefined_stereo and alert_hit (warning), duplicate and std_disagreement (info); only parsed
    rows have others than the first. All rows are looked at, also for agreement. Of a key's rows all but one of the least
    index are duplicates. alerts counts a row's alerts; null counts as none, null conditions as false.
    """
    ok = F.coalesce(parsed, F.lit(False))
    rows = df.select(
        F.col(index).alias("row_index"), F.col(text).alias("smiles"), ok.alias("_ok"), F.coalesce(complete, F.lit(False)).alias("_complete"),
        F.when(ok, key).alias("_key"), F.coalesce(alerts, F.lit(0)).cast("int").alias("_alerts"), F.coalesce(agree, F.lit(False)).alias("_agree"),
    )
    issue = lambda when, kind, severity, words: F.when(when, F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), words.alias("description")))
    own = F.array(
        issue(~F.col("_ok"), "parse_failure", "critical", F.concat(F.lit("SMILES could not be parsed: '"), F.coalesce("smiles", F.lit("")), F.lit("'"))),
        issue(F.col("_ok") & ~F.col("_complete"), "undefined_stereo", "warning", F.lit("Molecule has undefined stereocenters")),
        issue(F.col("_ok") & (F.col("_alerts") > 0), "alert_hit", "warning", F.concat(F.lit("Triggered "), F.col("_alerts").cast("string"), F.lit(" structural alert(s)"))),
        issue(F.col("_ok") & ~F.col("_agree"), "std_disagreement", "info", F.lit("Standardization pipelines disagree")),
    )
    single = rows.select("row_index", "smiles", F.explode(F.array_compact(own)).alias("x")).select("row_index", "smiles", "x.*")
    keyed = rows.where(F.col("_key").isNotNull()).select("row_index", "_key")
    groups = keyed.groupBy("_key").agg(F.min("row_index").alias("_first"), F.count("*").alias("_n"))
    later = joined_by_key(keyed, groups.where("_n > 1"), "_key", "_n").where("row_index > _first")
    twice = later.select("row_index", F.lit("").alias("smiles"), F.lit("duplicate").alias("issue_type"), F.lit("info").alias("severity"), F.concat(F.lit("Duplicate InChIKey: "), F.col("_key").cast("string")).alias("description"))
    return single.unionByName(twice)


def contradictory_entries(df: DataFrame, key: str, value: str, index: str, fold: float = 10.0) -> DataFrame:
    """place, key, index, activity, fold: entries of contradictory keys, greatest rounded fold first, then by key, within a
    key by activity and index. Places come from a range-partitioned sort, so a hot key's entries are never in one task."""
    groups = audit.contradictory_labels(df, key, value, fold).select(key, "fold", F.col("entries").alias("_n"))
    v = F.col(value).try_cast("double")
    rows = df.select(key, F.col(index), v.alias("activity")).where((F.col("activity") > 0) & ~F.isnan("activity"))
    found = joined_by_key(rows, groups, key, "_n").drop("_n").withColumn("_fall", -F.col("fold"))
    return ordering.numbered(found, ["_fall", key, "activity", index], "place").drop("_fall")
