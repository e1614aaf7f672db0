"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written under the folder of spark.checkpoint.dir and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessel/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read again; of other tables nothing is touched."""
    for df in tables:
        spark = df.sparkSession
        own = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessel")
        files = own.getFileSystem(spark._jsc.hadoopConfiguration())
        root = files.makeQualified(own).toUri().getPath()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.toUri().getPath().startswith(f"{root}/"):
                files.delete(path, True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than that many and one."""
    return df.limit(rows + 1).count() <= rows
