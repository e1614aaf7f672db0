"""What an upload holds: signatures of other file kinds, suspicious content, and how much of it is printable.

Files are read as binary rows; only their first bytes are looked at, as the format checks need no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators.screen import SUSPICIOUS

# First bytes (hexadecimal) of kinds of files that are no text.
SIGNATURES = {"4D5A": "windows executable", "7F454C46": "linux executable", "504B0304": "zip archive", "25504446": "pdf document", "D0CF11E0": "ole document", "526172": "rar archive", "1F8B": "gzip", "425A68": "bzip2"}
HEAD, PRINTABLE_HEAD = 100_000, 10_000
#: Share of bytes that may be unprintable, by kind.
UNPRINTABLE = {"sdf": 0.05, "csv": 0.01}


def inspected(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path, signature of another kind (or null), findings joined by commas, unprintable share, valid. Empty files give no row."""
    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, HEAD).alias("head"))
    start = F.hex(F.substring("head", 1, 8))
    signature = F.lit(None).cast("string")
    for code, name in SIGNATURES.items():
        signature = F.when(start.startswith(code), name).otherwise(signature)
    text = F.lower(F.decode("head", "ISO-8859-1"))
    found = F.array_sort(F.filter(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in SUSPICIOUS.items())), lambda x: x.isNotNull()))
    first = F.decode(F.substring("head", 1, PRINTABLE_HEAD), "ISO-8859-1")
    share = F.coalesce(F.try_divide(F.length(F.regexp_replace(first, r"[^\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")).cast("double"), F.length(first)), F.lit(0.0))
    rows = files.select("path", signature.alias("signature"), F.array_join(found, ",").alias("findings"), share.alias("unprintable"), (F.length(first) > 0).alias("filled"))
    return rows.withColumn("valid", F.col("signature").isNull() & (F.col("findings") == "") & (F.col("unprintable") <= UNPRINTABLE[kind]) & F.col("filled")).drop("filled")
