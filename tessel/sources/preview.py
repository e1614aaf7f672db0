"""What a reader is shown of a delimited file before it is read: columns, samples, suggestions, and how many rows it has.

The number of rows of a large file comes from byte ranges spread evenly over it; what is read does not grow with the file.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

from pyspark.sql import DataFrame, SparkSession

from tessel.sources import delimited

EXACT_BELOW = 1 << 20  # files up to this size are counted
RANGES, RANGE_BYTES = 32, 1 << 15
SAMPLE_ROWS, SAMPLE_COLUMNS, SAMPLE_LENGTH, NAME_LENGTH = 5, 20, 100, 256
# Words by which a structure or a name column is suggested.
STRUCTURE_WORDS = ("smiles", "smi", "canonical_smiles", "isomeric_smiles", "structure")
NAME_WORDS = ("name", "id", "compound", "molecule", "title", "identifier")
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".xz", ".deflate")


@dataclass(frozen=True)
class Estimate:
    """rows with the bounds of a 95 % interval; exact: counted."""

    rows: int
    low: int
    high: int
    exact: bool
    bytes_read: int
    bytes: int


def _files(spark: SparkSession, path: str):
    """The file system and (path, size) of a file, or of a folder's files but hidden ones, in order of name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(f.getPath(), f.getLen()) for f in fs.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    return fs, sorted(found, key=lambda f: f[0].toString())


def _bytes(spark: SparkSession, fs, path, start: int, length: int) -> bytes:
    stream = fs.open(path)
    try:
        stream.seek(start)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def line_ends(data: bytes) -> int:
    """Ends of lines, be they LF, CRLF or CR."""
    return max(data.count(b"\n"), data.count(b"\r"))


def estimated_rows(spark: SparkSession, path: str, header: bool, exact_below: int = EXACT_BELOW, ranges: int = RANGES, range_bytes: int = RANGE_BYTES) -> Estimate:
    """Rows of a delimited file or a folder of such files, each with a header or none.

    Lines are physical ones. Up to exact_below bytes the files are read and counted. Above, range i of `ranges` starts in the
    middle of the i-th equal part of all bytes, and its lines a byte stand for that part; the interval comes from how far
    ranges differ. Compressed files have no ranges: Spark counts their lines. No rows give 0.
    """
    fs, files = _files(spark, path)
    total = sum(n for _, n in files)
    heads = sum(1 for _, n in files if n) if header else 0
    if any(p.getName().endswith(COMPRESSED) for p, _ in files):
        rows = max(0, spark.read.text(path).count() - heads)
        return Estimate(rows, rows, rows, True, total, total)
    if total <= max(exact_below, ranges * range_bytes):
        lines = 0
        for p, n in files:
            data = _bytes(spark, fs, p, 0, n)
            lines += line_ends(data) + (1 if data and not data.endswith((b"\n", b"\r")) else 0)
        rows = max(0, lines - heads)
        return Estimate(rows, rows, rows, True, total, total)
    rates, read = [], 0
    for i in range(ranges):
        at = (2 * i + 1) * total // (2 * ranges) - range_bytes // 2
        ends, size = 0, 0
        for p, n in files:  # a range may go on in the next files
            if at < n and size < range_bytes:
                piece = _bytes(spark, fs, p, max(at, 0), min(n - max(at, 0), range_bytes - size))
                ends, size = ends + line_ends(piece), size + len(piece)
            at -= n
        read += size
        rates.append(ends / size)
    mean = sum(rates) / ranges
    spread = 1.96 * sqrt(sum((r - mean) ** 2 for r in rates) / (ranges - 1) / ranges)
    at_least = max(1, round(total * max(0.0, mean - spread)) - heads)
    return Estimate(max(1, round(total * mean) - heads), at_least, max(1, round(total * (mean + spread)) - heads), False, read, total)


def _suggested(names: list[str], words: tuple[str, ...]) -> str | None:
    return next((n for n in names if any(w in n.lower() for w in words)), None)


def _valid(name: str) -> bool:
    return 1 <= len(name) <= NAME_LENGTH and not set(name) & set("<>\"'\\/;`")


def columns(spark: SparkSession, path: str) -> DataFrame:
    """position, column, sample (the first value that is not blank of the first five rows, of the first twenty columns, at
    most a hundred characters) and role: `structure` or `name` where a column is suggested as such. Of a folder, the files
    come in order of name.

    Columns whose names no export takes are left out; a file without any other, or without lines, is an error.
    """
    layout = delimited.sniff(spark, path)
    unique = delimited._distinct(layout.columns)
    schema = ", ".join(f"`{n.replace('`', '')}` string" for n in unique)
    rows = delimited.first_rows(spark, path, SAMPLE_ROWS, lambda f: spark.read.csv(f, sep=layout.delimiter, header=layout.header, schema=schema))
    kept = [(i, n) for i, n in enumerate(unique) if _valid(n)]
    if not kept:
        raise ValueError("no column has a valid name")
    names = [n for _, n in kept]
    if layout.header:
        structure = _suggested(names, STRUCTURE_WORDS)
        name = _suggested([n for n in names if n != structure], NAME_WORDS)
    else:
        structure, name = "SMILES", None
    role = {name: "name", structure: "structure"}
    sampled = {n for n in names[:SAMPLE_COLUMNS]}
    sample = lambda i, n: next((r[i].strip()[:SAMPLE_LENGTH] for r in rows if r[i] and r[i].strip()), None) if n in sampled else None
    return spark.createDataFrame([(i, n, sample(i, n), role.get(n)) for i, n in kept], "position int, column string, sample string, role string")
