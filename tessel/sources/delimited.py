"""Delimited text: sniffing on the first lines, header detection, reading with format errors as rows, pre-validation.

Only the first lines come to the driver; the rest is read as a DataFrame with the columns that are needed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.sources.staging import staged

MAX_COLUMNS, PREVIEW = 1000, 5
# Column names that hold structures and names, in order of preference, and words that only headers have.
STRUCTURE_NAMES = ("smiles", "canonical_smiles", "structure", "mol", "molecule", "smi", "input_smiles")
NAME_NAMES = ("name", "id", "compound_name", "compound_id", "molecule_name", "mol_name", "title", "compound", "identifier", "chembl_id", "cas")
HEADER_WORDS = frozenset(("activity", *STRUCTURE_NAMES, *NAME_NAMES))


@dataclass(frozen=True)
class Layout:
    delimiter: str
    header: bool
    columns: tuple[str, ...]


def looks_like_structure(cell: str) -> bool:
    """Whether a cell could be a structure: only its characters, an atom letter, and no header word."""
    cell = cell.strip()
    allowed = set("ABCFHIKLMNOPRSTUVXYZabcdefghiklmnoprstuy0123456789()[]=#@+-/\\.%:*")
    return bool(cell) and cell.lower() not in HEADER_WORDS and set(cell) <= allowed and any(ch in "BCNOPSFIbcnops" for ch in cell)


def first_rows(spark: SparkSession, path: str, most: int, read: Callable[[str], DataFrame]) -> list[Row]:
    """The first rows of a file, or of a folder's files in order of name; files after them are not read.

    Spark itself starts with the largest file of a folder.
    """
    found: list[Row] = []
    for f in sorted(map(unquote, spark.read.text(path).inputFiles())):
        found += read(re.sub(r"([\\\[\]{}*?])", r"\\\1", f)).limit(most - len(found)).collect()
        if len(found) == most:
            break
    return found


def sniff(spark: SparkSession, path: str) -> Layout:
    """Delimiter, header and columns from the first two lines that are not blank. Tab if a line has as many as commas."""
    first = [r[0] for r in first_rows(spark, path, 2, lambda f: spark.read.text(f).where("trim(value) <> ''"))]
    if not first:
        raise ValueError("the file is empty")
    delimiter = "\t" if first[0].count("\t") and first[0].count("\t") >= first[0].count(",") else ","
    cells = [x.split(delimiter) for x in first]
    header = not all(looks_like_structure(x[0]) for x in cells)
    names = tuple(n.strip().strip('"') for n in cells[0]) if header else ("SMILES", *(f"col_{i}" for i in range(1, len(cells[0]))))
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    return Layout(delimiter, header, names)


def matching(columns: tuple[str, ...], wanted: str | None, candidates: tuple[str, ...]) -> str | None:
    """A column by its name whatever the case, else the first candidate that is there, else one that holds a candidate."""
    low = {n.lower(): n for n in reversed(columns)}
    if wanted is not None and wanted.lower() in low:
        return low[wanted.lower()]
    exact = next((low[n] for n in candidates if n in low), None)
    return exact or next((n for n in columns if candidates[0] in n.lower()), None)


def format_error(text: Column) -> Column:
    """Why a cell cannot be a structure; null if it can."""
    return F.when(text.isNull() | (F.trim(text) == ""), "empty").when(F.length(text) > 5000, "too long").when(text.rlike("[<>\"';`]"), "invalid characters")


def read(spark: SparkSession, path: str, structure: str | None = "SMILES", name: str | None = None, properties: bool = False) -> DataFrame:
    """smiles, name, index, parse_error (and properties as a map of all other columns). Bad rows stay, with an error.

    The index follows the file's order; it comes from each partition's place and the rows before it, without a global sort.
    """
    layout = sniff(spark, path)
    schema = ", ".join(f"`{n.replace('`', '')}` string" for n in _distinct(layout.columns))
    rows = spark.read.csv(path, sep=layout.delimiter, header=layout.header, schema=schema)
    chosen = matching(tuple(rows.columns), structure, STRUCTURE_NAMES)
    if chosen is None:
        raise ValueError("no structure column")
    label = matching(tuple(rows.columns), name, NAME_NAMES)
    rows = numbered(rows)
    text = F.coalesce(F.trim(F.col(f"`{chosen}`")), F.lit(""))
    named = F.coalesce(F.col(f"`{label}`"), F.concat(F.lit("row_"), F.col("index").cast("string"))) if label and label != chosen else F.concat(F.lit("row_"), F.col("index").cast("string"))
    error = format_error(text)
    rest = [n for n in rows.columns if n not in (chosen, "index", "_part", "_at")]
    more = [F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*(F.col(f"`{n}`") for n in rest))).alias("properties")] if properties and rest else []
    return rows.select(F.when(error.isNull(), text).otherwise("").alias("smiles"), named.alias("name"), "index", error.alias("parse_error"), *more)


def _distinct(names: tuple[str, ...]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = n or f"_c{i}"
        seen[n.lower()] = seen.get(n.lower(), 0) + 1
        out.append(n if seen[n.lower()] == 1 else f"{n}_{seen[n.lower()]}")
    return out


def numbered(df: DataFrame) -> DataFrame:
    """df with index: 0-based, in the order of files and lines.

    The rows are written with their places within partitions, so that they are split once; sizes of partitions (a row each)
    are summed in a small table and joined.
    """
    marked = staged(df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "numbered-lines")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = marked.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(before), "_part").withColumn("index", F.col("_before") + own).drop("_before")


def prevalidated(spark: SparkSession, path: str) -> DataFrame:
    """Issues of a delimited file: (issue, detail): duplicate headers, no structure column, empty structure cells."""
    layout = sniff(spark, path)
    issues, seen = [], {}
    for i, n in enumerate(layout.columns if layout.header else ()):
        seen.setdefault(n.lower(), []).append(str(i))
    issues += [("duplicate_header", f"{n}: {','.join(at)}") for n, at in seen.items() if len(at) > 1]
    chosen = matching(layout.columns, "SMILES", STRUCTURE_NAMES)
    if chosen is None:
        issues.append(("missing_structure_column", ",".join(layout.columns)))
    else:
        empty = read(spark, path).where("parse_error = 'empty'").count()
        if empty:
            issues.append(("empty_rows", str(empty)))
    return spark.createDataFrame(issues, "issue string, detail string")


def numeric_columns(rows: DataFrame, names: list[str], sample: int = 100) -> list[str]:
    """Names whose first non-empty values mostly (over 0.8) read as numbers; activity-like names first."""
    head = rows.limit(sample)
    share = head.agg(*(F.avg(F.when(F.trim(F.col(f"`{n}`")) != "", F.col(f"`{n}`").try_cast("double").isNotNull().cast("int"))).alias(n) for n in names)).first()
    rank = lambda n: 1 if n.lower() in ("activity", "pic50", "ic50", "ki", "value") else 2 if "activity" in n.lower() or "ic50" in n.lower() else 3
    return sorted((n for n in names if (share[n] or 0) > 0.8), key=lambda n: (rank(n), n))
