"""Quality rules by cross-document line frequency.

One pass in Arrow batches counts a text's words, symbols, repeated lines and repeated 8-word windows, and hashes its
normalised lines, once each. Lines are then counted per host over documents, with partial counts before the shuffle; lines
above the host's limit are removed (`without_frequent_lines` returns the texts), and a document that loses most of its
characters so is rejected.

A null or empty text has no words and fails the base rule; a very long text is one list of hashed lines; a null host counts
as a host of its own; copies of a document and repeated rows are documents each, in a line's frequency and in the result;
a line exactly at the limit stays; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import dealt_join, documents, shingles, small_enough, staged, string_buffers, text_only, words

#: A line is boilerplate above so many documents of a host, or above this share of them, whichever is more.
LINE_DOCS, LINE_SHARE = 50, 0.02
#: A document is depleted with a smaller share of its line characters left.
LEFT = 0.3
#: Frequent lines that a broadcast may hold (16 bytes each); beyond it the join is shuffled.
BROADCAST_LINES = 500_000
SCHEMA = "doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_chars long, lines array<struct<line:long,chars:int>>"
_WHITE = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"


def repeat_words(ids: np.ndarray, size: int = 8) -> int:
    """Words in size-word windows that occur twice or more in the text, the first included."""
    n = len(ids)
    if n <= size:
        return 0
    window = shingles(ids, size)
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def normalised(line: str) -> str:
    """Lower case, runs of ASCII white space as one blank, ASCII digits as 0."""
    return re.sub("[0-9]", "0", re.sub(f"[{_WHITE}]+", " ", line.lower()).strip(" "))


def measured(batches):
    for batch in batches:
        out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "lines", "text_key")}
        column = batch.column("text")
        raw, off = string_buffers(column)
        for i, text in enumerate(column.to_pylist()):
            _, _, ids, _ = words(raw, off[i : i + 2], False)
            out["n_words"].append(len(ids))
            out["word_chars"].append(len(text) - sum(map(text.count, _WHITE)))
            out["n_symbols"].append(sum(map(text.count, _SYMBOLS)))
            out["n_repeat_words"].append(repeat_words(ids))
            out["text_key"].append(xxhash.xxh3_64_intdigest(text) - (1 << 63))
            seen, dup, chars, lines = set(), 0, 0, {}
            for line in text.split("\n"):
                if line.strip(_WHITE):
                    dup += line in seen
                    seen.add(line)
                    line = normalised(line)
                    chars += len(line)
                    lines[line] = lines.get(line, 0) + len(line)
            out["n_dup_lines"].append(dup)
            out["line_chars"].append(chars)
            out["lines"].append([{"line": xxhash.xxh3_64_intdigest(k) - (1 << 63), "chars": v} for k, v in lines.items()])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host"), *(pa.array(out[k], pa.int64()) for k in ("text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars")), pa.array(out["lines"], pa.list_(pa.struct([("line", pa.int64()), ("chars", pa.int32())])))],
            ["doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "lines"],
        )


def _host(docs: DataFrame) -> Column:
    return (F.coalesce(F.col("source").cast("string"), F.lit("\0none")) if "source" in docs.columns else F.lit("\0none")).alias("host")


def _counted(docs: DataFrame) -> DataFrame:
    """Measures and hashed lines of each row, its number, and the document that it is (rows without an id are one each)."""
    rows = text_only(docs, _host(docs)).mapInArrow(measured, SCHEMA).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("doc", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row"))))
    return staged(rows, "line-rules")


def _found(rows: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """Frequent lines of each row: host, line, row, chars."""
    counts = rows.select("host", "doc", F.explode("lines").alias("x")).groupBy("host", F.col("x.line").alias("line")).agg(F.count_distinct("doc").alias("docs"))
    hosts = rows.groupBy("host").agg(F.count_distinct("doc").alias("host_docs"))
    often = counts.where(F.col("docs") > line_docs)
    frequent = often.join(hosts, "host").where(F.col("docs") > line_share * F.col("host_docs")).select("host", "line")
    frequent = staged(frequent, "frequent-lines")
    each = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", F.col("x.line").alias("line"), F.col("x.chars").alias("chars"))
    if small_enough(frequent, BROADCAST_LINES):
        return each.join(F.broadcast(frequent), ["host", "line"])
    return dealt_join(each, frequent, ["host", "line"], "inner")


def _verdict(left: float) -> tuple[Column, Column, Column]:
    """base_failed, kept and frequent_chars of rows joined with the sum of their frequent lines' characters (gone)."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    gone_chars = F.coalesce("gone", F.lit(0)).cast("long")
    return failed.alias("base_failed"), (~failed & (F.col("line_chars") - gone_chars >= left * F.col("line_chars"))).alias("kept"), gone_chars.alias("frequent_chars")


def quality_rules(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left: float = LEFT) -> DataFrame:
    """One row per document: base counts, base_failed, characters in frequent lines, kept."""
    rows = _counted(docs)
    gone = _found(rows, line_docs, line_share).groupBy("row").agg(F.sum("chars").alias("gone"))
    return rows.drop("lines").join(gone, "row", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *_verdict(left), "line_chars")


def keyed(batches):
    for batch in batches:
        key = pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in batch.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "text")), key], ["doc_id", "host", "text", "text_key"])


def cut(batches):
    """Texts without those of their lines whose normalised hash is in `lines`; other lines stay as they are."""
    for batch in batches:
        texts = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True):
            if gone:
                gone = set(gone)
                text = "\n".join(x for x in text.split("\n") if not x.strip(_WHITE) or xxhash.xxh3_64_intdigest(normalised(x)) - (1 << 63) not in gone)
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("kept")], ["doc_id", "text", "kept"])


def without_frequent_lines(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left: float = LEFT) -> DataFrame:
    """One row per document: its text without its host's frequent lines (null: empty), and kept as in quality_rules.

    What goes is decided by host and text, so copies on a host are cut alike; texts are joined by the same two.
    """
    rows = _counted(docs)
    gone = _found(rows, line_docs, line_share).groupBy("row").agg(F.sum("chars").alias("gone"), F.collect_list("line").alias("gone_lines"))  # lines of one document
    of = rows.drop("lines").join(gone, "row", "left").select("host", "text_key", _verdict(left)[1], F.col("gone_lines").alias("lines")).dropDuplicates(["host", "text_key"])
    texts = text_only(docs, _host(docs)).mapInArrow(keyed, "doc_id long, host string, text string, text_key long")
    return texts.join(of, ["host", "text_key"], "left").select("doc_id", "text", "lines", "kept").mapInArrow(cut, "doc_id long, text string, kept boolean")


def op6_line_frequency(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir))


_SPACE = "[ \\t\\n\\x0B\\f\\r]"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, chr(0) || 'none') AS host FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS p, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS gram FROM w WHERE len(ws) >= 8),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM twice WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
full_lines AS (SELECT doc_id, host, line, regexp_replace(trim(regexp_replace(lower(line), '{_SPACE}+', ' ', 'g')), '[0-9]', '0', 'g') AS plain FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(plain)) AS line_chars FROM full_lines GROUP BY doc_id),
hosts AS (SELECT host, count(*) AS host_docs FROM d GROUP BY host),
frequent AS (SELECT f.host, f.plain FROM full_lines f JOIN hosts h ON f.host = h.host GROUP BY f.host, f.plain, h.host_docs HAVING count(DISTINCT f.doc_id) > {LINE_DOCS} AND count(DISTINCT f.doc_id) > {LINE_SHARE} * h.host_docs),
gone AS (SELECT f.doc_id, sum(length(f.plain)) AS frequent_chars FROM full_lines f JOIN frequent q ON f.host = q.host AND f.plain = q.plain GROUP BY f.doc_id),
base AS (SELECT d.doc_id, len(w.ws) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(frequent_chars, 0)::BIGINT AS frequent_chars, coalesce(line_chars, 0)::BIGINT AS line_chars
  FROM d JOIN w USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND line_chars - frequent_chars >= {LEFT} * line_chars AS kept FROM base
"""
