"""Repeated passages by a run-length Burrows-Wheeler index.

A text's windows of LENGTH bytes are keyed by content: the window's least GRAM-byte gram (by hash, leftmost of equals) is
its anchor, and the windows in a row that share an anchor make a stretch, with the bytes they cover as its context. Equal
windows have equal anchors at equal offsets, so only stretches with a common anchor gram can hold repeats. Equal contexts
(128 bits of hash) are counted first; where an anchor has several different contexts, these are indexed together: their
Burrows-Wheeler transform is cut into runs, and kept of it are text positions sampled at the ends of runs and the common prefixes at those
ends. Matching statistics then stream through the contexts from the samples, as between samples they fall by one a byte
(towards the neighbour above from heads of runs, below from tails), and starts that match LENGTH bytes elsewhere are marked.
Anchors with more than MOST contexts (a passage in thousands of surroundings) are cut into
narrower stretches, whose common bytes are a longer key, down to single windows: no group is large, and none is dropped.

Texts are UTF-8 bytes; null and empty ones have nothing to remove; a very long text is many stretches, dealt by anchor;
matches never cross documents; repeated rows match each other; ties between anchors go to the leftmost; null ids are kept;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import dealt_join, documents, drop_staged, mix, prefix_hash, span_hash, staged, string_buffers, text_only

LENGTH, GRAM = 400, 64
#: Different contexts of an anchor that are indexed together; beyond it stretches are cut to these widths.
MOST, WIDTHS = 128, (32, 1)
#: Contexts that a worker takes out of a batch at a time.
AT_ONCE = 256
#: Bytes of contexts in an index, about.
INDEX_BYTES = 1 << 20
STRETCH = "row long, core long, ctx long, sig long, first int, last int, at int"
BODY = "row long, core long, ctx long, sig long, n long, first int, last int, at int, body binary"
#: Ranges of repeated window starts.
MARK = "row long, first int, last int"
KEY = ["core", "ctx", "sig"]
_C1 = np.uint64(0xD6E8FEB86659FD93)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of `width` values, from minima within blocks of that width in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def identity(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of hash (two columns) of the bytes of some ranges."""
    body = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(body[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)), np.uint64).reshape(-1, 2)


def stretches(data: np.ndarray, length: int, gram: int):
    """Core (hash of the anchor), identity of the context, first and last window start, and anchor of a text's stretches."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), np.zeros((0, 2), np.uint64), none, none, none
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    lowest = least((grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), length - gram + 1)
    anchor = (lowest & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut - 1, n - length)
    anchor = anchor[first]
    return grams[anchor], identity(data, first, last + length), first, last, anchor


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def anchored(length: int, gram: int):
    def made(batches):
        for batch in batches:
            raw, off = string_buffers(batch.column("text"))
            rows = batch.column("row").to_numpy()
            for i in range(0, len(rows), 256):
                got = [stretches(raw[off[j] : off[j + 1]], length, gram) for j in range(i, min(i + 256, len(rows)))]
                core, ctx, first, last, anchor = (np.concatenate(x) for x in zip(*got, strict=True))
                row = np.repeat(rows[i : i + 256], [len(g[0]) for g in got])
                yield pa.RecordBatch.from_arrays([pa.array(row), _signed(core), _signed(ctx[:, 0]), _signed(ctx[:, 1]), *(pa.array(x, pa.int32()) for x in (first, last, anchor - first))], ["row", *KEY, "first", "last", "at"])

    return made


def fetcher(length: int):
    """Contexts' bytes, from a text and the stretches wanted of it."""

    def fetched(batches):
        for batch in batches:
            raw, off = string_buffers(batch.column("text"))
            for i, (row, wants) in enumerate(zip(batch.column("row").to_pylist(), batch.column("want"), strict=True)):
                text = raw[off[i] : off[i + 1]]
                for j in range(0, len(wants), AT_ONCE):
                    want = wants.values.slice(j, AT_ONCE).to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(want), pa.int64()), *(pa.array([w[c] for w in want], t) for c, t in (*((k, pa.int64()) for k in KEY), ("n", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("at", pa.int32()))), pa.array([text[w["first"] : w["last"] + length].tobytes() for w in want], pa.binary())],
                        ["row", *KEY, "n", "first", "last", "at", "body"],
                    )

    return fetched


def narrowed(length: int, gram: int, width: int):
    """Contexts cut at multiples of `width` from the anchor's last window; the key is what all of a cell's windows cover.
    A context is many cells with a body each, so few are cut at a time; single windows need no body, their key tells all."""

    def cut(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                out = {c: [] for c in ("row", *KEY, "n", "first", "last", "at", "body")}
                for r in batch.slice(i, AT_ONCE).to_pylist():
                    body = np.frombuffer(r["body"], np.uint8)
                    prefix = prefix_hash(body)
                    starts = np.arange(r["last"] - r["first"] + 1)
                    cell = (starts - r["at"] + length - gram) // width
                    edge = np.flatnonzero(cell[1:] != cell[:-1]) + 1
                    first, last = np.append(0, edge), np.append(edge - 1, len(starts) - 1)
                    low = cell[first] * width - (length - gram)
                    high = np.minimum(low + width - 1, 0)
                    core = mix(span_hash(prefix, r["at"] + high, r["at"] + low + length) + cell[first].astype(np.uint64) * _C1)
                    ctx = identity(body, first, last + length)
                    for a, b, x, (y, z) in zip(first.tolist(), last.tolist(), core.view(np.int64).tolist(), ctx.view(np.int64).tolist(), strict=True):
                        kept = r["body"][a : b + length] if width > 1 else None
                        for c, v in zip(out, (r["row"], x, y, z, r["n"], r["first"] + a, r["first"] + b, r["at"] - a, kept), strict=True):
                            out[c].append(v)
                types = (*[pa.int64()] * 5, *[pa.int32()] * 3, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    return cut


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of some texts with positions and common prefixes at the ends of runs."""

    def __init__(self, bodies: list[bytes]):
        m = len(bodies)
        size = np.array([len(b) + 1 for b in bodies])
        self.end = np.cumsum(size)
        data = np.zeros(int(self.end[-1]), np.int64)
        inside = np.ones(len(data), bool)
        inside[self.end - 1] = False
        data[inside] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64) + m
        data[self.end - 1] = np.arange(m)  # each text ends in a symbol of its own
        n = self.n = len(data)
        bits = int(m + 256).bit_length()
        take = 4 if 4 * bits < 63 else 2
        key = np.zeros(n, np.int64)
        for j in range(take):
            key <<= bits
            key[: n - j] |= data[j:]
        levels, width = [], take
        while True:
            order = np.argsort(key)
            ranked = key[order]
            new = np.append(True, ranked[1:] != ranked[:-1])
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(new) - 1
            levels.append((width, rank))
            if new.all():
                break
            key = rank.astype(np.int64) * (n + 1)
            key[: n - width] += rank[width:] + 1
            width *= 2
        before = data[order - 1]  # the transform, in the order of suffixes
        heads = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.runs = len(heads)
        above, below = order[heads[1:] - 1], order[heads[1:]]
        common = self._common(levels, data, above, below)
        # a sample for each end of a run: (position, common prefix with the neighbour beyond the end)
        self.up = self._samples(np.append(order[0], below), np.append(0, common))
        self.down = self._samples(np.append(above, order[-1]), np.append(common, 0))

    @staticmethod
    def _common(levels, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes, by the ranks of ever shorter prefixes and then symbol by symbol."""
        out = np.zeros(len(a), np.int64)
        for width, rank in reversed(levels):
            last = len(rank) - 1
            same = (a + out <= last) & (b + out <= last)
            same[same] = rank[(a + out)[same]] == rank[(b + out)[same]]
            out[same] += width
        same = np.ones(len(a), bool)
        for _ in range(levels[0][0] - 1):
            same &= data[a + out] == data[b + out]
            out += same
        return out

    @staticmethod
    def _samples(at: np.ndarray, value: np.ndarray):
        order = np.argsort(at)
        return at[order], value[order]

    def statistics(self) -> np.ndarray:
        """Longest match elsewhere of the text from each position on."""
        where = np.arange(self.n)
        out = np.zeros(self.n, np.int64)
        for at, value in (self.up, self.down):
            i = np.searchsorted(at, where, "right") - 1
            got = np.where(i >= 0, value[i] - (where - at[i]), 0)
            out = np.maximum(out, got)
        return out


def repeats(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """Starts in each body of strings of `length` that start in another place of the bodies too."""
    index = RunIndex(bodies)
    hit = np.flatnonzero(index.statistics() >= length)
    owner = np.searchsorted(index.end, hit, "right")
    return [hit[owner == i] - b for i, b in enumerate(np.append(0, index.end[:-1]))]


def indexed(length: int):
    def marked(table: pa.Table) -> pa.Table:
        rows = table.select(["row", "n", "first", "body"]).to_pylist()
        out = []
        for r, starts in zip(rows, repeats([r["body"] for r in rows], length), strict=True):
            if r["n"] == 1 and len(starts):
                edge = np.flatnonzero(np.diff(starts) != 1) + 1
                out += [(r["row"], r["first"] + int(part[0]), r["first"] + int(part[-1])) for part in np.split(starts, edge)]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({"row": pa.array(cols[0], pa.int64()), **{n: pa.array(c, pa.int32()) for n, c in zip(("first", "last"), cols[1:], strict=True)}})

    return marked


def from_index(contexts: DataFrame, length: int) -> DataFrame:
    total = contexts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    tasks = max(64, int(total) // INDEX_BYTES)
    return contexts.withColumn("task", F.pmod(F.xxhash64("core"), F.lit(tasks))).groupBy("task").applyInArrow(indexed(length), MARK)


def marks(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, first, last): ranges of window starts of texts (row, text) that are repeated."""
    all_ = staged(texts.mapInArrow(anchored(length, gram), STRETCH), "stretches")
    counted = all_.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last", "at")).alias("one"))
    groups = counted.groupBy("core").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("total > 1").select("core", "m")
    contexts = staged(counted.join(groups, "core").select(*KEY, "n", "m", "one.*"), "contexts")
    ranges = lambda df: df.select("row", "first", "last")
    # a context may hold any share of all stretches
    out = [ranges(dealt_join(all_, contexts.where("n > 1").select(*KEY), KEY, "inner"))]
    wanted = contexts.where("m > 1").groupBy("row").agg(F.collect_list(F.struct(*KEY, "n", "first", "last", "at")).alias("want"))
    bodies = texts.join(wanted, "row").mapInArrow(fetcher(length), BODY)
    bodies = staged(dealt_join(bodies, contexts.where("m > 1").select("core", "m").distinct(), ["core"], "inner"), "bodies")
    out.append(from_index(bodies.where(F.col("m") <= MOST), length))
    hot = bodies.where(F.col("m") > MOST)
    used = [all_, contexts, bodies]
    for width in WIDTHS:
        if hot.isEmpty():
            break
        cut = staged(hot.mapInArrow(narrowed(length, gram, width), BODY), "narrowed")
        counted = cut.groupBy(*KEY).agg(F.sum("n").alias("all"))
        if width == 1:  # equal windows have equal keys, and there is nothing in them to index
            used.append(cut)
            out.append(ranges(dealt_join(cut.where("n = 1").drop("body"), counted.where("all > 1").select(*KEY), KEY, "inner")))
            break
        groups = counted.groupBy("core").agg(F.count("*").alias("m"), F.sum("all").alias("total")).where("total > 1").select("core", "m")
        known = staged(counted.join(groups, "core"), "narrow-groups")
        pieces, cut = cut, staged(dealt_join(cut, known, KEY, "inner"), "narrow-contexts")
        drop_staged(pieces)
        used += [known, cut]
        out.append(ranges(cut.where("n = 1 and all > 1")))
        rest = cut.where("m > 1").drop("n").withColumnRenamed("all", "n").dropDuplicates(KEY)
        out.append(from_index(rest.where(F.col("m") <= MOST), length))
        hot = rest.where(F.col("m") > MOST).select("row", *KEY, "n", "first", "last", "at", "body", "m")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    found = staged(found, "marks")
    drop_staged(*used)
    return found


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cutter(length: int, keep: bool):
    def cut(batches):
        for batch in batches:
            raw, off = string_buffers(batch.column("text"))
            rows = []
            for i, (doc, ranges) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("ranges"), strict=True)):
                text = raw[off[i] : off[i + 1]]
                edge = np.zeros(len(text) + 1, np.int64)
                for r in ranges.as_py() or ():
                    edge[r["first"]] += 1
                    edge[r["last"] + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
                left = text[~gone].tobytes()
                rows.append((doc, len(text), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left if keep else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.string(), pa.binary()), strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return cut


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: bool = True) -> DataFrame:
    """Each row's bytes, removed bytes and runs, and what is left (its SHA-256; the bytes if keep)."""
    texts = staged(text_only(docs).withColumn("row", F.monotonically_increasing_id()), "texts")  # written, so ids stay
    found = marks(texts.select("row", "text"), length, gram)
    ranges = found.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    out = texts.join(ranges, "row", "left").select("doc_id", "text", "ranges").mapInArrow(cutter(length, keep), RESULT)
    if keep:
        return out
    out = staged(out.drop("kept"), "repeats")
    drop_staged(texts, found)
    return out


def op4_run_length_index(spark, sf_dir):
    return without_repeats(documents(spark, sf_dir), keep=False)


OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, i, md5(array_slice(b, i, i + {LENGTH - 1})) AS h FROM (SELECT rid, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS i FROM d WHERE octet_length(b) >= {LENGTH})),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
k AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM k),
runs AS (SELECT rid, run, min(i) AS a, max(i) + {LENGTH - 1} AS z FROM g GROUP BY rid, run),
gaps AS (SELECT rid, run, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY run), 0) + 1 AS since FROM runs),
left_over AS (SELECT rid, run, CASE WHEN since < a THEN hex(array_slice(b, since, a - 1)) ELSE '' END AS x FROM gaps JOIN d USING (rid)
  UNION ALL SELECT rid, max(run) + 1, CASE WHEN max(z) < any_value(octet_length(b)) THEN hex(array_slice(any_value(b), max(z) + 1, any_value(octet_length(b)))) ELSE '' END FROM runs JOIN d USING (rid) GROUP BY rid),
kept AS (SELECT rid, sha256(from_hex(string_agg(x, '' ORDER BY run))) AS sha FROM left_over GROUP BY rid),
sums AS (SELECT rid, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(sha, sha256(b)) AS kept_sha256
FROM d LEFT JOIN sums USING (rid) LEFT JOIN kept USING (rid)
"""
