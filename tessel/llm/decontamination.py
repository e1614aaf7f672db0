"""Benchmark decontamination with CGK embeddings and bit-sampling LSH.

A document leaks an item when some run of its words is within `percent` of the item's words in edit distance over words
(insert, delete, substitute; A-Z folded). An item of L words with d edits allowed is cut into d + 1 pieces, one of which
stays whole; where a piece's first words occur in a document, item-sized windows at every start within d of the place they
imply are taken. That loses nothing, and hashing only these is what makes all starts of all lengths affordable. Each window
and the item go through the same random walks (CGK): a walk writes the word it stands on and steps on or stays by a random
bit of word and time, so that few edits change few positions. SAMPLED positions of a walk, all before it leaves the
window, are a key (bit sampling); windows that share a key with the item are verified by an exact edit distance, free of
the window's ends. As many walks are drawn as reach the target recall on TRIALS items edited to the limit; if MOST_WALKS do
not reach it, all windows are verified.

The items are broadcast ITEM_BLOCK at a time, which bounds what is sent and held whatever their number; a block is a scan.
Null and empty documents leak nothing; a very long text is read in one piece, its places SOME at a time; null and empty
items are skipped; repeated documents each get their rows, null ids are kept; of equally near runs the first and shortest
is reported; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import blocks, documents, mix, shingles, string_buffers, text_only, words

PERCENT, SEED_WORDS, SAMPLED, RECALL, MOST_WALKS = 20, 4, 2, 0.999, 64
#: Edited items that the number of walks is measured on, and items in a broadcast.
TRIALS, ITEM_BLOCK = 4000, 20_000
#: Places that are hashed and verified at a time.
SOME = 200_000
#: Samples are taken in this share of twice a window's words: a walk leaves the window at about all of it.
SPAN = 0.75
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, distance long, item_words long"
_FILTER = 1 << 20


def allowed(n: int, percent: int = PERCENT) -> int:
    return n * percent // 100


def pieces(n: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Start and length of an item's pieces, one more than the edits allowed."""
    edges = [n * i // (allowed(n, percent) + 1) for i in range(allowed(n, percent) + 2)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def walks(text: np.ndarray, start: np.ndarray, stop: np.ndarray, steps: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Keys (windows, walks) of windows text[start:stop]: the words at the sampled times; 0 where a walk had left before.

    steps: walk lengths of the windows; times: (walks, SAMPLED) as fractions of a walk.
    """
    n, at = len(start), np.zeros((len(start), len(times)), np.int64)
    key, left = np.zeros(at.shape, np.uint64), np.zeros(at.shape, bool)
    want = (steps[:, None, None] * times[None]).astype(np.int64)
    seed = mix(np.arange(1, len(times) + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
    for t in range(int(want.max()) + 1 if n else 0):
        place = start[:, None] + at
        inside = place < stop[:, None]
        word = np.where(inside, text[np.minimum(place, len(text) - 1)], np.uint64(0))
        hit = want == t
        for s in range(times.shape[1]):
            key = np.where(hit[:, :, s], mix(key + word + np.uint64(s + 1)), key)
            left |= hit[:, :, s] & ~inside
        at += (mix(word ^ (seed + np.uint64(t))) & np.uint64(1)).astype(np.int64)
    return np.where(left, np.uint64(0), key)


def shared_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which walks give both the same key, having left neither."""
    return (a == b) & (a != 0)


def drawn(percent: int) -> np.ndarray:
    """Sampled times of MOST_WALKS walks, as fractions of twice a window's words."""
    return np.random.default_rng(17).random((MOST_WALKS, SAMPLED)) * SPAN


def walks_needed(texts: list[str], percent: int, recall: float, trials: int = TRIALS) -> int | None:
    """Walks with which items edited to the limit share a key as often as `recall` asks; None if MOST_WALKS do not."""
    _, _, word, first = words(*_joined(texts), True)
    items = [word[a:b] for a, b in zip(first[:-1], first[1:], strict=True) if b > a]
    if not items:
        return 1
    rng, times = np.random.default_rng(29), drawn(percent)
    bodies = []
    for i in range(trials):
        w = items[i % len(items)] if len(items) <= trials else items[int(rng.integers(len(items)))]
        other = w.tolist()
        for _ in range(allowed(len(w), percent)):
            kind, at = rng.integers(3), int(rng.integers(max(1, len(other))))
            new = int(rng.integers(1 << 62))
            if kind == 0:
                other.insert(at, new)
            elif kind == 1 and len(other) > 1:
                other.pop(at)
            else:
                other[at] = new
        bodies += [w, np.array(other, np.uint64)]
    stop = np.cumsum([len(x) for x in bodies])
    start, size = stop - [len(x) for x in bodies], np.repeat([len(x) for x in bodies[::2]], 2)
    text, missed = np.concatenate(bodies), np.zeros(len(times))
    for i in range(0, len(bodies), 1000):
        own = slice(i, i + 1000)
        key = walks(text, start[own], np.minimum(stop[own], start[own] + size[own]), 2 * size[own], times)
        missed += (np.cumsum(shared_key(key[::2], key[1::2]), axis=1) == 0).sum(0)
    good = np.flatnonzero(missed <= (1 - recall) * trials)
    return int(good[0]) + 1 if len(good) else None


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    body = [t.encode() for t in texts]
    return np.frombuffer(b"".join(body), np.uint8), np.append(0, np.cumsum([len(b) for b in body])).astype(np.int64)


def edit_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the run of text nearest to the item; the first such, the shortest of those."""
    ramp = np.arange(len(text) + 1)
    row, origin = np.zeros(len(text) + 1, np.int64), ramp.copy()
    for i, word in enumerate(item, 1):
        step = np.empty_like(row)
        from_ = np.empty_like(origin)
        step[0], from_[0] = i, 0
        across, down = row[:-1] + (text != word), row[1:] + 1
        better = down < across
        step[1:], from_[1:] = np.where(better, down, across), np.where(better, origin[1:], origin[:-1])
        low = np.minimum.accumulate(step - ramp)
        source = np.maximum.accumulate(np.where(step - ramp == low, ramp, 0))
        row, origin = low + ramp, from_[source]
    end = int(np.lexsort((ramp, origin, row))[0])
    return int(row[end]), int(origin[end]), end


class Items:
    """Benchmark items ready for scanning: words, seeds by length, walks and keys."""

    def __init__(self, ids: list[int], texts: list[str], percent: int, n_walks: int | None):
        _, _, word, first = words(*_joined(texts), True)
        self.percent = percent
        self.items = [(i, word[a:b]) for i, a, b in zip(ids, first[:-1], first[1:], strict=True) if b > a]
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for n, (_, w) in enumerate(self.items):
            for at, size in pieces(len(w), percent):
                k = min(SEED_WORDS, size)
                seeds.setdefault(k, []).append((int(shingles(w[at : at + k], k)[0]), n, at))
        self.seeds = {}
        for k, found in seeds.items():
            hashed = np.array([x[0] for x in found], np.uint64)
            order = np.argsort(hashed, kind="stable")
            bits = np.zeros(_FILTER, bool)
            bits[(hashed & np.uint64(_FILTER - 1)).astype(np.int64)] = True
            self.seeds[k] = (bits, hashed[order], np.array([x[1] for x in found])[order], np.array([x[2] for x in found])[order])
        self.times = None if n_walks is None else drawn(percent)[:n_walks]
        if n_walks is not None:
            self.keys = [walks(w, np.zeros(1, np.int64), np.array([len(w)]), np.array([2 * len(w)]), self.times)[0] for _, w in self.items]

    def places(self, text: np.ndarray, first: np.ndarray):
        """Distinct (document, item, start) that seeds imply, in words of text, SOME at a time about."""
        for k, (bits, hashed, item, offset) in self.seeds.items():
            if len(text) < k:
                continue
            gram = shingles(text, k)
            at = np.flatnonzero(bits[(gram & np.uint64(_FILTER - 1)).astype(np.int64)])
            low, high = np.searchsorted(hashed, gram[at], "left"), np.searchsorted(hashed, gram[at], "right")
            total = np.cumsum(high - low)
            for group in np.split(np.arange(len(at)), np.searchsorted(total, np.arange(SOME, total[-1] if len(total) else 0, SOME))):
                count = (high - low)[group]
                pos = np.repeat(at[group], count)
                which = np.repeat(low[group], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                doc = np.searchsorted(first, pos, "right") - 1
                whole = pos + k <= first[doc + 1]
                found = np.stack((doc, item[which], pos - offset[which]), 1)[whole]
                if len(found):
                    yield np.unique(found, axis=0)

    def near(self, text: np.ndarray, first: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Which places have a window that shares a key with its item; all of them without walks."""
        hit = np.zeros(len(found), bool)
        if self.times is None:
            return ~hit
        size = np.array([len(w) for _, w in self.items])[found[:, 1]]
        slack = size * self.percent // 100
        shift = [np.arange(-s, s + 1) for s in slack]
        owner = np.repeat(np.arange(len(found)), [len(x) for x in shift])
        start = np.clip(found[owner, 2] + np.concatenate(shift), first[found[owner, 0]], None)
        stop = np.minimum(start + size[owner], first[found[owner, 0] + 1])
        alive = stop > start
        owner, start, stop = owner[alive], start[alive], stop[alive]
        for i in range(0, len(owner), 4000):
            own = owner[i : i + 4000]
            key = walks(text, start[i : i + 4000], stop[i : i + 4000], 2 * size[own], self.times)
            hit[own[shared_key(key, np.stack([self.keys[n] for n in found[own, 1]])).any(1)]] = True
        return hit

    def leaks(self, text: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item id, start, words, distance, item words), the best run of each pair."""
        best: dict[tuple[int, int], tuple] = {}
        for found in self.places(text, first):
            for doc, n, start in found[self.near(text, first, found)].tolist():
                item_id, item = self.items[n]
                slack = allowed(len(item), self.percent)
                low, high = max(first[doc], start - 2 * slack), min(first[doc + 1], start + len(item) + 2 * slack)
                d, a, b = edit_match(item, text[low:high])
                if d <= slack:
                    got = (d, int(low + a - first[doc]), b - a, len(item))
                    best[doc, n] = min(best.get((doc, n), got), got)
        return [(doc, self.items[n][0], a, size, d, total) for (doc, n), (d, a, size, total) in sorted(best.items())]


def scanner(shared, percent: int):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def scanned(batches):
        items = None
        for batch in batches:
            items = items or Items(shared.value[0], shared.value[1], percent, shared.value[2])
            raw, off = string_buffers(batch.column("text"))
            ids, rows = batch.column("doc_id").to_pylist(), []
            for i, j in blocks(off):
                _, _, word, first = words(raw, off[i : j + 1], True)
                rows += [(ids[i + doc], *rest) for doc, *rest in items.leaks(word, first)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return scanned


def leak_free(shared, percent: int):
    """Batches without the rows whose text leaks an item."""

    def kept(batches):
        items = None
        for batch in batches:
            items = items or Items(shared.value[0], shared.value[1], percent, shared.value[2])
            raw, off = string_buffers(batch.column("text").fill_null(""))
            stay = np.ones(len(batch), bool)
            for i, j in blocks(off):
                _, _, word, first = words(raw, off[i : j + 1], True)
                stay[[i + doc for doc, *_ in items.leaks(word, first)]] = False
            yield batch.filter(pa.array(stay))

    return kept


def item_blocks(docs: DataFrame, benchmark: DataFrame, percent: int, recall: float):
    """Broadcasts of the items, ITEM_BLOCK in each about, with the walks that they need."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    count = max(1, -(-items.count() // ITEM_BLOCK))
    for b in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).orderBy("item_id", "text").collect()
        texts = [r[1] for r in rows]
        yield docs.sparkSession.sparkContext.broadcast(([r[0] for r in rows], texts, walks_needed(texts, percent, recall)))


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """The rows of docs, with all their columns, that leak no item."""
    for shared in item_blocks(docs, benchmark, percent, recall):
        docs = docs.mapInArrow(leak_free(shared, percent), docs.schema)
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """A row for each document and item that it leaks: where the nearest run starts, its words and its distance."""
    return reduce(DataFrame.union, [text_only(docs).mapInArrow(scanner(shared, percent), SCHEMA) for shared in item_blocks(docs, benchmark, percent, recall)])


def op7_cgk_lsh(spark, sf_dir):
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
