"""Packing along a space-filling curve.

Each document's tokens are hashed to signs in DIMS dimensions; the mean over its distinct tokens, squashed, is a point, and
the point's index on a Hilbert curve is its key. Documents are dealt out by ranges of the key (a range-partitioned sort, as
many ranges as PART_BYTES go into the texts), and laid end to end along the curve, so that neighbours in a sequence are
alike. Documents are cut where a sequence is full; the rest at a range's end is cut into sequences of powers of two, so
nothing is padded. A range is streamed: a task holds one open sequence.

The key's last bits are a hash of the document's own id and text, and ties of it are ordered by that hash and the id, so
that copies spread over ranges. A text's tokens are made word by word with a cache in each task, which gives the same ids as
the text at once, as the tokenizer never joins words; a text of each block is encoded at once to compare, and where the
two differ a worker encodes whole texts from then on.

Null and empty texts are the end token alone; a very long text is many pieces; repeated rows are packed each; null ids are
kept; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import blocks, documents, mix, staged, string_buffers, text_only
from tessel.llm.common import words as word_spans

LENGTH, END_ID, DIMS, BITS, TIE_BITS = 2048, 1, 4, 12, 15
#: Bytes of text in a range of the curve, about.
PART_BYTES = 1 << 24
#: Words that a worker remembers (an eighth as many parts of words), and bytes of text that it works on at a time.
CACHE, TOGETHER = 800_000, 1 << 20
SYMBOLS = ".,;:!?|&*$%#"
LAYOUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (rows, dims), by the transpose method for axes of `bits` bits."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for d in range(dims):
            turned = (x[d] & bit) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & np.uint64(1), np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << np.uint64(1)) | ((x[d] >> np.uint64(b)) & np.uint64(1))
    return out


def token_signs(rows: int) -> np.ndarray:
    """A sign of each token in each dimension."""
    bits = mix(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([((bits >> np.uint64(8 * d)) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(DIMS)], 1)


def byte_letters() -> str:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in own else next(spare)) for b in range(256))


class Words:
    """Token ids of texts, word by word. Ids of words met before lie in one pool, found by the word's hash; a new word's
    letters go through the vocabulary's merges, and its other parts, or a word of other make-up, through the encoder."""

    def __init__(self, path: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.model = self.encoder.model
        self.letters = dict(enumerate(byte_letters()))
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.vocabulary = self.encoder.get_vocab_size(True)
        self.kind = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.trusted = True
        self._forget()

    def _forget(self):
        self.hash, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def _piece(self, text: str, letters: bool) -> tuple[int, ...]:
        got = self.pieces.get(text)
        if got is None:
            if letters:
                if not text.isascii():
                    text = text.encode().decode("latin-1").translate(self.letters)
                got = tuple([t.id for t in self.model.tokenize(text)])
            else:
                got = tuple(self.encoder.encode(text, add_special_tokens=False).ids)
            if len(self.pieces) >= CACHE // 8:
                self.pieces.clear()
            self.pieces[text] = got
        return got

    def ids(self, word: str) -> tuple[int, ...]:
        core = word.rstrip(SYMBOLS)
        if core.isalpha() and (core.isascii() or max(core) < "\u0180" and "\u0130" not in core):
            got = self._piece(core.lower(), True)
            return got + self._piece(word[len(core) :], False) if len(core) < len(word) else got
        return self._piece(word, False)

    def _learn(self, hashed: np.ndarray, found: list[str]):
        if len(self.hash) + len(hashed) > CACHE and len(self.hash):
            self._forget()
        made = [self.ids(w) for w in found]
        size = np.array([len(m) for m in made], np.int64)
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(made), self.kind, int(size.sum()))))
        both = np.concatenate((self.hash, hashed))
        order = np.argsort(both, kind="stable")
        self.hash, self.at, self.size = both[order], np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]

    def whole(self, text: str) -> np.ndarray:
        return np.array([*self.encoder.encode(text, add_special_tokens=False).ids, END_ID], self.kind)

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        text = lambda i: raw[off[i] : off[i + 1]].tobytes().decode()
        if self.trusted:
            made = self.by_words(raw, off)
            self.trusted = not made or np.array_equal(made[0], self.whole(text(0)))
            if self.trusted:
                return made
        return [self.whole(text(i)) for i in range(len(off) - 1)]

    def by_words(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        start, end, hashed, first = word_spans(raw, off, False)
        text = raw[off[0] : off[-1]]
        own, at, inverse = np.unique(hashed, return_index=True, return_inverse=True)

        def place():
            where = np.minimum(np.searchsorted(self.hash, own), max(0, len(self.hash) - 1))
            return where, (self.hash[where] == own) if len(self.hash) else np.zeros(len(own), bool)

        where, met = place()
        if not met.all():
            if len(self.hash) + (~met).sum() > CACHE:
                self._forget()
                met[:] = False
            new = at[~met]
            self._learn(own[~met], [text[a:b].tobytes().decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            where, met = place()
        begin, size = self.at[where][inverse], self.size[where][inverse]
        stop = np.cumsum(size)
        ids = self.pool[np.repeat(begin - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        edge = np.append(0, stop)[first]
        return [np.append(ids[a:b], self.kind(END_ID)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


#: A worker's words by tokenizer, kept from task to task.
_WORDS: dict[str | None, Words] = {}


def worker_words(path: str | None) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def keyed(ids: list[np.ndarray], tie: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Hilbert key and tie bits of documents."""
    at = np.empty((len(ids), DIMS))
    seen = np.zeros(len(signs), bool)
    for i, x in enumerate(ids):
        seen[x] = True
        own = np.flatnonzero(seen)
        seen[own] = False
        at[i] = signs[own].sum(0) / np.sqrt(len(own))
    grid = np.floor((1 << BITS) / (1 + np.exp(-at))).clip(0, (1 << BITS) - 1)
    return ((hilbert(grid, BITS) << np.uint64(TIE_BITS)) | (tie & np.uint64((1 << TIE_BITS) - 1))).astype(np.int64)


def encoder(path: str | None):
    """Rows of (key, tie, doc_id, tokens, ids)."""

    def encoded(batches):
        words, signs = worker_words(path), None
        for batch in batches:
            signs = token_signs(words.vocabulary) if signs is None else signs
            raw, off = string_buffers(batch.column("text"))
            for i, j in blocks(off, TOGETHER):
                rows, ids = batch.slice(i, j - i), words(raw, off[i : j + 1])
                key = keyed(ids, mix(rows.column("tie").to_numpy().view(np.uint64)), signs)
                yield pa.RecordBatch.from_arrays([pa.array(key), rows.column("tie"), rows.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["key", "tie", "doc_id", "tokens", "ids"])

    return encoded


def cuts(rest: int) -> list[int]:
    """Powers of two that sum to rest, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Stream:
    """Pieces of documents laid end to end; a sequence's pieces are given out when it is full."""

    def __init__(self, part: int, length: int):
        self.next, self.length, self.open, self.used = part << 32, length, [], 0

    def add(self, doc, ids: np.ndarray):
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.length - self.used)
            self.open.append((doc, at, ids[at : at + n], len(ids)))
            self.used, at = self.used + n, at + n
            if self.used == self.length:
                yield from self._close(self.open)
                self.open, self.used = [], 0

    def _close(self, pieces):
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset
            offset += len(ids)
        self.next += 1

    def finish(self):
        pieces = self.open
        for size in cuts(self.used):
            mine = []
            while size:
                doc, start, ids, total = pieces[0]
                mine.append((doc, start, ids[:size], total))
                pieces = pieces[1:] if len(ids) <= size else [(doc, start + size, ids[size:], total), *pieces[1:]]
                size -= len(mine[-1][2])
            yield from self._close(mine)


def packer(length: int):
    names = [x.split()[0] for x in LAYOUT.split(", ")]

    def packed(batches):
        stream = Stream(TaskContext.get().partitionId(), length)
        for batch in batches:
            out = []
            for doc, n, body in zip(batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                out.extend(stream.add(doc, np.frombuffer(body, np.uint16 if len(body) == 2 * n else np.uint32)))
            yield _table(out, names)
        yield _table(list(stream.finish()), names)

    return packed


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, parts: int | None = None) -> DataFrame:
    """Pieces of all documents in sequences. tokenizer: a file of word-bound ids that every machine has (None: the
    installed word_bpe_49k.json); parts: ranges of the curve, by PART_BYTES unless given."""
    rows = text_only(docs).select("doc_id", "text", F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "text").alias("tie"))
    parts = parts or int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES + 1
    # written once, so that finding the ranges reads keys and tokenizes nothing again
    encoded = staged(rows.mapInArrow(encoder(tokenizer), "key long, tie long, doc_id long, tokens long, ids binary"), "token-ids")
    order = ("key", "tie", "doc_id")
    return encoded.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(packer(length), LAYOUT)


def op10_hilbert(spark, sf_dir):
    return pack(documents(spark, sf_dir))
