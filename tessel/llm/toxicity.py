"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input is a learned vector of the word (hashed) beside the mean of learned vectors of its character n-grams
(hashed, word edges included), so unseen inflections keep what their stems say. The network reads windows of WINDOW
words, each STRIDE after the one before, over the whole text; attention weighs its states, and a text's score is that of
its worst window. It is fitted to at most TRAIN_ROWS labelled texts of either class (a documented bound, texts in hash
order of doc_id). Executors count in how many of them each word and n-gram stands, and choose of each whole text the
MOST_WINDOWS windows with the worst odds; the driver gets these alone, and trains through the worst of each text
(multiple-instance learning). A fifth of the texts is kept from all that, scored whole, and sets the threshold. Scoring
runs in Arrow batches, every text of the table.

Null and empty texts have one window of padding, whose score is the bias's; a text whose only words are new still has its
n-grams; a very long text is as many windows as it takes, read TOGETHER at a time; repeated rows and null ids get a row
each, and of repeated ids one labelled row trains; ties between windows go to the first; without labels of both classes
every score is 0; an empty table gives an empty result; other columns are ignored, whatever their names (for held_out a
null doc_id counts as held out).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import added, blocks, documents, drop_staged, free_name, mix, staged, string_buffers, text_only, words

WINDOW, STRIDE, HIDDEN = 64, 32, 8
WORD_ROWS, CHAR_ROWS, DIMS = 1 << 16, 1 << 17, 4
#: Bytes of a word's grams.
GRAMS = (3, 4, 5)
TRAIN_ROWS, EPOCHS, BATCH, RATE, SEED = 2000, 6, 64, 0.02, 11
#: Words whose gate inputs a worker keeps between batches, and windows that it reads at a time.
CACHE, TOGETHER = 120_000, 2048
#: Words whose n-grams are made at a time.
SOME = 20_000
#: Windows of a text that it trains through, the most bytes of one, and tasks that share the labelled texts.
MOST_WINDOWS, WINDOW_BYTES, PARTS = 4, 4096, 8
_HOLD = 60.0


def _char_rows(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the GRAMS-byte grams (edges marked, A-Z folded) of words, and each word's first entry."""
    size = end - start + 2
    first = np.cumsum(size) - size
    n = int(size.sum())
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(n) - first[word]
    byte = data[np.clip(start[word] + at - 1, 0, len(data) - 1)].astype(np.uint64)
    byte = np.where((byte >= 65) & (byte < 91), byte + np.uint64(32), byte)
    byte[first] = 1
    byte[first + size - 1] = 2
    left = size[word] - at
    rows, owner = [], []
    code = byte.copy()
    for k in range(1, max(GRAMS)):
        code = code[:-1] | (byte[k:] << np.uint64(8 * k)) if len(code) > 1 else code[:0]
        if k + 1 in GRAMS:
            full = np.flatnonzero(left[: len(code)] > k)
            rows.append((mix(code[full] + np.uint64(k << 56)) & np.uint64(CHAR_ROWS - 1)).astype(np.int64))
            owner.append(word[full])
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return rows[order].astype(np.int32), np.searchsorted(owner[order], np.arange(len(size) + 1))


class Texts:
    """Distinct words of some texts (word row, n-gram rows) and the texts' words as their numbers."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        text = data[off[0] : off[-1]]
        parts, total = [], 0
        for i, j in blocks(off):
            begin, stop, found, first = words(data, off[i : j + 1], True)
            parts.append((begin + off[i] - off[0], stop + off[i] - off[0], found, first[:-1] + total))
            total += len(found)
        start, end, hashed, first = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (int, int, np.uint64, int))
        self.first = np.append(first, total)
        self.hash, at, self.word = np.unique(hashed, return_index=True, return_inverse=True)
        self.text, self.start, self.end = text, start[at], end[at]
        self.rows = (self.hash & np.uint64(WORD_ROWS - 1)).astype(np.int64)

    def grams(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-gram rows of some words, and each word's first entry; SOME words at a time."""
        made = [_char_rows(self.text, self.start[p], self.end[p]) for p in np.split(pick, range(SOME, len(pick), SOME))]
        base = np.cumsum([0, *(len(r) for r, _ in made)])
        return np.concatenate([r for r, _ in made]), np.concatenate([*(f[:-1] + b for (_, f), b in zip(made, base, strict=False)), base[-1:]])

    def windows(self, pad: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all windows (WINDOW columns, padded), and each text's first window."""
        n = np.diff(self.first)
        count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        begin = np.cumsum(count) - count
        doc = np.repeat(np.arange(len(n)), count)
        at = (self.first[:-1][doc] + (np.arange(len(doc)) - begin[doc]) * STRIDE)[:, None] + np.arange(WINDOW)
        out = np.full(at.shape, pad, np.int32)
        inside = at < self.first[1:][doc][:, None]
        out[inside] = self.word[at[inside]]
        return out, np.append(begin, len(doc))


def _mean(table: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Means of table rows by word; every word has a gram, as its edges count."""
    out = np.empty((len(first) - 1, table.shape[1]), np.float32)
    for i in range(0, len(out), SOME):
        cut = first[i : i + SOME + 1]
        out[i : i + SOME] = np.add.reduceat(table[rows[cut[0] : cut[-1]]], cut[:-1] - cut[0], axis=0) / np.diff(cut)[:, None].astype(np.float32)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _run(gates: np.ndarray, u: np.ndarray, keep: bool):
    """States (steps, rows, HIDDEN) of one direction over gate inputs (steps, rows, 3 HIDDEN)."""
    h = np.zeros((gates.shape[1], HIDDEN), np.float32)
    out, kept = np.empty((*gates.shape[:2], HIDDEN), np.float32), []
    for t in range(len(gates)):
        back = h @ u
        zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + back[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * back[:, 2 * HIDDEN :])
        if keep:
            kept.append((h, z, r, n, back[:, 2 * HIDDEN :]))
        h = z * h + (1 - z) * n
        out[t] = h
    return out, kept


def _attend(model: dict, states: np.ndarray, solid: np.ndarray):
    """Logits of windows and the attention weights, from the states of both directions (steps, rows, 2 HIDDEN)."""
    s = np.where(solid, states @ model["attend"], np.float32(-1e9))
    a = np.exp(s - s.max(0))
    a /= a.sum(0)
    pooled = (a[:, :, None] * states).sum(0)
    return pooled @ model["out"] + model["bias"][0], a, pooled


def _gates(model: dict, x: np.ndarray) -> np.ndarray:
    """Gate inputs of both directions for word inputs x, and a last row that holds the state."""
    g = np.concatenate((x @ model["in_f"] + model["b_f"], x @ model["in_b"] + model["b_b"]), 1).astype(np.float32)
    hold = np.zeros((1, g.shape[1]), np.float32)
    hold[0, :HIDDEN] = hold[0, 3 * HIDDEN : 4 * HIDDEN] = _HOLD
    return np.concatenate((g, hold))


def logits(model: dict, gates: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Logits of windows (word numbers, the last row of gates as padding)."""
    out = np.empty(len(windows), np.float32)
    for i in range(0, len(windows), TOGETHER):
        w = windows[i : i + TOGETHER].T
        fwd, _ = _run(gates[:, : 3 * HIDDEN][w], model["u_f"], False)
        bwd, _ = _run(gates[:, 3 * HIDDEN :][w[::-1]], model["u_b"], False)
        out[i : i + TOGETHER] = _attend(model, np.concatenate((fwd, bwd[::-1]), 2), w != len(gates) - 1)[0]
    return out


def _backward(gates: np.ndarray, u: np.ndarray, kept: list, grad: np.ndarray):
    """Gradients of the gate inputs and of u, given those of the states."""
    d_gates, d_u, dh = np.zeros_like(gates), np.zeros_like(u), np.zeros(grad.shape[1:], np.float32)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, n, back = kept[t]
        dh = dh + grad[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * back * r * (1 - r)
        d_gates[t] = np.concatenate((dz, dr, dn), 1)
        d_back = np.concatenate((dz, dr, dn * r), 1)
        d_u += h.T @ d_back
        dh = dh * z + d_back @ u.T
    return d_gates, d_u


def _step(model: dict, texts: Texts, grams, chosen: np.ndarray, y: np.ndarray) -> dict:
    """Gradients of the log loss over some windows."""
    used, at = np.unique(chosen, return_inverse=True)
    at = at.reshape(chosen.shape)
    pad = len(texts.hash)
    real = used[used != pad]
    if not len(real):
        return {}
    rows, first = grams
    part = np.concatenate([rows[first[i] : first[i + 1]] for i in real])
    size = np.diff(first)[real]
    cut = np.append(0, np.cumsum(size))
    x = np.concatenate((model["word"][texts.rows[real]], _mean(model["char"], part, cut)), 1)
    gates = _gates(model, x)
    w = at.T
    g_f, g_b = gates[:, : 3 * HIDDEN][w], gates[:, 3 * HIDDEN :][w[::-1]]
    fwd, kept_f = _run(g_f, model["u_f"], True)
    bwd, kept_b = _run(g_b, model["u_b"], True)
    states = np.concatenate((fwd, bwd[::-1]), 2)
    logit, a, pooled = _attend(model, states, w != len(real))
    d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    out = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
    d_pooled = d[:, None] * model["out"]
    d_a = (states * d_pooled).sum(2)
    d_s = a * (d_a - (a * d_a).sum(0))
    out["attend"] = (d_s[:, :, None] * states).sum((0, 1))
    d_states = a[:, :, None] * d_pooled + d_s[:, :, None] * model["attend"]
    df, out["u_f"] = _backward(g_f, model["u_f"], kept_f, d_states[:, :, :HIDDEN])
    db, out["u_b"] = _backward(g_b, model["u_b"], kept_b, d_states[::-1, :, HIDDEN:])
    d_gates = np.zeros((len(real) + 1, 6 * HIDDEN), np.float32)
    np.add.at(d_gates[:, : 3 * HIDDEN], w, df)
    np.add.at(d_gates[:, 3 * HIDDEN :], w[::-1], db)
    d_gates = d_gates[:-1]
    for way, cols in (("f", slice(0, 3 * HIDDEN)), ("b", slice(3 * HIDDEN, None))):
        out[f"in_{way}"], out[f"b_{way}"] = x.T @ d_gates[:, cols], d_gates[:, cols].sum(0)
    d_x = d_gates[:, : 3 * HIDDEN] @ model["in_f"].T + d_gates[:, 3 * HIDDEN :] @ model["in_b"].T
    out["word"], out["char"] = np.zeros_like(model["word"]), np.zeros_like(model["char"])
    np.add.at(out["word"], texts.rows[real], d_x[:, :DIMS])
    np.add.at(out["char"], part, np.repeat(d_x[:, DIMS:] / size[:, None], size, axis=0))
    return out


def odds(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Smoothed log odds of table rows, in units of 1 about. counts: clean and toxic texts of each row; texts: of all."""
    neg, pos = counts
    return (np.log((pos + 2) / (texts[1] + 4)) - np.log((neg + 2) / (texts[0] + 4))).astype(np.float32).clip(-4, 4) / 2


def train(windows: list[str], owner: np.ndarray, y: np.ndarray, word_odds: np.ndarray, char_odds: np.ndarray) -> dict:
    """The network fitted to texts of several windows each (owner: the text of each, in order), through the worst one."""
    rng = np.random.default_rng(SEED)
    body = [t.encode() for t in windows]
    t = Texts(np.frombuffer(b"".join(body), np.uint8), np.append(0, np.cumsum([len(b) for b in body])).astype(np.int64))
    pad = len(t.hash)
    grams = t.grams(np.arange(pad))
    normal = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    model = {"word": normal(WORD_ROWS, DIMS) / 10, "char": normal(CHAR_ROWS, DIMS) / 10, "attend": normal(2 * HIDDEN), "out": normal(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    for way in "fb":
        model |= {f"in_{way}": normal(2 * DIMS, 3 * HIDDEN), f"b_{way}": np.zeros(3 * HIDDEN, np.float32), f"u_{way}": normal(HIDDEN, 3 * HIDDEN)}
    model["word"][:, 0], model["char"][:, 0] = word_odds, char_odds
    rows = t.windows(pad)[0]  # one for each, as they have WINDOW words at most
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    chosen = first  # the window with the worst odds comes first
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    step = 0
    for epoch in range(EPOCHS):
        if epoch == EPOCHS // 2:
            score = logits(model, _gates(model, np.concatenate((model["word"][t.rows], _mean(model["char"], *grams)), 1)), rows)
            chosen = np.lexsort((-score, owner))[first]
        order = rng.permutation(len(first))
        for i in range(0, len(order), BATCH):
            mine = order[i : i + BATCH]
            step += 1
            for k, g in _step(model, t, grams, rows[chosen[mine]], y[mine].astype(np.float32)).items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def _threshold(logit: np.ndarray, y: np.ndarray) -> float:
    """Middle of the widest best cut: fewest errors, each class weighed by its share of the other."""
    order = np.argsort(logit, kind="stable")
    ranked, hit = logit[order], y[order]
    wrong = np.append(0, np.cumsum(hit)) / max(1, hit.sum()) + ((1 - hit).sum() - np.append(0, np.cumsum(1 - hit))) / max(1, (1 - hit).sum())
    edges = np.concatenate(([ranked[0] - 1], (ranked[1:] + ranked[:-1]) / 2, [ranked[-1] + 1]))
    gap = np.concatenate(([1], np.diff(ranked), [1]))
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    return float(edges[best[np.argmax(gap[best])]])


class Scorer:
    """Scores texts, keeping the gate inputs of words it has met."""

    def __init__(self, model: dict):
        self.model = model
        self.known, self.gates = np.zeros(0, np.uint64), np.zeros((0, 6 * HIDDEN), np.float32)

    def _inputs(self, t: Texts) -> np.ndarray:
        at = np.searchsorted(self.known, t.hash)
        met = at < len(self.known)
        met[met] = self.known[at[met]] == t.hash[met]
        new = np.flatnonzero(~met)
        out = np.empty((len(t.hash) + 1, 6 * HIDDEN), np.float32)
        out[:-1][met] = self.gates[at[met]]
        if len(new):
            x = np.concatenate((self.model["word"][t.rows[new]], _mean(self.model["char"], *t.grams(new))), 1)
            made = _gates(self.model, x)
            out[new] = made[:-1]
            if len(self.known) > CACHE:
                self.known, self.gates = self.known[:0], self.gates[:0]
            both = np.concatenate((self.known, t.hash[new]))
            order = np.argsort(both, kind="stable")
            self.known, self.gates = both[order], np.concatenate((self.gates, made[:-1]))[order]
        out[-1] = _gates(self.model, np.zeros((0, 2 * DIMS), np.float32))[-1]
        return out

    def __call__(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        t = Texts(data, off)
        windows, first = t.windows(len(t.hash))
        return _sigmoid(np.maximum.reduceat(logits(self.model, self._inputs(t), windows), first[:-1]).astype(np.float64))


def scorer(shared, name: str = "score"):
    """Batches with one more column: the score of the column text."""

    def scored(batches):
        run = None
        for batch in batches:
            raw, off = string_buffers(batch.column("text").fill_null(""))
            run = run or Scorer(shared.value)
            out = [run(raw, off[i : j + 1]) if run.model else np.zeros(j - i) for i, j in blocks(off)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], [*batch.schema.names, name])

    return scored


def counted(batches):
    """Of a partition's labelled texts (text, toxic): how many clean and toxic ones have each row of words and n-grams."""
    count = np.zeros((2, WORD_ROWS + CHAR_ROWS), np.int64)
    for batch in batches:
        raw, off = string_buffers(batch.column("text"))
        for i, toxic in enumerate(batch.column("toxic").to_pylist()):
            t = Texts(raw, off[i : i + 2])
            count[toxic, np.unique(t.rows)] += 1
            if len(t.hash):
                count[toxic, WORD_ROWS + np.unique(t.grams(np.arange(len(t.hash)))[0])] += 1
    at = np.flatnonzero(count.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, count[0, at], count[1, at])], ["at", "clean", "toxic"])


def worst_windows(shared):
    """Of each labelled text the MOST_WINDOWS windows with the worst odds, over the whole text; the first of equals."""

    def chosen(batches):
        word_odds, char_odds = shared.value
        for batch in batches:
            raw, off = string_buffers(batch.column("text"))
            docs, toxic, place, texts = [], [], [], []
            for i, (doc, label) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), strict=True)):
                text = raw[off[i] : off[i + 1]]
                t = Texts(text, np.array([0, len(text)]))
                start, end, _, _ = words(text, np.array([0, len(text)]), True)
                grams = t.grams(np.arange(len(t.hash))) if len(t.hash) else (np.zeros(0, int), np.zeros(1, int))
                prior = np.append(np.maximum(word_odds[t.rows], _mean(char_odds[:, None], *grams)[:, 0]), 0)[t.windows(len(t.hash))[0]].max(1)
                kept = 0
                for w in np.argsort(-prior, kind="stable").tolist():
                    own = slice(w * STRIDE, w * STRIDE + WINDOW)
                    body = text[start[own][0] : end[own][-1]].tobytes() if len(start[own]) else b""
                    if len(body) <= WINDOW_BYTES:
                        docs.append(doc)
                        toxic.append(label)
                        place.append(kept)
                        texts.append(body.decode())
                        kept += 1
                    if kept == MOST_WINDOWS:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(toxic, pa.int32()), pa.array(place, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "toxic", "place", "text"])

    return chosen


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """The network fitted to at most `rows` labelled texts of either class whose crc32(doc_id) mod 5 is not 0.

    A fifth of them is held back from odds and training; the shift that puts the best threshold on their whole texts'
    logits at 0 comes last. The driver gets counts of table rows, and windows of bounded number and size.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hashed = F.xxhash64("doc_id")
    bounded = [known.where(f"toxic = {v}").orderBy(hashed, "doc_id").limit(rows) for v in (0, 1)]
    sample = bounded[0].union(bounded[1])  # 2 * rows at most are broadcast
    texts = text_only(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(5)) == 0)
    texts = staged(texts.repartition(PARTS, "doc_id"), "labelled-texts")
    fit, held = texts.where("not held"), texts.where("held")
    seen = fit.groupBy("toxic").count().collect()
    total = np.array([sum(r[1] for r in seen if r[0] == v) for v in (0, 1)])
    if not total.all():
        drop_staged(texts)
        return {}
    count = np.zeros((2, WORD_ROWS + CHAR_ROWS), np.int64)
    for r in fit.select("text", "toxic").mapInArrow(counted, "at long, clean long, toxic long").groupBy("at").agg(F.sum("clean"), F.sum("toxic")).toLocalIterator():
        count[:, r[0]] = r[1], r[2]
    tables = odds(count[:, :WORD_ROWS], total), odds(count[:, WORD_ROWS:], total)
    shared = spark.sparkContext.broadcast(tables)
    got = fit.select("doc_id", "text", "toxic").mapInArrow(worst_windows(shared), "doc_id long, toxic int, place int, text string").orderBy("doc_id", "place").collect()  # 2 * rows * MOST_WINDOWS at most
    ids = np.array([r["doc_id"] for r in got])
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    model = train([r["text"] for r in got], ids, np.array([r["toxic"] for r in got])[first], *tables)
    scored = held.select("text", "toxic").mapInArrow(scorer(spark.sparkContext.broadcast(model)), "text string, toxic int, score double").select("score", "toxic").orderBy("score", "toxic").collect()
    score, label = np.array([r[0] for r in scored]).clip(1e-12, 1 - 1e-12), np.array([r[1] for r in scored])
    if 0 < label.sum() < len(label):
        model["bias"] -= np.float32(_threshold(np.log(score / (1 - score)), label))
    drop_staged(texts)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, score (0 to 1) of each row."""
    model = fitted(docs, labels) if model is None else model
    return text_only(docs).mapInArrow(scorer(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, text string, score double").select("doc_id", "score")


def not_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score below the limit."""
    name = free_name(docs, "toxicity")
    scored = docs.mapInArrow(scorer(docs.sparkSession.sparkContext.broadcast(fitted(docs, labels)), name), added(docs, name, "double"))
    return scored.where(F.col(name) < limit).drop(name)


def op2_attention_gru(spark, sf_dir):
    scored = toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
