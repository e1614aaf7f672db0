"""Every stage of the pipeline acts, on what the one before it kept, and clean documents pass all of them."""

import random
import zlib

import numpy as np

import corpus_pipeline
from tessel.llm import decontamination, ngram_join, packing, toxicity

from .conftest import prose
from .test_operators import base_by_brute_force, components_by_brute_force

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect_in_order(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("labels", "benchmark"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        docs = stage(spark, before, DIR).cache()
        assert docs.columns == before.columns
        ids, old = ({r[0] for r in d.select("doc_id").collect()} for d in (docs, before))
        assert ids <= old
        if k == 0:
            assert ids == {r[0] for r in toxicity.toxicity(before, labels).where("score < 0.5").select("doc_id").collect()}
        if k == 1:
            assert ids == {r["component_id"] if r["n_shingles"] else r["doc_id"] for r in ngram_join.jaccard_components(before).collect()}
        if k == 2:
            assert ids == old - {r["doc_id"] for r in decontamination.leaks(before, bench).collect()}
        if k == 3:
            assert ids == old and docs.where("text rlike '[a-z0-9]+@[a-z0-9-]+[.][a-z]+'").isEmpty()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, DIR).where("length < 1 or length > 2048").count() == 0


def test_run_against_plain_python(spark, tmp_path):
    """Rows of run() against sets, plain edit distance, patterns and the tokenizer; which texts are toxic is taken as scored."""
    rng = random.Random(41)
    items = [prose(rng, 20), prose(rng, 31)]
    texts = []
    for i in range(60):
        body = prose(rng, rng.randint(30, 120))
        texts.append(body + (f" mail a{i}@b.org or +49 170 12345{i:02d}, 10.0.0.{i}" if i % 4 == 0 else "") + (" vileling scumbag trashy" if i % 6 == 1 else ""))
    for i in range(8):  # near copies, and leaks at the limit of edits
        w = texts[4 * i + 2].split()
        w[len(w) // 2] = "zz"
        texts.append(" ".join(w))
        w = items[i % 2].split()
        for at in rng.sample(range(len(w)), len(w) // 5):
            w[at] = "qq"
        texts.append(prose(rng, 25) + " " + " ".join(w) + " " + prose(rng, 9))
    texts += [texts[0], "", None]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    spark.createDataFrame([(i, texts[i], "en", "s", len(texts[i] or "")) for i in ids], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 1)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, labels = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels"))
    left = sorted(r[0] for r in toxicity.toxicity(docs, labels).where("score < 0.5").collect())
    assert len(left) > 50
    parts = components_by_brute_force([texts[i] for i in left], 5, 80)
    left = [i for k, i in enumerate(left) if not parts[k][0] or left[parts[k][1]] == i]
    leaked = lambda t: any(plain_distance(item.split(), t.lower().split()) <= len(item.split()) * 20 // 100 for item in items)
    left = [i for i in left if not leaked(texts[i] or "")]
    encoder, got = packing.Words(None).encoder, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sorted(got) == left and 30 < len(left) < 65
    for i in left:
        text, at = texts[i] or "", 0
        clean = []
        for start, _, end, kind in base_by_brute_force(text):
            if start >= at:
                clean += [text[at:start], f"<{kind}>"]
            at = max(at, end)
        tokens = np.array([*encoder.encode("".join(clean) + text[at:], add_special_tokens=False).ids, 1], np.uint32)
        at = 0
        for r in sorted(got[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(tokens), zlib.crc32(tokens[at : at + r["length"]].astype("<u4").tobytes()))
            at += r["length"]
        assert at == len(tokens)


def plain_distance(item, words):
    """Edit distance of an item to the nearest run of words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)
