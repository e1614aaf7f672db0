"""Manifest, fill-in-the-middle and mixing against plain Python, their SQL, and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessel.llm import fill_middle, merkle, mixing

from .conftest import prose

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = rng.choice([None, "", "Éa <P> x", prose(rng, 40).title(), prose(rng, rng.randint(1, 300)), "a\r\nB \U0001f600" * 5, "<" * 3 + "S>"])
        out.append((i, text, rng.choice(["en", None]), rng.choice(sources), None if text is None else len(text)))
    return out


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def by_sql(con, spark_rows, sql):
    con.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", spark_rows)
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


# --- 11: manifest


def plain_tree(hashes):
    """Root, and of each leaf the (left, right) siblings level by level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for leaf, i in enumerate(at):
            run = hashes[i // 16 * 16 : i // 16 * 16 + 16]
            paths[leaf].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        hashes, at = [SHA("".join(hashes[i : i + 16])) for i in range(0, len(hashes), 16)], [i // 16 for i in at]
    return (hashes or [None])[0], paths


def plain_manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s, n: SHA("".join(map(enc, (i, s, lang, n, t))))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, above = plain_tree([trees[s][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for (_, _, own, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            path = path + above[place]
            start = own
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                start = leaf(r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), *r[2:])
            for a, b in path:
                start = SHA(a + start + b)
            out.append((r[0], own, trees[s][0], root, SHA("".join(a + b for a, b in path)), start, start == root))
    return Counter(out)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op11(docs):
    tampered = merkle.F.crc32(merkle.F.col("doc_id").cast("string").cast("binary")) % merkle.TAMPERED == 0
    return Counter(tuple(r[c] for c in NAMES) for r in merkle.manifest(docs, tampered, merkle.lowered(merkle.F.col("text"))).collect())


@pytest.mark.parametrize(("n", "sources"), [(700, ["a"] * 60 + ["b", "É", "z", None, "one"]), (40, [f"s{i}" for i in range(30)]), (1, ["x"]), (257, [None])])
def test_manifest_is_the_plain_trees(spark, n, sources):
    rows = rows_of(n, n, sources)
    got = op11(spark.createDataFrame(rows, COLUMNS).repartition(3))
    assert got == plain_manifest(rows)
    names, want = by_sql(duckdb.connect(), rows, merkle.OP11_SQL)
    assert got == Counter(tuple(r[names.index(c)] for c in NAMES) for r in want)


def test_manifest_edge_cases(spark, edges, empty):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in edges.collect()]
    assert op11(edges) == plain_manifest(rows) and op11(empty) == Counter()
    assert all(r["verified"] for r in merkle.manifest(edges).collect())


def test_any_change_is_found(spark):
    rows = rows_of(3, 50, ["a", "b"])
    docs = spark.createDataFrame(rows, COLUMNS)
    root = {r["root"] for r in merkle.manifest(docs).collect()}
    for changed in (rows[:-1], [(rows[0][0], "x", *rows[0][2:]), *rows[1:]], [(r[0], r[1], r[2], "a", r[4]) for r in rows]):
        assert {r["root"] for r in merkle.manifest(spark.createDataFrame(changed, COLUMNS)).collect()} != root


# --- 12: fill-in-the-middle


def plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = SHA("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, SHA(text), SHA(text)
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(tokens), "spm" if h4 % 100 < 20 else "psm", len(p), len(m), SHA(out), SHA(text)


CUTS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_cuts_are_the_plain_ones(spark, edges, empty):
    rows = rows_of(8, 400, ["a"])
    rows += [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in edges.collect()]
    got = fill_middle.fill_in_middle(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
    mine = Counter(tuple(r[c] for c in CUTS) for r in got)
    assert mine == Counter(plain_fim(r[0], r[1]) for r in rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert all(SHA(r["output"]) == r["output_sha256"] for r in got)
    names, want = by_sql(duckdb.connect(), rows, fill_middle.OP12_SQL)
    assert mine == Counter(tuple(r[names.index(c)] for c in CUTS) for r in want)
    assert fill_middle.fill_in_middle(empty).count() == 0 and fill_middle.fill_in_middle(edges, keep=False).count() == edges.count()


def test_outputs_are_parsed_back():
    rng = random.Random(2)
    pattern = fill_middle.regex.compile(fill_middle.TOKEN)
    for i in range(3000):
        text = "".join(rng.choice(["<", "<P", "S>", ">", "M", "a b", "<M", "P>", "\n"]) for _ in range(rng.randint(0, 12)))
        form, output = (x := fill_middle.transformed(str(i), text, pattern))[1], x[4]
        assert fill_middle.restored(output, form) == text


# --- 13: mixing


def plain_targets(size, weights=(1, 2, 3), most=3):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, words = set(), sum(size.values())
    while True:
        rest = [s for s in order if s not in full]
        share = (words - sum(most * size[s] for s in full)) / max(1, sum(weight[s] for s in rest))
        more = {s for s in rest if weight[s] * share > most * size[s]}
        if not more:
            return {s: most * size[s] if s in full else weight[s] * share for s in order}
        full |= more


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("block", [1024, 16])
def test_mix_meets_the_targets(spark, block):
    rng = random.Random(block)
    rows = [(i, prose(rng, rng.choice([0, 5, 20, 90, rng.randint(1, 400)])), None, rng.choices([None, "big", "small", "É", "tiny", "z"], [9, 60, 20, 9, 1, 1])[0], 0) for i in range(1500)]
    rows += [(5000, "a b c", None, "tiny", 0)] * 40
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = mixing.mixed(docs, block=block).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], words(r[1])) for r in rows)
    source, size = {r[0]: r[3] for r in rows}, Counter()
    for r in rows:
        size[r[3]] += words(r[1])
    goal = plain_targets(size)
    assert abs(sum(goal.values()) - sum(size.values())) < 1e-6
    taken, times = Counter(), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - goal[s]) < 1e-6 and r["taken"] == r["times"] * r["size"]
        assert r["times"] in ({int(goal[s] / size[s]), int(goal[s] / size[s]) + 1} if goal[s] < 3 * size[s] else {3})
        taken[s] += r["taken"]
        times[s] += r["times"]
    for s in size:
        assert abs(taken[s] - goal[s]) <= max(3, 0.01 * goal[s]), s
        assert abs(times[s] - goal[s] / size[s] * sum(r[3] == s for r in rows)) <= 3, s
    again = mixing.mixed(docs.repartition(7), block=block).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_flight_keeps_totals_and_chances():
    rng = np.random.default_rng(4)
    size = rng.integers(0, 50, 40).tolist()
    start = rng.random(40).tolist()
    seen = np.zeros(40)
    for turn in range(3000):
        part = list(start)
        open_ = mixing.fly(size, part, np.random.default_rng(turn).random)
        assert len(open_) <= 2 and abs(sum(part) - sum(start)) < 1e-6 and abs(np.dot(size, part) - np.dot(size, start)) < 1e-6
        seen += part
    assert np.abs(seen / 3000 - start).max() < 0.05


def test_mix_edge_cases(spark, edges, empty):
    got = mixing.mixed(edges).collect()
    want = Counter((r["doc_id"], words(r["text"])) for r in edges.collect())
    assert Counter((r["doc_id"], r["size"]) for r in got) == want and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mixed(empty).count() == 0
    blank = edges.where("doc_id in (1, 2, 3)")
    assert {(r["target"], r["taken"]) for r in mixing.mixed(blank).collect()} == {(0.0, 0)}
