"""Fragments, verdicts of layered strings and of rules, ranked matches and duplicate reports on small cases."""

import pytest
from pyspark.sql import functions as F

from tessel.functions import fragments
from tessel.operators import audit, dedup, pairs, screen
from tessel.plans import fragment_queries
from tessel.sources import sinks


def test_desalting_keeps_the_heaviest_and_names_the_rest(spark):
    rows = [(0, "CCCN.Cl"), (1, "[Na+].CC(=O)[O-].O"), (2, "CCO.CCO"), (3, "CC"), (4, ""), (5, None), (6, "CCCCN.[Fe+3]")]
    got = {r["i"]: r["d"] for r in spark.createDataFrame(rows, "i int, s string").select("i", fragments.desalted(F.col("s")).alias("d")).collect()}
    shown = {i: (d["parent"], [tuple(r) for r in d["removed"]] if d["removed"] is not None else None) for i, d in got.items()}
    assert shown == {
        0: ("CCCN", [("Cl", "hydrochloric acid", "salt")]),
        1: ("CC(=O)[O-]", [("[Na+]", "sodium", "counterion"), ("O", "water", "solvent")]),
        2: ("CCO", [("CCO", "ethanol", "solvent")]),
        3: ("CC", []),
        4: (None, []),
        5: (None, None),
        6: ("CCCCN", [("[Fe+3]", None, "unknown")]),
    }
    assert len(fragments.KNOWN) == len({n for n, _, _ in fragments.KNOWN}) == 55


def test_layers_part_at_the_first_that_differs(spark):
    cases = {
        "match": ["X/F/c1/h1", "X/F/c1/h1"],
        "later": ["X/F/c1/h1", "X/F/c1/h2", None],
        "bonds": ["X/F/c1", "X/F/c2"],
        "unbound": ["X/F/c1/h1", "X/F/h1"],
        "formula": ["X/F/c1", "X/G/c1"],
        "none": ["X", "Y"],
        "missing": ["X/F/c1", None],
        "empty": [None],
    }
    rows = [(k, str(i), v) for k, values in cases.items() for i, v in enumerate(values)]
    got = {r["k"]: (r["found"], r["status"], r["parts_at"]) for r in audit.compared_layers(spark.createDataFrame(rows, "k string, source string, value string"), "k").collect()}
    assert got == {
        "match": (2, "match", "none"),
        "later": (2, "minor_difference", "later_layers"),
        "bonds": (2, "minor_difference", "connectivity"),
        "unbound": (2, "minor_difference", "later_layers"),
        "formula": (2, "mismatch", "formula"),
        "none": (2, "mismatch", "formula"),
        "missing": (1, "missing", "none"),
        "empty": (0, "missing", "none"),
    }


def test_ranked_matches_count_repeated_tokens_once(spark):
    rows = [(1, "a b c d".split()), (2, "a b c e".split()), (3, "a b".split()), (4, "a a".split())]
    df = spark.createDataFrame(rows, "i int, t array<string>").withColumn("v", F.lit(1.0))
    sets = {i: set(t) for i, t in rows}
    want = sorted(((-round(len(sets[x] & sets[y]) / len(sets[x] | sets[y]), 6), x, y) for x, y in ((1, 2), (3, 4))))
    got = pairs.ranked_matches(pairs.matched_pairs(df, "i", "t", "v"), 10).collect()
    assert [(-r["similarity"], r["a"], r["b"]) for r in got] == want
    assert pairs.ranked_matches(pairs.matched_pairs(df, "i", "t", "v"), 1).count() == 1


def starred(seed, n):
    """Token lists of a few words, the star of a core among them, some of them empty or longer."""
    import random

    pick = random.Random(seed)
    return [(i, pick.choices(("a", "b", "c", "d", "e", "", "*")[: 5 if seed % 2 else 7], k=pick.choice((1, 2, 3, 3, 3)))) for i in pick.sample(range(-50, 1000), n)]


def by_hand(rows):
    """Matched pairs as their SQL has them: the first core of each pair."""
    cuts = {i: [(" ".join("*" if p == at else u for p, u in enumerate(t)), t[at]) for at in range(len(t))] for i, t in rows}
    out = {}
    for a, x in rows:
        for b, y in rows:
            if a < b and (met := sorted((c, s, u) for c, s in cuts[a] for d, u in cuts[b] if c == d and s != u)):
                out[a, b] = (*met[0], round(len({*x} & {*y}) / len({*x, *y}), 6))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_best_matches_are_the_first_of_all_pairs(spark, seed):
    rows = starred(seed, 90)
    want = by_hand(rows)
    df = spark.createDataFrame(rows, "i int, t array<string>").withColumn("v", F.lit(1.0))
    assert {(r["a"], r["b"]): (r["core"], r["a_token"], r["b_token"]) for r in pairs.matched_pairs(df, "i", "t", "v", most=7).collect()} == {k: x[:3] for k, x in want.items()}
    ranked = sorted(want, key=lambda k: (-want[k][3], k))
    for most in (2, 9, len(want) + 1):
        got = [((r["a"], r["b"]), (r["core"], r["a_token"], r["b_token"], r["similarity"])) for r in pairs.best_matches(df, "i", "t", "v", most).collect()]
        assert got == [(k, want[k]) for k in ranked[:most]]


def joined_rows(df):
    """Rows that the joins of df make when it is run."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if "Join" in kind:
            found.append(node.metrics().apply("numOutputRows").value())
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        todo += [inner] if inner else [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_ranked_query_does_not_list_all_pairs(spark, tmp_path):
    """Four million pairs at one core; only those of the first thousand ends are made."""
    part = spark.range(3000).selectExpr("id AS p_partkey", "concat('Brand#', id) AS p_brand", "'LARGE' AS p_type", "7 AS p_size", "cast(id AS double) AS p_retailprice")
    part.write.parquet(str(tmp_path / "part.parquet"))
    found = fragment_queries.QUERIES["mmp_ranked"](spark, str(tmp_path))
    made = joined_rows(found)
    assert made and max(made) < 3_000_000
    assert [(r["a"], r["b"], r["gap"]) for r in found.collect()] == [(0, b, float(b)) for b in range(1, 1001)]


def test_matched_pairs_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "i int, t array<string>").withColumn("v", F.lit(1.0))
    node, above = pairs.matched_pairs(df, "i", "t", "v")._jdf.queryExecution().optimizedPlan(), []
    while (kind := node.getClass().getSimpleName()) != "Join":
        above.append(kind)
        node = node.children().head()
    assert {*above} <= {"Union", "Project", "Filter"}
    assert "strategy=merge" in node.hint().toString()  # no side goes whole to the driver, whatever its bytes


def test_verdicts_keep_every_row(spark):
    rules = [screen.Rule("x", "x", "g", source="one"), screen.Rule("y", "y", "g", source="two"), screen.Rule("z", "z", "g", source="two")]
    df = spark.createDataFrame([(0, "X y z"), (1, "y"), (2, ""), (3, None)], "i int, t string")
    got = {(r["i"], r["source"]): (r["matches"], r["passed"], r["all_passed"]) for r in screen.verdicts(df, F.col("t"), rules, "i").collect()}
    assert got == {
        (0, "one"): (1, False, False), (0, "two"): (2, False, False), (1, "one"): (0, True, False), (1, "two"): (1, False, False),
        (2, "one"): (0, True, True), (2, "two"): (0, True, True), (3, "one"): (0, True, True), (3, "two"): (0, True, True),
    }
    with pytest.raises(ValueError, match="indexed_hits"):
        screen.verdicts(df, F.col("t"), rules * 20, "i")


def test_duplicate_report_with_a_group_of_a_third_of_the_rows(spark, tmp_path):
    rows = [(i, "Same  text" if i % 3 == 0 else f"text {i // 2}" if i < 60 else None if i == 100 else f"own {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, t string")
    by = {}
    for i, t in rows:
        by.setdefault(i if t is None else " ".join(t.lower().split()), []).append(i)
    groups = sorted(by.values(), key=min)
    sinks.dedup_report(df, "i", "t", str(tmp_path / "report"))
    summary = {r["group_id"]: (r["representative"], r["members"], r["representative_text"]) for r in spark.read.parquet(str(tmp_path / "report/summary")).collect()}
    assert summary == {n + 1: (min(g), len(g), rows[min(g)][1]) for n, g in enumerate(groups)}
    annotated = {r["i"]: (r["group_id"], r["duplicate"]) for r in spark.read.parquet(str(tmp_path / "report/annotated")).collect()}
    assert annotated == {i: (n + 1, i != min(g)) for n, g in enumerate(groups) for i in g}
    assert dedup.annotated(df.limit(0), "i", "t").count() == 0


def test_fingerprint_matrix(spark, tmp_path):
    df = spark.createDataFrame([(1, [0, 2]), (2, []), (3, None)], "k int, bits array<int>")
    sinks.fingerprint_matrix(df, "k", "bits", 3, str(tmp_path / "bits"))
    got = {r["k"]: (r["bit_0"], r["bit_1"], r["bit_2"]) for r in spark.read.parquet(str(tmp_path / "bits")).collect()}
    assert got == {1: (1, 0, 1), 2: (0, 0, 0), 3: (None, None, None)}
