"""Issue rows, joins by hot keys, contradictory entries, presets that act, property names."""

import pytest
from pyspark.sql import functions as F

from tessel.operators import audit, funnel, issues, screen


def test_issue_rows_of_each_kind(spark):
    rows = [(1, "bad", False, True, None, 0, True), (2, "a", True, False, "k", 2, False), (3, "b", True, True, "k", None, True), (4, None, None, None, "k", None, None), (5, "c", True, None, None, 0, None)]
    df = spark.createDataFrame(rows, "i int, s string, ok boolean, full boolean, k string, n int, same boolean")
    got = {(r["row_index"], r["issue_type"]): (r["severity"], r["description"]) for r in issues.issue_rows(df, "i", "s", *(F.col(x) for x in ("ok", "full", "k", "n", "same"))).collect()}
    assert set(got) == {(1, "parse_failure"), (2, "undefined_stereo"), (2, "alert_hit"), (2, "std_disagreement"), (3, "duplicate"), (4, "parse_failure"), (5, "undefined_stereo"), (5, "std_disagreement")}
    assert got[2, "alert_hit"] == ("warning", "Triggered 2 structural alert(s)") and got[1, "parse_failure"] == ("critical", "SMILES could not be parsed: 'bad'")
    assert issues.issue_rows(df.limit(0), "i", "s", *(F.col(x) for x in ("ok", "full", "k", "n", "same"))).count() == 0


def test_a_hot_key_meets_its_group_by_broadcast(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id") % 2500).alias("k"))
    groups = rows.where("k IS NOT NULL").groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    got = issues.joined_by_key(rows, groups, "k", "n")
    want = rows.join(groups, "k")
    assert sorted(tuple(r) for r in got.select("k", "id", "least", "n").collect()) == sorted(tuple(r) for r in want.select("k", "id", "least", "n").collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "broadcast" in plan


def test_entries_in_order(spark):
    rows = [(0, "a", "1"), (1, "a", "50"), (2, "b", "2"), (3, "b", "200"), (4, "b", "2"), (5, "c", "1"), (6, "c", "5"), (7, None, "1"), (8, "a", "x"), (9, "a", "-1"), (10, "a", "NaN")]
    got = issues.contradictory_entries(spark.createDataFrame(rows, "i int, k string, v string"), "k", "v", "i").orderBy("place").collect()
    assert [(r["place"], r["k"], r["i"], r["fold"]) for r in got] == [(0, "b", 2, 100.0), (1, "b", 4, 100.0), (2, "b", 3, 100.0), (3, "a", 0, 50.0), (4, "a", 1, 50.0)]


@pytest.mark.parametrize(("preset", "want"), [("default", ["applied", "skipped", "applied"]), ("2d", ["applied", "applied", "applied"]), ("minimal", ["applied", "skipped", "skipped"])])
def test_curation_runs_the_presets_steps(spark, preset, want):
    df = spark.createDataFrame([(0, "C[C@H](O)[13CH3].Cl"), (1, None)], "i int, s string")
    got = {r["i"]: r for r in funnel.curated_by(df, "s", preset).collect()}
    assert [x["step"] for x in got[0]["steps"]] == list(funnel.CURATION)
    assert [x["status"] for x in got[0]["steps"] if x["step"] in funnel.NOTATION_STEPS] == want
    assert got[0]["curated"] == {"default": "C[C@H](O)[CH3]", "2d": "C[CH](O)[CH3]", "minimal": "C[C@H](O)[13CH3]"}[preset]
    assert {x["status"] for x in got[1]["steps"]} == {"skipped"} and got[1]["curated"] is None
    with pytest.raises(ValueError):
        funnel.curation_steps("other")


def test_presets_screen_their_catalogues(spark):
    rules = [screen.Rule("a", "x", "g", "warning", "PAINS"), screen.Rule("b", "x", "g", "info", "nibr"), screen.Rule("c", "y", "h", "critical", "Brenk")]
    df = spark.createDataFrame([(0, "X y"), (1, "none"), (2, None)], "i int, t string")
    counts = lambda p: [r["alerts"] for r in funnel.preset_alerts(df, "t", rules, "i", p).orderBy("i").collect()]
    assert (counts("lead_like"), counts("drug_like"), counts("fragment_like"), counts("permissive")) == ([3, 0, 0], [2, 0, 0], [1, 0, 0], [0, 0, 0])
    listed = {r["source"]: (r["rules"], r["critical"], r["concerns"]) for r in screen.catalogue_listing(screen.rule_table(spark, rules)).collect()}
    assert listed == {"PAINS": (1, 0, "g"), "nibr": (1, 0, "g"), "Brenk": (1, 1, "h")}


def test_property_names_of_two_versions(spark):
    a = spark.createDataFrame([({"x": 1, "y": None},), ({"x": 2},), (None,)], "p map<string,int>")
    b = spark.createDataFrame([({"y": 3, "z": 4},)], "p map<string,int>")
    got = {tuple(r) for r in audit.property_sets(a, b, "p").collect()}
    assert got == {("x", "removed", 2, 0), ("y", "common", 1, 1), ("z", "added", 0, 1)}
