"""Profiles from JSON and their table, routed lookups, differences of structs, pages of a stored order."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessel.functions import profiles
from tessel.operators import differences, lookups, pages, profile_store
from tessel.operators.differences import Field

GOOD = {"name": "x", "thresholds": {"mw": {"min": 0, "max": 500}, "LogP": {"min": -1, "max": 5}}, "weights": {"mw": 2}}
MPO = {"name": "m", "properties": [{"property": "LogP", "low": 0, "high": 5, "weight": 2, "shape": "ramp"}, {"property": "TPSA", "low": 20, "high": 140, "shape": "step"}]}


@pytest.mark.parametrize(
    ("change", "paths"),
    [
        ([], ["$"]),
        ({"name": "x"}, ["$"]),
        ({**GOOD, "properties": []}, ["$"]),
        ({**GOOD, "name": " "}, ["$.name"]),
        ({**GOOD, "more": 1}, ["$.more"]),
        ({**GOOD, "thresholds": {}}, ["$.thresholds"]),
        ({**GOOD, "thresholds": {"mw": 3}}, ["$.thresholds.mw"]),
        ({**GOOD, "thresholds": {"mw": {"min": "a", "max": True}}}, ["$.thresholds.mw.min", "$.thresholds.mw.max"]),
        ({**GOOD, "thresholds": {"mw": {"min": 5, "max": 1}, "size": {"min": 0, "max": 1}}, "weights": {}}, ["$.thresholds.mw", "$.thresholds.size"]),
        ({**GOOD, "weights": {"tpsa": 1, "mw": -1}}, ["$.weights.tpsa", "$.weights.mw"]),
        ({**GOOD, "weights": {"mw": 0, "LogP": 0}}, ["$"]),
        ({**GOOD, "weights": 7}, ["$.weights"]),
        ({"name": "m", "properties": [3, {"property": "no", "low": 0, "shape": "bow", "size": 1, "weight": None}]}, ["$.properties[0]", "$.properties[1].size", "$.properties[1].property", "$.properties[1].high", "$.properties[1].shape", "$.properties[1].weight"]),
    ],
)
def test_faults_have_paths(change, paths):
    with pytest.raises(profiles.ProfileError) as e:
        profiles.parsed(json.dumps(change))
    assert [f.path for f in e.value.faults] == paths
    with pytest.raises(profiles.ProfileError):
        profiles.parsed("{")


def test_profiles_compile_to_their_scores(spark):
    df = spark.createDataFrame([(600.0, 2.0, 50.0), (None, 2.0, 10.0)], "mw double, logp double, tpsa double")
    got = df.select(profiles.compiled(json.dumps(GOOD)).alias("p"), profiles.compiled(json.dumps(MPO)).alias("m"), profiles.components(json.dumps(MPO)).alias("c")).collect()
    assert [round(r["p"], 6) for r in got] == [round(100 * (0.8**2) ** (1 / 3), 6), 100.0]
    assert [round(r["m"], 6) for r in got] == [round(0.8 / 3, 6)] * 2
    assert [tuple(x) for x in got[0]["c"]] == [("LogP", 2.0, 0.4, 2.0, 0.8), ("TPSA", 50.0, 0.0, 1.0, 0.0)]


def test_profiles_have_versions_and_presets_stay(spark, tmp_path):
    own = profile_store.Profiles(spark, str(tmp_path / "p"))
    assert own.latest().count() == 0 and own.seed() == 8 and own.seed() == 0
    assert own.create(json.dumps(GOOD)) == 1 and own.update(json.dumps({**GOOD, "weights": {"mw": 5}})) == 2
    for bad in (lambda: own.create(json.dumps(GOOD)), lambda: own.remove("Lead-like"), lambda: own.update(json.dumps({**GOOD, "name": "Lead-like"})), lambda: own.create("{}")):
        with pytest.raises(ValueError):
            bad()
    assert own.duplicate("Lead-like", "mine") == 1 and own.duplicate("x", "y") == 1
    assert own.remove("x") == 3
    with pytest.raises(KeyError):
        own.score("x")
    with pytest.raises(KeyError):
        own.score("x", 9)
    assert {r["name"] for r in own.latest(presets=False).collect()} == {"mine", "y"} and own.latest().count() == 10
    assert own.create(json.dumps(GOOD)) == 4 and own.history().count() == 14
    first, second = spark.createDataFrame([(600.0, 2.0)], "mw double, logp double").select(own.score("x", 1), own.score("x", 2)).first()
    assert first > second


def test_lookups_go_by_type_then_name(spark):
    one = spark.createDataFrame([("CHEMBL1", "aspirin", "A"), ("CHEMBL2", "Zinc", "B"), ("CHEMBL2", "zinc", "A2")], "id string, name string, v string")
    two = spark.createDataFrame([(7, "aspirin", "C"), (8, "a#b", "D")], "cid long, name string, v string")
    sources = [lookups.Source("one", one, {"chembl_id": F.col("id"), "name": F.col("name")}, F.col("v")), lookups.Source("two", two, {"pubchem_cid": F.col("cid"), "name": F.col("name")}, F.col("v"))]
    asked = ["chembl1", " CHEMBL2 ", "CID:7", "8", "aspirin", "ASPIRIN", "a#b", "nobody", "", None, "CHEMBL9", "DB00001", "Zinc"]
    got = {r["k"]: r for r in lookups.resolved(spark.createDataFrame(list(enumerate(asked)), "k long, i string"), "k", "i", sources).collect()}
    assert [(got[k]["type"], got[k]["answer"], got[k]["source"], got[k]["found_as"]) for k in range(len(asked))] == [
        ("chembl_id", "A", "one", "chembl_id"), ("chembl_id", "A2", "one", "chembl_id"), ("pubchem_cid", "C", "two", "pubchem_cid"), ("pubchem_cid", "D", "two", "pubchem_cid"), ("name", "A", "one", "name"), ("name", "A", "one", "name"),
        ("smiles", "D", "two", "name"), ("name", None, None, None), ("name", None, None, None), ("name", None, None, None), ("chembl_id", None, None, None), ("drugbank_id", None, None, None), ("name", "A2", "one", "name"),
    ]
    assert all(got[k]["resolved"] == (got[k]["answer"] is not None) for k in got)
    assert lookups.resolved(spark.createDataFrame([], "k long, i string"), "k", "i", sources).count() == 0


def test_differences_by_declared_fields(spark):
    kind = "k int, a struct<n:int,w:double,s:string>, b struct<n:int,w:double,s:string>"
    rows = [(0, Row(n=3, w=10.0, s="x"), Row(n=5, w=8.0, s="x")), (1, Row(n=3, w=0.0, s="x"), Row(n=2, w=4.0, s="y")), (2, Row(n=None, w=1.0, s=None), Row(n=1, w=1.0, s=None)), (3, None, Row(n=1, w=1.0, s="x"))]
    fields = [Field("n", "count"), Field("n", "loss"), Field("w", "percent", 1), Field("s", "key")]
    fields[1:2] = [Field("w", "loss")]
    got = [r["d"] for r in spark.createDataFrame(rows, kind).orderBy("k").select(differences.difference(F.col("a"), F.col("b"), fields).alias("d")).collect()]
    assert [(r["n_delta"], r["n_added"], r["n_removed"], r["w_delta"], r["w_percent"]) for r in got] == [(2, 2, 0, -2.0, -20.0), (-1, 0, 1, 4.0, 0.0), (None, None, None, 0.0, 0.0), (None, None, None, None, None)]
    assert [(r["losses"], r["identical"], r["comparable"]) for r in got] == [(["w"], True, True), ([], False, True), ([], True, True), ([], False, False)]
    assert got[1]["changed"] == ["n: 3 → 2", "w: 0.0 → 4.0", "w: 0.0 → 4.0", "s: x → y"] and got[2]["changed"] == ["n: - → 1"] and got[3]["changed"] == []
    with pytest.raises(ValueError):
        Field("n", "sum")


def test_pages_of_a_stored_order_read_their_files_alone(spark, tmp_path):
    df = spark.range(2345).select((F.col("id") * 7919 % 100).alias("x"), F.col("id").alias("i"), F.lit("t").alias("t")).repartition(5)
    pages.store(df, ["x", "i"], str(tmp_path / "o"), 100)
    stored = pages.Stored(spark, str(tmp_path / "o"))
    order = sorted((i * 7919 % 100, i) for i in range(2345))
    for number, size in ((1, 10), (3, 50), (24, 100), (235, 10), (2, 130), (999, 10)):
        page = stored.page(number, size)
        rows = page.orderBy("row").collect()
        assert [(r["x"], r["i"]) for r in rows] == order[(number - 1) * size : number * size]
        assert all((r["total"], r["pages"]) == (2345, -(-2345 // size)) for r in rows)
        files = {f.rsplit("/", 2)[1] for f in page.inputFiles()}
        assert files == {f"file={k // 100}" for k in range((number - 1) * size, min(number * size, 2345))}
    with pytest.raises(ValueError):
        stored.page(0, 5)
    pages.store(df.limit(0), ["x", "i"], str(tmp_path / "e"))
    assert pages.Stored(spark, str(tmp_path / "e")).page(1, 5).count() == 0
