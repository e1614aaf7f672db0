from pyspark.sql import functions as F

from tessel.functions import scoring, structures, text
from tessel.operators import audit, checks, dedup, export_columns, flow, funnel, neighbours, ordering, pairs, screen, stats, view


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_contradictory_labels(spark):
    df = rows(spark, [("A", "1.0"), ("A", "100.0"), ("B", "0.0"), ("B", "5"), ("C", "1"), ("C", "10"), (None, "1"), ("D", "x")], "key string, v string")
    got = [(r["key"], r["fold"]) for r in audit.contradictory_labels(df, "key", "v").collect()]
    assert got == [("A", 100.0)]


def test_dataset_diff_last_row_wins(spark):
    p = rows(spark, [("a", 1, 0), ("b", 2, 1), ("c", 3, 2), ("e", 1, 3), ("e", 2, 4)], "k string, v int, at int")
    c = rows(spark, [("b", 2, 0), ("c", 9, 1), ("d", 4, 2), ("e", 2, 3)], "k string, v int, at int")
    got = {r["k"]: (r["state"], r["changed"]) for r in audit.dataset_diff(p, c, "k", "at", ["v"]).collect()}
    assert got == {"a": ("removed", ""), "b": ("unchanged", ""), "c": ("modified", "v"), "d": ("added", ""), "e": ("unchanged", "")}


def test_property_stats_and_histogram(spark):
    df = rows(spark, [(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    r = stats.property_stats(df, ["v"]).first()
    assert (r["mean"], r["median"], round(r["std"], 4), r["q1"], r["q3"], r["iqr"]) == (4, 2.5, 4.0825, 1.75, 4.75, 3)
    assert [x["bin"] for x in stats.histogram(df, "v", 0.0, 10.0).where("n > 0").orderBy("bin").collect()] == [3, 5, 7, 20]
    assert stats.iqr_outliers(df.withColumn("g", F.lit(1)), "v", ["g"], ["v"]).count() == 1


def test_entropy_and_correlation_of_a_constant(spark):
    r = stats.entropy(rows(spark, [(2,), (1,), (1,)], "n long")).first()
    assert (r["entropy"], r["diversity"]) == (1.5, 94.6395)
    df = rows(spark, [(float(i), 1.0, float(-i)) for i in range(12)], "a double, b double, c double")
    assert [(r["a"], r["b"], r["r"]) for r in stats.pearson(df, ["a", "b", "c"]).collect()] == [("a", "c", -1.0)]


def test_score_of_failed_checks(spark):
    df = rows(spark, [(1,)], "x int")
    made = [checks.Check("e", "error", lambda: F.col("x") > 1), checks.Check("w", "warning", lambda: F.col("x") > 1), checks.Check("i", "info", lambda: F.lit(None).cast("boolean"))]
    got = checks.checked(df, made)
    assert got.first()["score"] == 75 and checks.issues(got, "x").count() == 3
    assert checks.checked(df, made, only=["w", "unknown"]).first()["score"] == 95


def test_desirability_and_profile_without_a_property(spark):
    df = rows(spark, [(600.0, None), (300.0, 7.0)], "mw double, logp double")
    got = df.select(F.round(scoring.desirability(F.col("mw"), 200.0, 500.0), 4).alias("d"), scoring.profile_score({"mw": (200.0, 500.0), "logp": (0.0, 5.0)}, {}).alias("p")).collect()
    assert got[0]["d"] == 0.6667 and round(got[0]["p"], 2) == 66.67 and round(got[1]["p"], 2) == round((0.6**0.5) * 100, 2)


def test_identifiers_and_layers(spark):
    ids = ["CHEMBL25", "DB00945", "CHEBI:15365", "50-78-2", "2244", "InChI=1S/x", "BSYNRYMUTXBXSQ-UHFFFAOYSA-N", "aspirin", "", "CC(=O)O"]
    got = [r[0] for r in rows(spark, [(i,) for i in ids], "t string").select(text.identifier_type(F.col("t"))).collect()]
    assert got == ["chembl_id", "drugbank_id", "chebi_id", "cas", "pubchem_cid", "inchi", "inchikey", "name", "name", "smiles"]
    r = rows(spark, [("InChI=1S/C2H6O/c1-2-3/h3H,2H2,1H3/h2",)], "t string").select(text.layers(F.col("t")).alias("m"), text.without_layers(F.col("t"), "hm").alias("s")).first()
    assert r["m"] == {"formula": "C2H6O", "c": "1-2-3", "h": "2"} and r["s"] == "InChI=1S/C2H6O/c1-2-3"


def test_dedup_levels_and_annotation(spark):
    df = rows(spark, [(0, "x"), (1, "y"), (2, " X"), (3, "x"), (4, None)], "i long, t string")
    got = {r["i"]: (r["group_id"], r["representative"], r["members"], r["duplicate"]) for r in dedup.annotated(df, "i", "t").collect()}
    assert got == {0: (1, 0, 3, False), 1: (2, 1, 1, False), 2: (1, 0, 3, True), 3: (1, 0, 3, True), 4: (3, 4, 1, False)}
    totals = {r["level"]: r["unique_rows"] for r in dedup.level_totals(df, "i", "t").collect()}
    assert totals == {"exact": 3, "normalized": 2, "words": 2, "letters": 2}


def test_funnel_counts_only_survivors_as_duplicates(spark):
    df = rows(spark, [(0, 300.0, "a", True), (1, 300.0, "a", True), (2, 900.0, "a", True), (3, 300.0, "b", False)], "i long, mw double, key string, ok boolean").selectExpr("*", "1D as logp", "50D as tpsa", "1 as rotb", "1 as rings", "2D as sa")
    got = funnel.filtered(df, funnel.PRESETS["drug_like"], F.col("ok"), F.lit(True), F.lit(0), ["key"], "i")
    assert {r["i"]: r["stage"] for r in got.collect()} == {0: None, 1: "dedup", 2: "property", 3: "parse"}
    assert {r["i"]: r["reason"] for r in got.collect()} == {0: None, 1: "Duplicate of row 1", 2: "mw", 3: "not parsed"}
    assert [(r["n_in"], r["n_passed"]) for r in funnel.stage_counts(got).orderBy("stage_index").collect()] == [(4, 3), (3, 3), (3, 3), (3, 2), (2, 2), (2, 1)]


def test_sparse_pairs_and_clusters_match_all_pairs(spark):
    import random

    rng = random.Random(3)
    sets = {i: frozenset(rng.sample(range(24), rng.randint(0, 9))) for i in range(80)}
    df = rows(spark, [(i, sorted(s)) for i, s in sets.items()], "i long, bits array<int>")
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5 and sets[a] & sets[b]}
    assert {(r["a"], r["b"]) for r in pairs.sparse_pairs(df, "i", "bits", 0.5).collect()} == want
    assert pairs.sphere_clusters(df, "i", pairs.sparse_pairs(df, "i", "bits", 0.5)).count() == 80
    dense = df.select("i", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: F.when(F.array_contains("bits", k), 1.0).otherwise(-1.0)).alias("v"))
    assert {(r["a"], r["b"]) for r in neighbours.dense_pairs(dense, "i", "v", 0.5).collect()} == want


def test_sparse_pairs_over_all_parts_and_crowded_keys(spark):
    import random

    from tessel.plans import pair_queries

    by_pair = lambda sets, t: {(a, b): round(len(x & y) / len(x | y), 6) for a, x in sets.items() for b, y in sets.items() if a < b and x & y and len(x & y) / len(x | y) >= t}
    found = lambda df: {(r["a"], r["b"]): r["similarity"] for r in df.collect()}
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()
    words = {r["p_partkey"]: {*r["p_name"].split(" "), *r["p_brand"].split(" "), *r["p_type"].split(" "), f"s{r['p_size'] // 10}"} for r in parts}
    want = by_pair(words, 0.6)
    assert any(a % 8 or b % 8 for a, b in want) and found(pair_queries.QUERIES["sparse_sets"](spark, "/root/testdata/sf0.001")) == want
    rng = random.Random(4)
    sets = {i: set(rng.sample(range(12), rng.randint(1, 6))) for i in range(120)} | {i: set(range(k)) for i, k in ((200, 20), (201, 11))}
    df = rows(spark, [(i, sorted(s)) for i, s in sets.items()], "i long, bits array<int>")
    for threshold in (0.3, 0.55, 0.7):
        for couples in (False, True):
            assert found(pairs.sparse_pairs(df, "i", "bits", threshold, couples, most=5)) == by_pair(sets, threshold)


def test_short_sets_meet_only_where_they_are_similar(spark):
    """Joins that make next to no rows but the pairs, with copies of each set too."""
    from tessel.plans import pair_queries
    from tests.test_fragments import joined_rows

    rule = "spark.sql.optimizer.excludedRules"  # else conditions are part of the joins, which then tell matches only
    spark.conf.set(rule, "org.apache.spark.sql.catalyst.optimizer.PushDownPredicates")
    try:
        made = max(joined_rows(pair_queries.QUERIES["sparse_sets"](spark, "/root/testdata/sf0.01")))
    finally:
        spark.conf.unset(rule)
    assert made < 30_000  # 2000 parts have 1958 pairs
    rng = random_sets(spark, 5)
    copied = rng.crossJoin(spark.range(12).withColumnRenamed("id", "copy")).select((F.col("i") * 12 + F.col("copy")).alias("i"), "bits", F.col("i").alias("of"))
    alone = {(r["a"], r["b"]): r["similarity"] for r in pairs.sparse_pairs(rng, "i", "bits", 0.6, couples=True).collect()}
    found = pairs.sparse_pairs(copied.orderBy(F.desc("i")), "i", "bits", 0.6, couples=True, most=5)
    want = {(x * 12 + i, y * 12 + j): s for (x, y), s in alone.items() for i in range(12) for j in range(12)} | {(x * 12 + i, x * 12 + j): 1.0 for x in range(40) for i in range(12) for j in range(i + 1, 12)}
    got = [((r["a"], r["b"]), r["similarity"]) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == want


def random_sets(spark, seed):
    import random

    pick = random.Random(seed)
    return rows(spark, [(i, sorted(pick.sample(range(14), pick.randint(1, 12)))) for i in range(40)], "i long, bits array<int>")


def test_matched_pairs_over_all_parts_and_crowded_cores(spark):
    from tessel.plans import pair_queries

    def by_pair(sets):
        out = {}
        for a, (x, v) in sets.items():
            for b, (y, u) in sets.items():
                at = [i for i, (s, t) in enumerate(zip(x, y, strict=True)) if s != t]
                if a < b and len(at) == 1:
                    out[a, b] = (" ".join("*" if i == at[0] else t for i, t in enumerate(x)), x[at[0]], y[at[0]], round(abs(v - u), 4))
        return out

    found = lambda df: {(r["a"], r["b"]): (r["core"], r["a_token"], r["b_token"], r["gap"]) for r in df.collect()}
    parts = {r["p_partkey"]: ([r["p_brand"], r["p_type"], str(r["p_size"])], r["p_retailprice"]) for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    want = by_pair(parts)
    assert any(a % 4 or b % 4 for a, b in want) and found(pair_queries.QUERIES["mmp_pairs"](spark, "/root/testdata/sf0.001")) == want
    crowded = {i: ([str(i % 3), "x", str(i % 17)], float(i)) for i in range(90)}
    df = rows(spark, [(i, t, v) for i, (t, v) in crowded.items()], "i long, t array<string>, v double")
    assert found(pairs.matched_pairs(df, "i", "t", "v", most=4)) == by_pair(crowded)


def test_sphere_clusters_match_the_greedy_order_without_a_cap(spark):
    import random

    def greedy(points, met):
        near = {p: set() for p in points}
        for a, b in met:
            near[a].add(b)
            near[b].add(a)
        of = {}
        for p in sorted(points, key=lambda p: (-len(near[p]), p)):
            if p not in of:
                of |= {q: p for q in near[p] if q not in of} | {p: p}
        return of

    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(6000, 6012)]
    met = sorted({tuple(sorted(rng.sample(range(300), 2))) for _ in range(700)} | {(400, i) for i in range(401, 430)} | {(429, 430)}) + chain
    points = range(6100)
    df = spark.range(6100).withColumnRenamed("id", "i")
    got = pairs.sphere_clusters(df, "i", rows(spark, met, "a long, b long")).collect()
    assert len(got) == 6100 and {r["i"]: r["centroid"] for r in got} == greedy(points, met)
    assert pairs.sphere_clusters(df, "i", rows(spark, [], "a long, b long")).where("i = centroid").count() == 6100


def test_pages_and_index_lists(spark):
    df = rows(spark, [(i, float(i // 2) if i else None) for i in range(7)], "i long, s double")
    got = view.page(df, F.col("s"), "i", 1, 3, True).collect()
    assert [r["i"] for r in got] == [6, 4, 5] and got[0]["pages"] == 3 and got[0]["total"] == 7
    assert rows(spark, [("0, 1,x,5",), ("x",)], "t string").select(view.parsed_indices(F.col("t"))).collect()[0][0] == [0, 1, 5]


def test_structures_by_notation(spark):
    cases = [
        ("CC(=O)Oc1ccccc1C(=O)O", 1, 13, 0, True, True),
        ("CC(=O)[O-].[Na+]", 2, 5, 0, True, True),
        ("[NH4+].[Cl-]", 2, 2, 0, False, True),
        ("C1CC", 1, 3, 0, True, False),
        ("[2H]C([2H])O", 1, 2, 0, True, True),
        ("[Fe+2]", 1, 1, 2, False, True),
        ("[O--]", 1, 1, -2, False, True),
        ("ClCBr", 1, 3, 0, True, True),
        ("*CC", 1, 2, 0, True, True),
    ]
    s = F.col("smiles")
    df = rows(spark, [(c[0],) for c in cases], "smiles string")
    got = df.select("smiles", F.size(structures.fragments(s)), structures.heavy_atoms(s), structures.formal_charge(s), structures.has_carbon(s), structures.ring_closures_paired(s)).collect()
    assert [tuple(r) for r in got] == cases
    assert rows(spark, [("CC(=O)[O-].[Na+]",)], "smiles string").select(structures.parent(s)).first()[0] == "CC(=O)[O-]"
    failed = {(r["smiles"], r["name"]) for r in checks.issues(checks.checked(df, structures.checks()), "smiles").collect()}
    assert ("C1CC", "parsability") in failed and ("[NH4+].[Cl-]", "inorganic_filter") in failed and ("[2H]C([2H])O", "isotope_label_detection") in failed and ("CC(=O)Oc1ccccc1C(=O)O", "parsability") not in failed


# --- rules against values worked out by hand


def values(spark, column, rows_, schema):
    return [r[0] for r in rows(spark, [(i, *r) for i, r in enumerate(rows_)], f"_i long, {schema}").orderBy("_i").select(column.alias("v")).collect()]


def test_sources_agree_by_the_first_fourteen_characters(spark):
    a, b, z = "ABCDEFGHIJKLMN-OPQ-R", "ABCDEFGHIJKLMN-XYZ-R", "ABCDEFGHIJKLMX-OPQ-R"
    df = rows(spark, [(1, "x", a), (1, "y", a), (2, "x", a), (2, "y", b), (3, "x", a), (3, "y", z), (4, "x", a), (4, "y", None)], "k long, source string, value string")
    assert {r["k"]: r["verdict"] for r in audit.compared_sources(df, "k").collect()} == {1: "consistent", 2: "minor", 3: "major", 4: "no_data"}


def test_aggregation_risk_has_six_factors(spark):
    at = [(4.5, 30.0, 4, 600.0, 26.0, 0), (3.5, 50.0, 3, 400.0, 40.0, 1), (1.0, 90.0, 0, 300.0, 20.0, 0), (5.0, 10.0, 5, 900.0, 30.0, 3)]
    schema = "logp double, tpsa double, arom int, mw double, heavy double, scaffolds int"
    got = rows(spark, at, schema).select(*(v.alias(n) for n, v in scoring.aggregator_risk(F.col("scaffolds")).items()), "mw").collect()
    assert {r["mw"]: (r["risk"], r["likelihood"], r["confidence"]) for r in got} == {600.0: (0.95, "high", 0.83), 400.0: (0.45, "moderate", 0.5), 300.0: (0.0, "low", 0.0), 900.0: (1.0, "high", 1.0)}


def test_likeness_points_density_and_bands(spark):
    at = [(0.4, 0.3, 0.0, 0, 0.5, 3, 400.0), (0.7, 0.6, 0.4, 5, 0.1, 0, 100.0), (0.0, 0.0, 0.0, 0, 0.3, 1, 175.0)]
    schema = "ring_share double, oxygen_share double, nitrogen_share double, halogens int, fsp3 double, chiral int, mw double"
    assert values(spark, scoring.likeness(), at, schema) == [3.0, -2.4, 0.75]  # 2.3, -1.6 and 0.5 times 1.5, within 3
    assert values(spark, scoring.likeness_band(F.col("x")), [(2.0,), (1.0,), (0.3,), (-0.3,), (-1.0,), (-2.0,), (-2.1,)], "x double") == ["strongly natural", "natural", "moderately natural", "mixed", "moderately synthetic", "synthetic", "strongly synthetic"]
    assert values(spark, scoring.density_points(F.col("on"), F.lit(1000)), [(5,), (10,), (300,), (375,), (450,), (600,)], "on int") == [2.5, 5.0, 5.0, 2.5, 0.0, 0.0]


def test_radar_bands_and_reference(spark):
    assert values(spark, scoring.radar_band(F.col("x")), [(6,), (5,), (4,), (3,), (2,), (1,)], "x int") == ["excellent", "good", "good", "moderate", "moderate", "poor"]
    df = rows(spark, [(7, 2.5, 350.0, 75.0, 0.35, 5, 0, 20.0)], "k long, logp double, mw double, tpsa double, fsp3 double, rotb int, arom int, heavy double")
    both = {r["is_reference"]: r for r in scoring.radar_comparison(df, "k").collect()}
    assert both[True]["k"] is None and all(both[True][a] == 1.0 for a in scoring.RADAR_AXES) and both[False]["k"] == 7


def test_names_formats_keys_and_severities(spark):
    t = "t string"
    assert values(spark, text.notation_or_name(F.col("t")), [("C(=O)O",), ("acetic acid",), ("aspirin",), ("2-methyl-propane",), ("CCO",), ("",), ("propan-2-ol",)], t) == ["smiles", "iupac", "iupac", "ambiguous", "ambiguous", "ambiguous", "iupac"]
    assert values(spark, text.format_of(F.col("t")), [("InChI=1S/CH4",), ("a\nb",), ("x M  END",), (" CCO ",), ("",), (None,)], t) == ["inchi", "mol", "mol", "smiles", "unknown", "unknown"]
    assert values(spark, text.column_name_ok(F.col("t")), [("a b",), ("x" * 257,), ("a;b",), ("a`b",), ("a\\b",), ("a/b",), ("",), (None,)], t) == [True, False, False, False, False, False, False, False]
    assert values(spark, text.severity_of(F.col("t")), [("Beta_Lactam_A",), ("quinone",)], t) == ["critical", "warning"]
    got = values(spark, text.piped(F.col("t")), [("NIBR|| name ||2||0||0",), ("NIBR||n||0",), ("NIBR||n||x",), ("plain",), ("a||b",)], t)
    assert [tuple(g) for g in got] == [("name", "critical"), ("n", "info"), ("n", "warning"), ("plain", "warning"), ("a||b", "warning")]
    import hashlib

    want = "batch:view:7:" + hashlib.md5(b"success|None|score").hexdigest()[:12]
    assert values(spark, text.view_key(F.lit("7"), F.lit("success"), F.lit(None), F.lit("score")), [("",)], t) == [want]


def test_curation_filter_and_duplicates(spark):
    df = rows(spark, [(2, 30.0, True), (101, 900.0, True), (20, 1500.5, True), (20, 200.0, False), (20, 1500.0, True)], "heavy int, mw double, carbon boolean")
    got = [r[0] for r in df.select(funnel.composition_reason()).collect()]
    assert got == ["Too few heavy atoms: 2 < 3 (minimum)", "Too many heavy atoms: 101 > 100 (maximum)", "Molecular weight too high: 1500.5 > 1500.0 (maximum)", "No carbon atoms found (inorganic molecule rejected)", None]
    df = rows(spark, [(0, "a", False), (1, "a", True), (2, "a", True), (3, None, True)], "i long, k string, ok boolean")
    assert {r["i"]: (r["status"], r["reason"]) for r in funnel.first_kept(df, F.col("ok"), "k", "i").collect()} == {0: ("rejected", None), 1: ("ok", None), 2: ("duplicate", "Duplicate of molecule 1 (index 1)"), 3: ("ok", None)}
    assert "stereo" in funnel.CURATION_PRESETS["2d"] and "stereo" not in funnel.CURATION_PRESETS["3d"] and funnel.CURATION_PRESETS["minimal"] == ("desalt", "normalize")


def test_sort_keys_keep_ties_in_order(spark):
    df = rows(spark, [(0, "b", None), (1, "B", 2.0), (2, None, 2.0)], "index long, name string, score double")
    order = lambda name, down: [r["index"] for r in view.sorted_page(df, name, "index", 1, 9, down).collect()]
    assert order("name", False) == [2, 0, 1] and order("name", True) == [0, 1, 2] and order("score", True) == [1, 2, 0] and order("score", False) == [0, 1, 2]


def test_rules_in_a_table_are_the_rules(spark):
    rules = [screen.Rule(f"r{i}", f"w{i}$", "g", "critical" if i % 2 else "info") for i in range(7)]
    df = rows(spark, [(i, f"x w{i}") for i in range(9)], "i long, t string")
    plain = {tuple(r) for r in screen.hits(df, F.col("t"), rules, "i").collect()}
    assert {tuple(r) for r in screen.table_hits(df, F.col("t"), screen.rule_table(spark, rules), "i").collect()} == plain and len(plain) == 7
    assert screen.hits(df, F.col("t"), rules * 100, "i").count() == 700


def test_quantiles_and_numbers_are_exact(spark):
    import random

    import numpy as np

    rng = random.Random(5)
    data = [(rng.choice("abc"), rng.choice([None, *range(40)])) for _ in range(500)] + [("d", 3), ("e", None)]
    df = rows(spark, data, "g string, v int").repartition(4)
    got = {r["g"]: (r["n"], list(r["q"])) for r in ordering.quantiles(df, ["g"], "v", (0.25, 0.5, 0.9)).collect()}
    for g in "abcd":
        own = [v for h, v in data if h == g and v is not None]
        assert got[g][0] == len(own) and np.allclose(got[g][1], np.quantile(own, [0.25, 0.5, 0.9]))
    assert "e" not in got
    numbers = ordering.numbered(df.where("v is not null").withColumn("id", F.monotonically_increasing_id()), ["v", "id"], "n").orderBy("n").collect()
    assert [r["n"] for r in numbers] == list(range(len(numbers))) and [r["v"] for r in numbers] == sorted(r["v"] for r in numbers)


def test_coordinates_are_projections(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 1, 1]
    got = pairs.coordinates(rows(spark, [(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(3), "i", "v").orderBy("i").collect()
    _, s, ways = np.linalg.svd(x - x.mean(0))
    for k in (0, 1):
        want = (x - x.mean(0)) @ (ways[k] * np.sign(ways[k][np.abs(ways[k]).argmax()]))
        assert np.allclose([r[f"pc{k + 1}"] for r in got], want, atol=1e-3)


def test_export_columns_and_flow(spark):
    df = rows(spark, [(1, 0.0, 5.0, True), (2, 2.0, 5.0, None), (3, None, None, False)], "k long, a double, b double, ok boolean")
    declared = [export_columns.Declared("s", "v", "a|b", "either"), export_columns.Declared("s", "ok", "ok", "verdict"), export_columns.Declared("t", "a", "a")]
    assert sorted(tuple(r) for r in export_columns.flat_rows(df, declared, "k").collect()) == [(1, "5.0", "Pass", "0.0"), (2, "2.0", "N/A", "2.0"), (3, "", "Fail", "N/A")]
    assert export_columns.nested_rows(df, declared, "k").schema["s"].dataType.names == ["v", "ok"]
    assert {(r["header"], r["present"], r["passed"], r["failed"]) for r in export_columns.totals(df, declared).collect()} == {("v", 3, 0, 0), ("ok", 2, 1, 1), ("a", 2, 0, 0)}
    checked = flow.processed(df, flow.Options([checks.Check("ok", "error", lambda: F.col("ok"))], rules=[screen.Rule("Five", "5", "g", source="n")], text="k"))
    assert [r["score"] for r in checked.orderBy("k").collect()] == [100, 80, 80]
