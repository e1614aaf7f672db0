from tessel.sources import content, delimited, sdf, sinks

RECORD = "mol\n  made\n\n  2  1  0  0  0  0            999 V2000\n    0.0 0.0 0.0 C\n    1.0 0.0 0.0 O\n  1  2  1  0\nM  END\n> <activity>\n5.5\n\n> <note>\ntwo words\n\n> <note>\nlast\n\n$$$$\n"


def write(tmp_path, text, name="x.csv"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_header_and_delimiter_are_sniffed(spark, tmp_path):
    got = delimited.sniff(spark, write(tmp_path, "\nSMILES\tName,x\nCCO\teth,1\n"))
    assert (got.delimiter, got.header, got.columns) == ("\t", True, ("SMILES", "Name,x"))
    got = delimited.sniff(spark, write(tmp_path, "CCO,a\nCCN,b\n", "y.csv"))
    assert (got.header, got.columns) == (False, ("SMILES", "col_1"))


def test_bad_rows_stay_with_an_error(spark, tmp_path):
    path = write(tmp_path, "id,smiles,activity\n1,CCO,5\n2,,6\n3,C<script>,7\n4,CCN,8\n")
    rows = delimited.read(spark, path, properties=True).orderBy("index").collect()
    assert [(r["index"], r["smiles"], r["parse_error"]) for r in rows] == [(0, "CCO", None), (1, "", "empty"), (2, "", "invalid characters"), (3, "CCN", None)]
    assert rows[0]["name"] == "1" and rows[0]["properties"]["activity"] == "5"


def test_default_names_and_prevalidation(spark, tmp_path):
    path = write(tmp_path, "SMILES,x,X\nCCO,1,2\n,1,2\n")
    assert delimited.read(spark, path).orderBy("index").first()["name"] == "row_0"
    issues = {r["issue"]: r["detail"] for r in delimited.prevalidated(spark, path).collect()}
    assert issues == {"duplicate_header": "x: 1,2", "empty_rows": "1"}


def test_numeric_columns_by_preference(spark):
    df = spark.createDataFrame([("1", "a", "2.5"), ("2", "3", "x"), ("3", "b", "4")] * 3, "b string, name string, activity string").where("activity <> 'x'")
    assert delimited.numeric_columns(df, ["b", "name", "activity"]) == ["activity", "b"]


def test_records_round_trip(spark, tmp_path):
    path = write(tmp_path, RECORD + RECORD.replace("M  END\n", "").replace("mol\n", "\n"), "x.sdf")
    rows = sdf.read(spark, path).orderBy("index").collect()
    assert [(r["name"], r["n_atoms"], r["n_bonds"]) for r in rows] == [("mol", 2, 1), ("mol_1", 2, 1)]
    assert rows[0]["properties"] == {"activity": "5.5", "note": "last"} and rows[1]["parse_error"]
    out = str(tmp_path / "out")
    sinks.export(sdf.read(spark, path), out, "sdf")
    again = sdf.read(spark, out).where("name = 'mol'").first()
    assert again["properties"] == rows[0]["properties"] and again["n_atoms"] == 2
    assert sdf.columns(sdf.read(spark, path)) == ["activity", "note"]


def test_uploads_are_inspected(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SMILES\nCCO\n")
    (tmp_path / "b.csv").write_bytes(b"MZ\x00\x01")
    (tmp_path / "c.csv").write_text("<script>x</script>")
    got = {r["path"][-5]: (r["signature"], r["findings"], r["valid"]) for r in content.inspected(spark, str(tmp_path), "csv").collect()}
    assert got == {"a": (None, "", True), "b": ("windows executable", "null byte", False), "c": (None, "script tag", False)}


def test_records_are_prevalidated_with_their_lines(spark, tmp_path):
    bad = RECORD.replace("M  END\n", "").replace("  2  1  0  0  0  0            999 V2000", "")
    path = write(tmp_path, RECORD + bad + RECORD, "y.sdf")
    got = sorted((r["index"], r["line"], r["issue"]) for r in sdf.prevalidated(spark, path).collect())
    n = RECORD.count("\n")
    assert got == [(1, n + 1, "malformed_counts"), (1, n + 1, "missing_end")]
