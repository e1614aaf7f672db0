"""Previews of delimited files: columns, samples, suggestions, and rows estimated from byte ranges."""

import random

import pytest

from tessel.sources import preview


def write(tmp_path, text, name="x.csv"):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


def test_columns_have_samples_and_roles(spark, tmp_path):
    path = write(tmp_path, "Compound,My_SMILES,empty,<b>\nx1,,,1\n ,CCO" + "C" * 200 + ",,2\n")
    got = [tuple(r) for r in preview.columns(spark, path).orderBy("position").collect()]
    assert got == [(0, "Compound", "x1", "name"), (1, "My_SMILES", "CCO" + "C" * 97, "structure"), (2, "empty", None, None)]
    bare = [tuple(r) for r in preview.columns(spark, write(tmp_path, "CCO,5\nCCN,6\n", "y.csv")).orderBy("position").collect()]
    assert bare == [(0, "SMILES", "CCO", "structure"), (1, "col_1", "5", None)]
    with pytest.raises(ValueError):
        preview.columns(spark, write(tmp_path, "", "z.csv"))


def test_samples_come_from_the_first_files_by_name(spark, tmp_path):
    """Spark reads the largest file first; a file of only a header, or of few rows, is followed by the next ones."""
    folder = tmp_path / "a b%20[c]*"
    folder.mkdir()
    for n, rows in enumerate(([], [("", "CCO")], [("x1", "CCN"), ("x2", "CCS")], [(f"y{i}", "C" * 50) for i in range(200)])):
        write(folder, "".join(f"{a},{b}\n" for a, b in (("compound", "structure"), *rows)), f"part-{n}.csv")
    path = str(folder).replace("[", "\\[").replace("]", "\\]").replace("*", "\\*")
    assert [tuple(r) for r in preview.columns(spark, path).orderBy("position").collect()] == [(0, "compound", "x1", "name"), (1, "structure", "CCO", "structure")]


@pytest.mark.parametrize(("text", "rows"), [("", 0), ("a\n", 0), ("a\n1\n2", 2), ("a\r\n1\r\n2\r\n", 2), ("a\r1\r2\r", 2)])
def test_small_files_are_counted(spark, tmp_path, text, rows):
    got = preview.estimated_rows(spark, write(tmp_path, text), True)
    assert (got.rows, got.low, got.high, got.exact) == (rows, rows, rows, True)


@pytest.mark.parametrize("seed", range(6))
def test_estimates_hold_their_bounds(spark, tmp_path, seed):
    """Line lengths that grow over the file, as sorted files have them, where the first bytes alone mislead."""
    pick = random.Random(seed)
    for part in range(3):
        write(tmp_path, "smiles\n" + "".join("C" * pick.randrange(5, 20 + 60 * part + i // 100) + "\n" for i in range(12000)), f"part-{part}.csv")
    (tmp_path / "_SUCCESS").write_text("x\n" * 1000)
    got = preview.estimated_rows(spark, str(tmp_path), True, ranges=64, range_bytes=4096)
    assert not got.exact and got.bytes_read <= 64 * 4096 < got.bytes
    assert abs(got.rows - 36000) < 0.05 * 36000
    assert got.low <= 36000 <= got.high


def test_compressed_files_are_counted(spark, tmp_path):
    spark.range(1000).selectExpr("cast(id as string) as id").coalesce(1).write.option("compression", "gzip").csv(str(tmp_path / "g"), header=True)
    assert preview.estimated_rows(spark, str(tmp_path / "g"), True, exact_below=0).rows == 1000
