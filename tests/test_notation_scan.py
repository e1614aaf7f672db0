"""The scan of notations against hand-written cases and against a plain reader with a stack."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessel.functions import notation_scan

# notation, pairs as (label, opened, closed), faults as (at, kind)
CASES = [
    ("", [], []),
    ("CCO", [], []),
    ("c1ccccc1", [(1, 1, 7)], []),
    ("C1CC1C1CC1", [(1, 1, 4), (1, 6, 9)], []),
    ("C12CCC1CC2", [(1, 1, 6), (2, 2, 9)], []),
    ("C%12CCCC%12", [(12, 1, 8)], []),
    ("C%01CCCC1", [(1, 1, 8)], []),
    ("C%(101)CC%(101)", [(101, 1, 9)], []),
    ("C=1CCCC=1", [(1, 2, 8)], []),
    ("C=1CCCC1", [(1, 2, 7)], []),
    ("C=1CCCC-1", [(1, 2, 8)], [(8, "ring_bonds_differ")]),
    ("C/1CCCC\\1", [(1, 2, 8)], []),
    ("C1CC", [], [(1, "unclosed_ring")]),
    ("C1CC2CC1", [(1, 1, 7)], [(4, "unclosed_ring")]),
    ("C11", [(1, 1, 2)], [(2, "ring_to_itself")]),
    ("C1(C)1", [(1, 1, 5)], [(5, "ring_to_itself")]),
    ("1CC", [], [(0, "ring_without_atom"), (0, "unclosed_ring")]),
    ("C1.C1", [(1, 1, 4)], []),
    ("CC(C)(C)C", [], []),
    ("CC(C", [], [(2, "unclosed_branch")]),
    ("CC((C", [], [(2, "unclosed_branch"), (3, "unclosed_branch")]),
    ("CC)C", [], [(2, "unopened_branch")]),
    (")C(", [], [(0, "unopened_branch"), (2, "unclosed_branch")]),
    ("C()C", [], [(2, "empty_branch")]),
    ("(C)C", [], [(0, "branch_without_atom")]),
    ("C[NH3+]", [], []),
    ("C[13C@H]1CC1", [(1, 8, 11)], []),
    ("C[NH3", [], [(1, "unclosed_bracket"), (3, "unknown_character"), (4, "unclosed_ring")]),
    ("CN]", [], [(2, "unopened_bracket")]),
    ("C[]C", [], [(1, "empty_bracket")]),
    ("CC=", [], [(2, "dangling_bond")]),
    ("C==C", [], [(1, "dangling_bond")]),
    ("C=.C", [], [(1, "dangling_bond")]),
    ("=CC", [], [(0, "bond_without_atom")]),
    ("C(=O)O", [], []),
    ("CQC", [], [(1, "unknown_character")]),
    ("C%1", [], [(1, "unknown_character"), (2, "unclosed_ring")]),
    ("BrCCl", [], []),
]


def test_hand_written_notations(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(CASES)] + [(-1, None)], "i int, s string")
    got = {r["i"]: r["x"] for r in df.select("i", notation_scan.scanned(F.col("s")).alias("x")).collect()}
    assert got.pop(-1) is None
    for i, (s, pairs, faults) in enumerate(CASES):
        assert [(p["label"], p["opened"], p["closed"]) for p in got[i]["pairs"]] == pairs, s
        assert [(f["at"], f["kind"]) for f in got[i]["faults"]] == faults, s


def plain(s):
    """Pairs and faults of branches and rings by a loop with a stack."""
    open_, stack, pairs, faults, at = {}, [], [], [], 0
    for t in re.findall(r"\[[^\[\]]*\]|%\([0-9]{1,5}\)|%[0-9]{2}|Br|Cl|.", s, re.S):
        digits = re.sub("[^0-9]", "", t) if re.fullmatch(r"[0-9]|%.+", t, re.S) else ""
        if digits:
            if int(digits) in open_:
                pairs.append((int(digits), open_.pop(int(digits)), at))
            else:
                open_[int(digits)] = at
        elif t == "(":
            stack.append(at)
        elif t == ")":
            stack.pop() if stack else faults.append((at, "unopened_branch"))
        at += len(t)
    faults += [(x, "unclosed_branch") for x in stack] + [(x, "unclosed_ring") for x in open_.values()]
    return pairs, sorted(faults)


def test_random_notations_agree_with_a_plain_reader(spark):
    pick = random.Random(7)
    texts = ["".join(pick.choice(["C", "N", "[nH]", "Br", "(", ")", "1", "2", "%12", "%(3)", "=", ".", "é", "😀", "[", "%"]) for _ in range(pick.randrange(60))) for _ in range(300)]
    texts += [texts[0], "C1" * 1500 + "(" * 400]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string").select("i", notation_scan.scanned(F.col("s")).alias("x")).collect()
    kinds = ("unopened_branch", "unclosed_branch", "unclosed_ring")
    for r in rows:
        pairs, faults = plain(texts[r["i"]])
        assert [(p["label"], p["opened"], p["closed"]) for p in r["x"]["pairs"]] == pairs
        assert [(f["at"], f["kind"]) for f in r["x"]["faults"] if f["kind"] in kinds] == faults


@pytest.mark.parametrize(
    ("text", "kind", "at", "corrected"),
    [
        ("CC(C(C", "unmatched_bracket", 2, "CC(C(C))"),
        ("CC)C", "unmatched_bracket", 2, "CCC"),
        ("C[N", "unmatched_bracket", 1, "C[N]"),
        ("C1CC", "ring_closure_mismatch", 1, None),
        ("CQ", "unknown_atom_symbol", 1, None),
        ("CC=", "parse_error", 2, None),
    ],
)
def test_diagnosis(spark, text, kind, at, corrected):
    x = spark.createDataFrame([(text,)], "s string").select(notation_scan.diagnosis(F.col("s")).alias("x")).first()["x"]
    assert (x["error_type"], x["position"], x["suggestions"][0]["corrected"]) == (kind, at, corrected)


def test_no_diagnosis_without_a_fault(spark):
    assert [r[0] for r in spark.createDataFrame([("CCO",), (None,)], "s string").select(notation_scan.diagnosis(F.col("s"))).collect()] == [None, None]
