"""A line notation read token by token: open ring closures, branches and bonds held in a fold, in the engine.

A fold over a text's tokens keeps the atom that the next bond starts from, the open branches, the open ring closures and
the bond that waits for its end. Positions are code points from 0. Null texts give null, empty ones no pairs and no faults.
A text's pairs and faults are copied as references at each of them, so a text of n closures costs n * n / 2 references;
notations above the readers' 5000 characters are rejected before.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"(?s)(\[[^\[\]]*\]|%\([0-9]{1,5}\)|%[0-9]{2}|Br|Cl|.)"
# Atoms that need no bracket, and bonds.
PLAIN_ATOMS = ("B", "C", "N", "O", "P", "S", "F", "I", "Br", "Cl", "b", "c", "n", "o", "p", "s", "*")
BONDS = ("-", "=", "#", "$", ":", "/", "\\", "~")
# Classes of faults as reports name them; every other fault is a parse_error.
CLASSES = {
    "unclosed_bracket": "unmatched_bracket", "unopened_bracket": "unmatched_bracket", "unclosed_branch": "unmatched_bracket", "unopened_branch": "unmatched_bracket",
    "unclosed_ring": "ring_closure_mismatch", "ring_bonds_differ": "ring_closure_mismatch", "ring_to_itself": "ring_closure_mismatch", "ring_without_atom": "ring_closure_mismatch",
    "unknown_character": "unknown_atom_symbol", "empty_bracket": "unknown_atom_symbol",
}

_FAULTS = "array<struct<kind:string,at:int>>"
_STATE = (
    "struct<at:int,atom:int,bond:string,last:string,depth:array<struct<at:int,atom:int>>,"
    "open:array<struct<label:int,at:int,atom:int,bond:string>>,"
    f"pairs:array<struct<label:int,opened:int,closed:int,bond:string>>,faults:{_FAULTS}>"
)


def tokens(s: Column) -> Column:
    """Bracket atoms, ring closures with two and more digits and two-letter atoms whole, all else by character."""
    return F.regexp_extract_all(s, F.lit(TOKEN), F.lit(1))


def is_atom(t: Column) -> Column:
    return t.isin(*PLAIN_ATOMS) | (t.startswith("[") & (F.length(t) > 2))


def is_ring(t: Column) -> Column:
    return t.between("0", "9") & (F.length(t) == 1) | (t.startswith("%") & (F.length(t) > 1))


def _plain_bond(b: Column) -> Column:
    """A bond with a direction is a single bond where its two ends are compared."""
    return F.when(b.isin("/", "\\"), "-").otherwise(b)


def _step(s: Column, t: Column) -> Column:
    atom, ring, bond = is_atom(t), is_ring(t), t.isin(*BONDS)
    opens, closes, dot = t == "(", t == ")", t == "."
    label = F.regexp_replace(t, "[^0-9]", "").try_cast("int")
    hit = F.try_element_at(F.filter(s["open"], lambda o: o["label"] == label), F.lit(1))
    paired = ring & F.coalesce(hit["label"] == label, F.lit(False))
    inside = F.size(s["depth"]) > 0
    waiting = s["bond"] != ""
    fault = lambda kind, at=s["at"]: F.struct(F.lit(kind).alias("kind"), at.alias("at"))
    differs = (hit["bond"] != "") & waiting & (_plain_bond(hit["bond"]) != _plain_bond(s["bond"]))
    found = F.array(
        F.when(waiting & ~atom & ~ring, fault("dangling_bond", s["at"] - 1)),
        F.when(bond & (s["atom"] < 0), fault("bond_without_atom")),
        F.when(opens & (s["atom"] < 0), fault("branch_without_atom")),
        F.when(closes & ~inside, fault("unopened_branch")),
        F.when(closes & inside & (s["last"] == "("), fault("empty_branch")),
        F.when(ring & (s["atom"] < 0), fault("ring_without_atom")),
        F.when(paired & (hit["atom"] == s["atom"]) & (s["atom"] >= 0), fault("ring_to_itself")),
        F.when(paired & differs, fault("ring_bonds_differ")),
        F.when(t == "[", fault("unclosed_bracket")),
        F.when(t == "]", fault("unopened_bracket")),
        F.when(t == "[]", fault("empty_bracket")),
        F.when(~(atom | ring | bond | opens | closes | dot | t.isin("[", "]", "[]")), fault("unknown_character")),
    )
    depth = (
        F.when(opens, F.concat(s["depth"], F.array(F.struct(s["at"].alias("at"), s["atom"].alias("atom")))))
        .when(closes & inside, F.slice(s["depth"], F.lit(1), F.size(s["depth"]) - 1))
        .otherwise(s["depth"])
    )
    opened = F.struct(label.alias("label"), s["at"].alias("at"), s["atom"].alias("atom"), s["bond"].alias("bond"))
    pair = F.struct(label.alias("label"), hit["at"].alias("opened"), s["at"].alias("closed"), F.when(waiting, s["bond"]).otherwise(hit["bond"]).alias("bond"))
    return F.struct(
        (s["at"] + F.length(t)).alias("at"),
        F.when(atom, s["at"]).when(dot, F.lit(-1)).when(closes & inside, F.element_at(s["depth"], -1)["atom"]).otherwise(s["atom"]).alias("atom"),
        F.when(bond, t).otherwise("").alias("bond"),
        t.alias("last"),
        depth.alias("depth"),
        F.when(paired, F.filter(s["open"], lambda o: o["label"] != label)).when(ring, F.concat(s["open"], F.array(opened))).otherwise(s["open"]).alias("open"),
        F.when(paired, F.concat(s["pairs"], F.array(pair))).otherwise(s["pairs"]).alias("pairs"),
        F.concat(s["faults"], F.array_compact(found)).alias("faults"),
    ).cast(_STATE)


def _end(s: Column) -> Column:
    left = F.concat(
        s["faults"],
        F.transform(s["depth"], lambda d: F.struct(F.lit("unclosed_branch").alias("kind"), d["at"].alias("at"))),
        F.transform(s["open"], lambda o: F.struct(F.lit("unclosed_ring").alias("kind"), o["at"].alias("at"))),
        F.array_compact(F.array(F.when(s["bond"] != "", F.struct(F.lit("dangling_bond").alias("kind"), (s["at"] - 1).alias("at"))))),
    )
    by_place = F.array_sort(F.transform(left, lambda f: F.struct(f["at"].alias("at"), f["kind"].alias("kind"))))
    return F.struct(s["pairs"].alias("pairs"), by_place.alias("faults"))


def scanned(s: Column) -> Column:
    """Struct of pairs (label, opened, closed, bond: positions of both ends in order of closing, the bond that either end
    states) and faults (at, kind, in order of place)."""
    empty = {n: F.array().cast(t) for n, t in (("depth", "array<struct<at:int,atom:int>>"), ("open", "array<struct<label:int,at:int,atom:int,bond:string>>"), ("pairs", "array<struct<label:int,opened:int,closed:int,bond:string>>"), ("faults", _FAULTS))}
    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("atom"), F.lit("").alias("bond"), F.lit("").alias("last"), *(v.alias(n) for n, v in empty.items())).cast(_STATE)
    return F.aggregate(tokens(s), start, _step, _end)


def well_formed(s: Column) -> Column:
    """Whether a scan finds no fault; null for null."""
    return F.size(scanned(s)["faults"]) == 0


def diagnosis(s: Column, scan: Column | None = None) -> Column:
    """Of the first fault: error_type, position, and suggestions (description, corrected text if one follows, confidence).

    Null without faults. scan is the column of an earlier scan of the same text.
    """
    scan = scanned(s) if scan is None else scan
    first = F.try_element_at(scan["faults"], F.lit(1))
    kinds = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    error = F.coalesce(F.try_element_at(kinds, first["kind"]), F.lit("parse_error"))
    of = lambda kind: F.filter(scan["faults"], lambda f: f["kind"] == kind)
    missing = lambda kind: F.size(of(kind))

    def suggestion(when: Column, text: Column, corrected: Column | None, confidence: float) -> Column:
        return F.when(when, F.struct(text.alias("description"), (F.lit(None).cast("string") if corrected is None else corrected).alias("corrected"), F.lit(confidence).alias("confidence")))

    n_round, n_square, n_ring = missing("unclosed_branch"), missing("unclosed_bracket"), missing("unclosed_ring")
    brackets, ring = error == "unmatched_bracket", error == "ring_closure_mismatch"
    drop_last = F.concat(F.left(s, first["at"]), F.substring(s, first["at"] + 2, F.length(s)))
    made = F.array(
        suggestion(brackets & (n_round > 0), F.concat(F.lit("append closing brackets: "), n_round.cast("string")), F.concat(s, F.repeat(F.lit(")"), n_round)), 0.8),
        suggestion(brackets & (n_square > 0), F.concat(F.lit("append closing square brackets: "), n_square.cast("string")), F.concat(s, F.repeat(F.lit("]"), n_square)), 0.75),
        suggestion(ring & (n_ring > 0), F.concat(F.lit("closures without a partner at: "), F.array_join(F.transform(of("unclosed_ring"), lambda f: f["at"].cast("string")), ",")), None, 0.65),
        suggestion(brackets & first["kind"].isin("unopened_branch", "unopened_bracket"), F.lit("remove the closing bracket"), drop_last, 0.6),
        suggestion(error == "unknown_atom_symbol", F.lit("use atoms of the organic subset or put the symbol in square brackets"), None, 0.5),
        suggestion((error == "parse_error") | (ring & (n_ring == 0)), F.lit("compare with the rules of the notation"), None, 0.3),
    )
    return F.when(first.isNotNull(), F.struct(error.alias("error_type"), first["at"].alias("position"), F.array_compact(made).alias("suggestions")))
