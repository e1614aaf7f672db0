"""What can be told from a structure's line notation alone, as column expressions: no chemistry kernel, no Python.

Atoms are brackets or organic-subset symbols. Implicit hydrogens, aromaticity and stereo need a kernel; these do not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions import notation_scan
from tessel.operators.checks import Check

ATOM = r"\[[^\]]*\]|Br|Cl|[BCNOPSFIbcnops*]"
# Counterions and solvents, as notations.
COUNTERIONS = ("Cl", "[Cl-]", "Br", "[Br-]", "[Na+]", "[K+]", "[Li+]", "I", "[I-]")
SOLVENTS = ("O", "CO", "CCO", "CC(C)=O", "CS(C)=O", "ClCCl", "CC#N")
METALS = r"\[(?:[0-9]*)(?:Li|Na|K|Mg|Ca|Al|Fe|Cu|Zn|Pt|Pd|Ni|Co|Mn|Ti|Sn|Pb|Hg|Ag|Au)"


def fragments(s: Column) -> Column:
    return F.filter(F.split(s, r"\."), lambda x: x != "")


def atoms(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(f"({ATOM})"), F.lit(1))


def heavy_atoms(s: Column) -> Column:
    """Atoms but bracketed hydrogens and dummies."""
    return F.size(F.filter(atoms(s), lambda a: ~a.rlike(r"^\[[0-9]*H[+-]?\]$") & (a != "*") & ~a.rlike(r"^\[[0-9]*\*")))


def has_carbon(s: Column) -> Column:
    return F.exists(atoms(s), lambda a: a.rlike(r"^\[[0-9]*(?:C(?![a-z])|c)") | a.isin("C", "c"))


def formal_charge(s: Column) -> Column:
    """Sum of the charges that brackets state: +, -, ++, +2 and so on."""

    def of(a: Column) -> Column:
        sign = F.regexp_extract(a, r"([+-]+)[0-9]*(?::[0-9]+)?\]$", 1)
        count = F.regexp_extract(a, r"[+-]([0-9]+)(?::[0-9]+)?\]$", 1)
        size = F.when(count != "", count.try_cast("int")).otherwise(F.length(sign))
        return F.when(sign.startswith("-"), -size).otherwise(size)

    return F.aggregate(F.filter(atoms(s), lambda a: a.startswith("[")), F.lit(0), lambda t, a: t + F.coalesce(of(a), F.lit(0)))


def ring_closures_paired(s: Column) -> Column:
    """Whether each ring closure has its partner: digits, %nn and %(n) outside brackets, told by a scan."""
    return ~F.exists(notation_scan.scanned(s)["faults"], lambda f: f["kind"] == "unclosed_ring")


def brackets_paired(s: Column) -> Column:
    count = lambda ch: F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))
    return (count("(") == count(")")) & (count("[") == count("]"))


def parent(s: Column) -> Column:
    """The fragment with most heavy atoms (the longer, then the later in order, of equals): what desalting keeps."""
    ranked = F.transform(fragments(s), lambda f: F.struct(heavy_atoms(f).alias("n"), F.length(f).alias("l"), f.alias("f")))
    return F.element_at(F.array_sort(ranked), -1)["f"]


def fragment_kind(f: Column) -> Column:
    return F.when(f.isin(*COUNTERIONS), "counterion").when(f.isin(*SOLVENTS), "solvent").when(heavy_atoms(f) >= 6, "drug").otherwise("unknown")


def without_stereo(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"@+", ""), r"[/\\]", "")


def without_isotopes(s: Column) -> Column:
    return F.regexp_replace(s, r"\[[0-9]+", "[")


def checks(column: str = "smiles") -> list[Check]:
    """The registered checks that notation alone decides."""
    s = F.col(column)
    return [
        Check("parsability", "critical", lambda: (s != "") & notation_scan.well_formed(s) & ~s.rlike("[<>\"';` ]")),
        Check("connectivity", "warning", lambda: F.size(fragments(s)) == 1),
        Check("mixture_detection", "warning", lambda: F.size(F.filter(fragments(s), lambda f: fragment_kind(f) == "drug")) <= 1),
        Check("solvent_contamination", "warning", lambda: ~F.exists(fragments(s), lambda f: f.isin(*SOLVENTS)) | (F.size(fragments(s)) == 1)),
        Check("inorganic_filter", "error", lambda: has_carbon(s)),
        Check("metal", "warning", lambda: ~s.rlike(METALS)),
        Check("isotope_label_detection", "info", lambda: ~s.rlike(r"\[[0-9]+")),
        Check("trivial_molecule", "error", lambda: heavy_atoms(s) > 3),
        Check("polymer_detection", "info", lambda: ~s.contains("*")),
        Check("charged_species", "info", lambda: formal_charge(s) == 0),
        Check("explicit_hydrogen_audit", "info", lambda: ~s.rlike(r"\[H\]")),
    ]
