"""Identifiers, layered strings, delimiters and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns in order; the first that matches decides.
IDENTIFIERS = [
    ("inchi", r"(?i)^InChI="),
    ("inchikey", r"^[A-Z]{14}-[A-Z]{10}-[A-Z]$"),
    ("chembl_id", r"(?i)^CHEMBL[0-9]+$"),
    ("drugbank_id", r"(?i)^DB[0-9]{5}$"),
    ("chebi_id", r"(?i)^CHEBI:[0-9]+$"),
    ("cas", r"^[0-9]{2,7}-[0-9]{2}-[0-9]$"),
    ("pubchem_cid", r"(?i)^(?:CID:)?[0-9]+$"),
    ("wikipedia", r"(?i)wikipedia\.org/wiki/"),
    ("unii", r"^[A-Z0-9]{10}$"),
    ("smiles", r"[()\[\]=#@/\\]"),
]


def identifier_type(text: Column) -> Column:
    """Type of an identifier; what no pattern matches is a name."""
    t = F.trim(text)
    out = F.lit("name")
    for name, pattern in reversed(IDENTIFIERS):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return F.when(t == "", "name").otherwise(out)


def layers(text: Column) -> Column:
    """Map of a layered string's layers: parts after the first slash by first letter, capitals and digits as formula; last wins."""
    parts = F.filter(F.slice(F.split(text, "/"), F.lit(2), F.size(F.split(text, "/"))), lambda p: p != "")
    keyed = F.transform(parts, lambda p: F.struct(F.when(F.substring(p, 1, 1).rlike("[A-Z0-9]"), F.lit("formula")).otherwise(F.substring(p, 1, 1)).alias("k"), F.when(F.substring(p, 1, 1).rlike("[A-Z0-9]"), p).otherwise(p.substr(F.lit(2), F.length(p))).alias("v")))
    last = F.filter(keyed, lambda x, i: ~F.exists(F.slice(keyed, i + 2, F.greatest(F.size(keyed), F.lit(1))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def without_layers(text: Column, letters: str) -> Column:
    """The layered string without layers that start with one of the letters."""
    return F.array_join(F.filter(F.split(text, "/"), lambda p: ~F.substring(p, 1, 1).isin(*letters)), "/")


def sanitized(text: Column, most: int) -> Column:
    """Control characters but line feed, tab and return removed; the first `most` characters."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), 1, most)


def tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def unbalanced(text: Column) -> Column:
    """Brackets that do not pair: round, square, or a ring digit used an odd number of times."""
    count = lambda ch: F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))
    return F.when(count("(") != count(")"), "round").when(count("[") != count("]"), "square").otherwise("ok")


# Endings of systematic names, characters of notations, words that make a pattern critical.
NAME_ENDINGS = ("-yl", "-ane", "-ol", "-ene", "-yne", "acid", "-one", "-al", "-amine", "-amide", "-ester", "-ether", "-oxy", "-oic", "-ic", "-ous", "-ate", "-ide", "-ite")
NOTATION = r"[()\[\]=#@/\\]"
CRITICAL_WORDS = ("azide", "diazo", "nitroso", "nitrogen_mustard", "epoxide", "acyl_halide", "acyl_fluoride", "acyl_chloride", "isocyanate", "isothiocyanate", "aziridine", "beta_lactam", "peroxide", "aldehyde", "phosphorane")
SEVERITY_CODES = ("info", "warning", "critical")


def notation_or_name(text: Column) -> Column:
    """smiles, iupac or ambiguous, by the characters of a trimmed text."""
    t = F.trim(text)
    name = t.contains(" ") | F.lower(t).rlike("(?:" + "|".join(NAME_ENDINGS) + ")$") | t.rlike("^[a-zA-Z][a-zA-Z0-9,-]*-[a-zA-Z0-9,-]*$") | t.rlike("^[a-zA-Z]{4,}$")
    return F.when(t.rlike(NOTATION), "smiles").when(name, "iupac").otherwise("ambiguous")


def format_of(text: Column) -> Column:
    """inchi, mol or smiles, by the marks of a trimmed text; unknown for null and empty ones."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").when(t.startswith("InChI="), "inchi").when(t.contains("M  END") | F.left(t, F.lit(50)).contains("\n"), "mol").otherwise("smiles")


def column_name_ok(name: Column) -> Column:
    return F.coalesce((F.length(name).between(1, 256)) & ~name.rlike("[<>\"'\\\\/;`]"), F.lit(False))


def severity_of(name: Column) -> Column:
    return F.when(F.lower(name).rlike("|".join(CRITICAL_WORDS)), "critical").otherwise("warning")


def view_key(job: Column, *parts: Column) -> Column:
    """Cache key of a filtered and sorted view: twelve digits of the hash of its parameters, missing ones as None."""
    shown = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.concat(F.lit("batch:view:"), job, F.lit(":"), F.left(F.md5(shown), F.lit(12)))


def piped(description: Column) -> Column:
    """Name and severity of a description set||name||code||...; without a code the whole text, a bad code as 1."""
    parts = F.split(description, r"\|\|")
    full = F.size(parts) >= 3
    code = F.coalesce(F.trim(F.try_element_at(parts, F.lit(3))).try_cast("int"), F.lit(1))
    severity = F.coalesce(F.try_element_at(F.array(*(F.lit(s) for s in SEVERITY_CODES)), F.when(code >= 0, code + 1).otherwise(2)), F.lit("warning"))
    return F.struct(F.when(full, F.trim(F.try_element_at(parts, F.lit(2)))).otherwise(description).alias("name"), F.when(full, severity).otherwise("warning").alias("severity"))
