"""Scoring profiles and multi-parameter scores from JSON documents: validated, with every fault by its path, then compiled to
column expressions.

A profile has thresholds by property ({"mw": {"min": 0, "max": 500}}) and weights; a multi-parameter score has a list of
properties ({"property": "LogP", "low": 0, "high": 5, "shape": "sigmoid", "weight": 2}). A null descriptor is left out of a
profile's score and makes a multi-parameter score null.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions import scoring

#: Columns by the lower-case names that documents have for them.
PROPERTIES = {"mw": "mw", "logp": "logp", "tpsa": "tpsa", "hbd": "hbd", "hba": "hba", "rotbonds": "rotb", "rotatable_bonds": "rotb", "fsp3": "fsp3", "qed": "qed", "sa": "sa", "numrings": "rings", "rings": "rings", "heavyatoms": "heavy", "num_atoms": "heavy", "refractivity": "mr", "aromatic_rings": "arom"}
SHAPES = ("sigmoid", "ramp", "step")
FIELDS = {"thresholds": {"name", "description", "thresholds", "weights"}, "properties": {"name", "description", "properties"}}
PART = {"property", "low", "high", "shape", "weight"}
# Profiles that every table of profiles has, as (low, high) by property; all weights are 1.
PRESETS = {
    "Drug-like (Lipinski)": {"mw": (0, 500), "logp": (-5, 5), "hbd": (0, 5), "hba": (0, 10)},
    "Lead-like": {"mw": (200, 450), "logp": (-1, 4), "rotatable_bonds": (0, 7)},
    "Fragment-like (Rule of 3)": {"mw": (0, 300), "logp": (-3, 3), "hbd": (0, 3), "hba": (0, 3), "rotatable_bonds": (0, 3)},
    "CNS-penetrant": {"mw": (0, 400), "logp": (1, 5), "tpsa": (0, 90), "hbd": (0, 2)},
    "Ghose (Amgen)": {"mw": (160, 480), "logp": (-0.4, 5.6), "num_atoms": (20, 70), "refractivity": (40, 130)},
    "Veber (GSK)": {"rotatable_bonds": (0, 10), "tpsa": (0, 140)},
    "PPI-like": {"mw": (400, 800), "logp": (2, 6), "rotatable_bonds": (5, 15)},
    "NP-like": {"mw": (200, 800), "rotatable_bonds": (0, 10), "hbd": (0, 5), "rings": (2, 20)},
}


@dataclass(frozen=True)
class Fault:
    path: str
    message: str


class ProfileError(ValueError):
    def __init__(self, faults: list[Fault]):
        self.faults = faults
        super().__init__("; ".join(f"{f.path}: {f.message}" for f in faults))


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def _range(at: str, value: dict, low: str, high: str) -> list[Fault]:
    out = [Fault(f"{at}.{k}", "is no number" if k in value else "is missing") for k in (low, high) if not _number(value.get(k))]
    return out or ([Fault(at, f"{low} is above {high}")] if value[low] > value[high] else [])


def _weights(at: str, weights: dict[str, object]) -> list[Fault]:
    out = [Fault(f"{at}{k}", "is no number of 0 or more") for k, w in weights.items() if not _number(w) or w < 0]
    return out or ([Fault("$", "all weights are 0")] if weights and not sum(weights.values()) else [])


def _property(at: str, name: object) -> list[Fault]:
    return [] if isinstance(name, str) and name.lower() in PROPERTIES else [Fault(at, f"there is no property {name}")]


def faults(doc: object) -> list[Fault]:
    """What is wrong with a document, by path; empty if it can be compiled."""
    if not isinstance(doc, dict):
        return [Fault("$", "is no object")]
    kinds = [k for k in FIELDS if k in doc]
    if len(kinds) != 1:
        return [Fault("$", "has to have either thresholds or properties")]
    (kind,) = kinds
    out = [Fault(f"$.{k}", "is no field of a profile") for k in sorted(doc.keys() - FIELDS[kind])]
    if not isinstance(doc.get("name"), str) or not doc["name"].strip():
        out.append(Fault("$.name", "is no text, or empty"))
    parts = doc[kind]
    if not isinstance(parts, dict if kind == "thresholds" else list) or not parts:
        return [*out, Fault(f"$.{kind}", "is empty, or not of its kind")]
    if kind == "thresholds":
        for name, bounds in parts.items():
            at = f"$.thresholds.{name}"
            out += _property(at, name) + (_range(at, bounds, "min", "max") if isinstance(bounds, dict) else [Fault(at, "is no object")])
        weights = doc.get("weights", {})
        if not isinstance(weights, dict):
            return [*out, Fault("$.weights", "is no object")]
        out += [Fault(f"$.weights.{k}", "has no threshold") for k in weights if k not in parts]
        return out + _weights("$.weights.", {k: weights.get(k, 1.0) for k in parts})
    for i, part in enumerate(parts):
        at = f"$.properties[{i}]"
        if not isinstance(part, dict):
            out.append(Fault(at, "is no object"))
            continue
        out += [Fault(f"{at}.{k}", "is no field of a property") for k in sorted(part.keys() - PART)]
        out += _property(f"{at}.property", part.get("property")) + _range(at, part, "low", "high")
        if part.get("shape", "sigmoid") not in SHAPES:
            out.append(Fault(f"{at}.shape", f"is none of {', '.join(SHAPES)}"))
    return out + _weights("$.properties", {f"[{i}].weight": p.get("weight", 1.0) for i, p in enumerate(parts) if isinstance(p, dict)})


def parsed(document: str) -> dict:
    """A document that has no faults; else ProfileError."""
    try:
        doc = json.loads(document)
    except (TypeError, ValueError) as e:
        raise ProfileError([Fault("$", f"is no JSON: {e}")]) from e
    if found := faults(doc):
        raise ProfileError(found)
    return doc


def _column(name: str) -> str:
    return PROPERTIES[name.lower()]


def compiled(document: str) -> Column:
    """The score of a document: 0 to 100 of a profile, 0 to 1 of a multi-parameter score."""
    doc = parsed(document)
    if "properties" in doc:
        return scoring.custom_mpo([(_column(p["property"]), float(p["low"]), float(p["high"]), p.get("shape", "sigmoid"), float(p.get("weight", 1.0))) for p in doc["properties"]])
    weights = doc.get("weights", {})
    return scoring.profile_score({_column(k): (float(b["min"]), float(b["max"])) for k, b in doc["thresholds"].items()}, {_column(k): float(weights.get(k, 1.0)) for k in doc["thresholds"]})


def components(document: str) -> Column:
    """Of a multi-parameter score, each property's value, desirability, weight and contribution."""
    doc = parsed(document)
    rows = []
    for p in doc.get("properties", ()):
        value, weight = F.col(_column(p["property"])).cast("double"), float(p.get("weight", 1.0))
        d = scoring.shaped(value, float(p["low"]), float(p["high"]), p.get("shape", "sigmoid"))
        rows.append(F.struct(F.lit(p["property"]).alias("property"), F.round(value, 4).alias("value"), F.round(d, 4).alias("desirability"), F.lit(weight).alias("weight"), F.round(d * weight, 4).alias("contribution")))
    return F.array(*rows)


def preset(name: str) -> str:
    bounds = PRESETS[name]
    return json.dumps({"name": name, "thresholds": {k: {"min": a, "max": b} for k, (a, b) in bounds.items()}, "weights": dict.fromkeys(bounds, 1.0)})
