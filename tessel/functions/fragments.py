"""Fragments of a record by name and role, and what desalting keeps and removes: native expressions over the notation.

A fragment is looked up as it is written, so its notation must be canonical. Null notations give null; an empty one has no
fragments and a null parent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions import structures

# Notation, name and role of known counterions, salt formers and solvents.
KNOWN = (
    ("[Cl-]", "chloride", "counterion"),
    ("[Br-]", "bromide", "counterion"),
    ("[I-]", "iodide", "counterion"),
    ("[F-]", "fluoride", "counterion"),
    ("[Na+]", "sodium", "counterion"),
    ("[K+]", "potassium", "counterion"),
    ("[Li+]", "lithium", "counterion"),
    ("[Ca+2]", "calcium", "counterion"),
    ("[Mg+2]", "magnesium", "counterion"),
    ("[Zn+2]", "zinc", "counterion"),
    ("[NH4+]", "ammonium", "counterion"),
    ("[Na]", "sodium", "counterion"),
    ("[K]", "potassium", "counterion"),
    ("[Li]", "lithium", "counterion"),
    ("[OH-]", "hydroxide", "counterion"),
    ("[O-2]", "oxide", "counterion"),
    ("Cl", "hydrochloric acid", "salt"),
    ("Br", "hydrobromic acid", "salt"),
    ("I", "hydroiodic acid", "salt"),
    ("CC(=O)O", "acetic acid", "salt"),
    ("O=C(O)C(F)(F)F", "trifluoroacetic acid", "salt"),
    ("O=C(O)c1ccccc1", "benzoic acid", "salt"),
    ("O=S(=O)(O)O", "sulfuric acid", "salt"),
    ("Cc1ccc(S(=O)(=O)O)cc1", "p-toluenesulfonic acid", "salt"),
    ("O=P(O)(O)O", "phosphoric acid", "salt"),
    ("O=C(O)O", "carbonic acid", "salt"),
    ("O=CO", "formic acid", "salt"),
    ("O=C(O)CC(O)(CC(=O)O)C(=O)O", "citric acid", "salt"),
    ("O=C(O)C(=O)O", "oxalic acid", "salt"),
    ("O=C(O)CCC(=O)O", "succinic acid", "salt"),
    ("O=C(O)C=CC(=O)O", "maleic acid", "salt"),
    ("O=C(O)/C=C/C(=O)O", "fumaric acid", "salt"),
    ("O=C(O)C(O)C(=O)O", "tartaric acid", "salt"),
    ("O=S(=O)(O)c1ccccc1", "benzenesulfonic acid", "salt"),
    ("CCCCS(=O)(=O)O", "butanesulfonic acid", "salt"),
    ("O", "water", "solvent"),
    ("CO", "methanol", "solvent"),
    ("CCO", "ethanol", "solvent"),
    ("CC(C)O", "isopropanol", "solvent"),
    ("CS(C)=O", "DMSO", "solvent"),
    ("CN(C)C=O", "DMF", "solvent"),
    ("CC#N", "acetonitrile", "solvent"),
    ("CC(C)=O", "acetone", "solvent"),
    ("ClCCl", "dichloromethane", "solvent"),
    ("ClC(Cl)Cl", "chloroform", "solvent"),
    ("CCOC(C)=O", "ethyl acetate", "solvent"),
    ("C1CCOC1", "THF", "solvent"),
    ("ClCCCl", "1,2-dichloroethane", "solvent"),
    ("CCOCC", "diethyl ether", "solvent"),
    ("c1ccncc1", "pyridine", "solvent"),
    ("C1CCCCC1", "cyclohexane", "solvent"),
    ("Cc1ccccc1", "toluene", "solvent"),
    ("c1ccccc1", "benzene", "solvent"),
    ("CCCCCC", "hexane", "solvent"),
    ("CCCCC", "pentane", "solvent"),
)


def identified(fragment: Column) -> Column:
    """(fragment, name, role); an unknown one has no name and the role unknown."""
    table = F.create_map(*(x for notation, name, role in KNOWN for x in (F.lit(notation), F.struct(F.lit(name).alias("name"), F.lit(role).alias("role")))))
    found = F.try_element_at(table, fragment)
    return F.struct(fragment.alias("fragment"), found["name"].alias("name"), F.coalesce(found["role"], F.lit("unknown")).alias("role"))


def desalted(notation: Column) -> Column:
    """(parent, removed): the fragment with most heavy atoms (the longer, then the later in order, of equals), and all
    others as identified, in their order. Of equal fragments the last is the parent."""
    ranked = F.transform(structures.fragments(notation), lambda f, i: F.struct(structures.heavy_atoms(f).alias("heavy"), F.length(f).alias("chars"), f.alias("fragment"), i.alias("at")))
    best = F.try_element_at(F.array_sort(ranked), F.lit(-1))
    removed = F.transform(F.filter(ranked, lambda r: r["at"] != best["at"]), lambda r: identified(r["fragment"]))
    return F.struct(best["fragment"].alias("parent"), removed.alias("removed"))
