"""Staged filters with the first failing stage, duplicates among survivors only, and counts by stage; step pipelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import structures
from tessel.operators import screen

STAGES = ("parse", "valence", "alerts", "property", "sa", "dedup")
#: With the optional last stage, for rows too like a reference set.
ALL_STAGES = (*STAGES, "novelty")

# The named presets, as least and most of descriptor columns in the order in which they are tried, the rule
# catalogues that they screen, and the weights of their composite score (validity, drug-likeness, free of alerts, ease).
PRESETS = {
    "drug_like": {"mw": (200, 500), "logp": (-1, 5), "tpsa": (None, 140), "rotb": (None, 10), "sa": (None, 5)},
    "lead_like": {"mw": (200, 350), "logp": (-1, 3.5), "tpsa": (None, 140), "rotb": (None, 7), "sa": (None, 4)},
    "fragment_like": {"mw": (100, 300), "logp": (-1, 3), "tpsa": (None, 100), "rotb": (None, 3), "rings": (None, 3), "sa": (None, 3)},
    "permissive": {"mw": (100, 800), "logp": (-5, 8), "tpsa": (None, 200), "rotb": (None, 15), "sa": (None, 7)},
}
CATALOGUES = {"drug_like": ("pains", "brenk", "kazius"), "lead_like": ("pains", "brenk", "kazius", "nibr"), "fragment_like": ("pains",), "permissive": ()}
WEIGHTS = {"drug_like": (0.3, 0.3, 0.2, 0.2), "lead_like": (0.2, 0.4, 0.2, 0.2), "fragment_like": (0.2, 0.2, 0.3, 0.3), "permissive": (0.4, 0.3, 0.1, 0.2)}
NOVELTY = 0.85
# Steps of curation, which of them the named presets run, and bounds of what they keep.
CURATION = ("metals", "desalt", "normalize", "neutralize", "tautomer", "stereo", "isotope")
CURATION_PRESETS = {"default": CURATION[:5] + CURATION[6:], "2d": CURATION, "3d": CURATION[:5] + CURATION[6:], "minimal": ("desalt", "normalize")}
COMPOSITION = {"heavy": (3, 100), "mw": (None, 1500)}


def outside(bounds: dict[str, tuple]) -> Column:
    """Name of the first column that is outside its bounds; null if none is."""
    out = F.lit(None).cast("string")
    for name, (low, high) in reversed(bounds.items()):
        beyond = F.lit(False)
        if low is not None:
            beyond = beyond | (F.col(name) < low)
        if high is not None:
            beyond = beyond | (F.col(name) > high)
        out = F.when(beyond, name).otherwise(out)
    return out


def rejection(first: Column, parsed: Column, valence: Column, alerts: Column, similarity: Column | None = None) -> Column:
    """(stage, reason) of the first stage but the duplicates' that rejects a row; null for survivors. first: the first
    column outside its bounds."""
    fail = lambda stage, reason: F.struct(F.lit(stage).alias("stage"), reason.alias("reason"))
    out = F.when(~F.coalesce(parsed, F.lit(False)), fail("parse", F.lit("not parsed"))).when(~valence, fail("valence", F.lit("valence"))).when(alerts > 0, fail("alerts", F.lit("alert match")))
    out = out.when(first.isNotNull() & (first != "sa"), fail("property", first)).when(first == "sa", fail("sa", F.lit("sa")))
    return out if similarity is None else out.when(similarity >= NOVELTY, fail("novelty", F.lit("known")))


def filtered(df: DataFrame, bounds: dict[str, tuple], parsed: Column, valence: Column, alerts: Column, key: list[str], index: str, similarity: Column | None = None) -> DataFrame:
    """df with stage and reason of rejection (null: passed); among survivors only a key's row of the least index passes.

    Duplicates are settled before novelty, so a duplicate is one whether or not it is known.
    """
    df = df.withColumn("_out", outside(bounds))
    df = df.withColumn("_r", rejection(F.col("_out"), parsed, valence, alerts, similarity)).drop("_out")
    alive = F.col("_r").isNull() | (F.col("_r.stage") == "novelty")
    first = df.where(alive).groupBy(*key).agg(F.min(index).alias("_first"))
    kept = df.where(alive).join(first, key)
    twice = F.col(index) != F.col("_first")
    kept = kept.withColumn("stage", F.when(twice, "dedup").otherwise(F.col("_r.stage"))).withColumn("reason", F.when(twice, F.concat(F.lit("Duplicate of row "), (F.col("_first") + 1).cast("string"))).otherwise(F.col("_r.reason"))).drop("_first", "_r")
    return kept.unionByName(df.where(~alive).withColumns({"stage": F.col("_r.stage"), "reason": F.col("_r.reason")}).drop("_r"))


def composition_reason() -> Column:
    """Why a curated row is not kept, by its atoms (heavy), weight (mw) and whether it has carbon (carbon); null if it is."""
    (few, many), (_, most) = COMPOSITION["heavy"], COMPOSITION["mw"]
    n = F.col("heavy").cast("int").cast("string")
    return (
        F.when(F.col("heavy") < few, F.concat(F.lit("Too few heavy atoms: "), n, F.lit(f" < {few} (minimum)")))
        .when(F.col("heavy") > many, F.concat(F.lit("Too many heavy atoms: "), n, F.lit(f" > {many} (maximum)")))
        .when(F.col("mw") > most, F.concat(F.lit("Molecular weight too high: "), F.format_string("%.1f", F.col("mw")), F.lit(f" > {most:.1f} (maximum)")))
        .when(~F.col("carbon"), "No carbon atoms found (inorganic molecule rejected)")
    )


def first_kept(df: DataFrame, ok: Column, key: str, index: str) -> DataFrame:
    """df with status (ok, duplicate, rejected) and reason: among rows that are ok a key's least index stays so."""
    df = df.withColumn("_ok", ok & F.col(key).isNotNull())
    first = df.where("_ok").groupBy(key).agg(F.min(index).alias("_first"))
    kept = df.join(first, key, "left")
    twice = F.col("_ok") & (F.col(index) != F.col("_first"))
    at = F.col("_first").cast("string")
    reason = F.when(twice, F.concat(F.lit("Duplicate of molecule "), at, F.lit(" (index "), at, F.lit(")")))
    return kept.withColumn("status", F.when(twice, "duplicate").when(ok, "ok").otherwise("rejected")).withColumn("reason", reason).drop("_ok", "_first")


def stage_counts(result: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """stage_index, stage, rows in, passed and rejected: one aggregation, then a row for each stage."""
    at = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in stages)), F.col("stage")), F.lit(0))
    gone = [F.count_if(at == i + 1) for i in range(len(stages))]
    row = result.agg(F.count("*").alias("total"), *(g.alias(f"r{i}") for i, g in enumerate(gone)))
    before = lambda i: sum((F.col(f"r{j}") for j in range(i)), F.lit(0))
    rows = F.array(*(F.struct(F.lit(i + 1).cast("long").alias("stage_index"), F.lit(s).alias("stage"), (F.col("total") - before(i)).alias("n_in"), (F.col("total") - before(i + 1)).alias("n_passed"), F.col(f"r{i}").alias("n_rejected")) for i, s in enumerate(stages)))
    return row.select(F.explode(rows).alias("x")).select("x.*")


@dataclass(frozen=True)
class Step:
    """A text step: its name and what it makes of a column."""

    name: str
    run: object


TEXT_STEPS = (
    Step("trim", lambda t: F.trim(t)),
    Step("lower", lambda t: F.lower(t)),
    Step("spaces", lambda t: F.regexp_replace(t, r"[ \t\n\r\f\x0B]+", " ")),
    Step("symbols", lambda t: F.regexp_replace(t, r"[#*$%&|]+", "")),
)


def stepped(df: DataFrame, text: str, steps: tuple[Step, ...] = TEXT_STEPS) -> DataFrame:
    """df with the text after all steps (clean) and whether each step applied, changed nothing, or failed (steps)."""
    df = df.withColumn("_t0", F.col(text))
    for i, s in enumerate(steps):
        df = df.withColumn(f"_t{i + 1}", s.run(F.col(f"_t{i}")))
    marks = F.array(*(F.struct(F.lit(s.name).alias("step"), F.when(F.col(f"_t{i}").isNull(), "skipped").when(F.col(f"_t{i + 1}").isNull(), "error").when(F.col(f"_t{i}") == F.col(f"_t{i + 1}"), "no_change").otherwise("applied").alias("status")) for i, s in enumerate(steps)))
    return df.withColumn("steps", marks).withColumn("clean", F.col(f"_t{len(steps)}")).drop(*(f"_t{i}" for i in range(len(steps) + 1)))


#: Curation steps that notation alone decides; the others need a chemistry kernel and are skipped.
NOTATION_STEPS = {"desalt": structures.parent, "stereo": structures.without_stereo, "isotope": structures.without_isotopes}


def curation_steps(preset: str) -> list[Step]:
    """All steps of curation in order; those that the preset leaves out, or that notation cannot do, do nothing."""
    if preset not in CURATION_PRESETS:
        raise ValueError(f"no preset {preset}; there are {', '.join(CURATION_PRESETS)}")
    return [Step(n, NOTATION_STEPS.get(n) if n in CURATION_PRESETS[preset] else None) for n in CURATION]


def curated_by(df: DataFrame, column: str, preset: str = "default") -> DataFrame:
    """df with curated (the text after the preset's steps) and steps: step, place from 1, status, before and after.

    skipped: left out by the preset, not decidable by notation, or nothing left to run on; error: the step gave nothing, and
    curated is null. before and after are null for skipped steps.
    """
    names, states = [column], []
    df = df.withColumn("_s0", F.col(column))
    for i, s in enumerate(curation_steps(preset)):
        was, now = F.col(f"_s{i}"), F.col(f"_s{i + 1}")
        df = df.withColumn(f"_s{i + 1}", was if s.run is None else s.run(was))
        run = F.lit(s.run is not None) & was.isNotNull()
        status = F.when(~run, "skipped").when(now.isNull(), "error").when(now == was, "no_change").otherwise("applied")
        states.append(F.struct(F.lit(s.name).alias("step"), F.lit(i + 1).alias("place"), status.alias("status"), F.when(run, was).alias("before"), F.when(run, now).alias("after")))
        names.append(f"_s{i + 1}")
    return df.withColumn("steps", F.array(*states)).withColumn("curated", F.col(names[-1])).drop("_s0", *names[1:])


def preset_rules(rules: list[screen.Rule], preset: str) -> list[screen.Rule]:
    """The rules of the catalogues that a preset screens, by their source, case aside."""
    return [r for r in rules if r.source.lower() in CATALOGUES[preset]]


def preset_alerts(df: DataFrame, text: str, rules: list[screen.Rule], index: str, preset: str) -> DataFrame:
    """df with alerts: how many rules of the preset's catalogues its text hits (0 without any)."""
    own = preset_rules(rules, preset)
    if not own:
        return df.withColumn("alerts", F.lit(0).cast("long"))
    n = screen.hits(df, F.col(text), own, index).groupBy(index).agg(F.count("*").alias("alerts"))
    return df.join(n, index, "left").withColumn("alerts", F.coalesce("alerts", F.lit(0).cast("long")))
