"""Rule screening: rows against a table of patterns, concern groups, worst severities, categories.

Few rules (MAX_RULES) become one array expression over each row. More are indexed by the literals that their matches must
hold: one pass of an automaton over a text gives the rules whose literals it holds, and only these are tried. The index is
made once a task, of rules of a checked number, and no pattern is compiled by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as ops
from re import _parser as parser

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.sources.staging import small_enough

#: Rules in one expression; more are indexed, so many at most.
MAX_RULES, INDEXED_RULES = 50, 100_000
#: Characters of a literal that is worth looking for.
LEAST_LITERAL = 3
RANK = {"critical": 2, "warning": 1, "info": 0}


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    group: str
    severity: str = "warning"
    source: str = "own"


def hits(df: DataFrame, text: Column, rules: list[Rule], *keys: str) -> DataFrame:
    """A row for each rule that a row's text (lower-cased) matches."""
    if len(rules) > MAX_RULES:
        return indexed_hits(df, text, rules, *keys)
    df, low = df.select(*keys, F.lower(text).alias("_low")), F.col("_low")
    found = F.filter(F.array(*(F.when(low.rlike(r.pattern), F.struct(F.lit(r.name).alias("rule"), F.lit(r.group).alias("concern"), F.lit(r.severity).alias("severity"), F.lit(RANK[r.severity]).alias("rank"), F.lit(r.source).alias("source"))) for r in rules)), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(found).alias("h")).select(*keys, "h.*")


def verdicts(df: DataFrame, text: Column, rules: list[Rule], *keys: str) -> DataFrame:
    """For each row and source of rules: matches (rules that the lower-cased text matches) and passed; all_passed: whether
    the row passes every source. A row stays without any match; a null text matches nothing. No shuffle.

    Rules are MAX_RULES at most; more of them are screened by `indexed_hits`.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; use indexed_hits")
    df, low = df.select(*keys, F.lower(text).alias("_low")), F.col("_low")
    sources = sorted({r.source for r in rules})
    each = [F.struct(F.lit(s).alias("source"), sum((F.coalesce(low.rlike(r.pattern), F.lit(False)).cast("long") for r in rules if r.source == s), F.lit(0).cast("long")).alias("matches")) for s in sources]
    kept = df.select(*keys, F.array(*each).alias("_by"))
    kept = kept.withColumn("all_passed", F.forall("_by", lambda x: x["matches"] == 0))
    return kept.select(*keys, "all_passed", F.explode("_by").alias("_s")).select(*keys, "_s.source", "_s.matches", (F.col("_s.matches") == 0).alias("passed"), "all_passed")


RULE_SCHEMA = "rule string, pattern string, concern string, severity string, source string"


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.pattern, r.group, r.severity, r.source) for r in rules], RULE_SCHEMA)


def table_hits(df: DataFrame, text: Column, rules: DataFrame, *keys: str) -> DataFrame:
    """The same over a table of rules (RULE_SCHEMA), of INDEXED_RULES at most."""
    if not small_enough(rules, INDEXED_RULES):
        raise ValueError(f"more than {INDEXED_RULES} rules; screen them in parts")
    return indexed_hits(df, text, [Rule(r["rule"], r["pattern"], r["concern"], r["severity"], r["source"]) for r in rules.collect()], *keys)


def _needed(tokens: Iterable) -> set[str]:
    """Literals of which any match of a parsed pattern holds one, the shortest as long as can be; none if nothing is sure."""
    found, run = [], ""
    for op, arg in [*tokens, (None, None)]:
        if op is ops.LITERAL:
            run += chr(arg)
            continue
        found.append({run})
        run = ""
        if op is ops.SUBPATTERN:
            found.append(_needed(arg[3]))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and arg[0] > 0:
            found.append(_needed(arg[2]))
        elif op is ops.BRANCH:
            ways = [_needed(x) for x in arg[1]]
            found.append(set().union(*ways) if all(ways) else set())
    return max((x for x in found if x), key=lambda x: min(map(len, x)), default=set())


def literals(pattern: str) -> set[str]:
    """Lower-case literals of which a text must hold one to match a pattern; empty if it has to be tried on every text."""
    out = _needed(parser.parse(pattern))
    if "(?" in pattern and re.search(r"\(\?[a-z]*i", pattern):
        out = {x.lower() for x in out} if all(x.isascii() for x in out) else set()
    return out if out and min(map(len, out)) >= LEAST_LITERAL else set()


class RuleIndex:
    """An automaton over the rules' literals, the rules of each literal, and compiled patterns."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.patterns = [re.compile(p) for p in patterns]
        self.always, by = [], {}
        for i, p in enumerate(patterns):
            needed = literals(p)
            for x in needed:
                by.setdefault(x, []).append(i)
            if not needed:
                self.always.append(i)
        self.automaton = ahocorasick.Automaton()
        for x, rules in by.items():
            self.automaton.add_word(x, rules)
        if by:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        some = {i for _, rules in self.automaton.iter(text) for i in rules} if len(self.automaton) else set()
        return sorted(some.union(self.always))

    def matches(self, text: str) -> list[int]:
        return [i for i in self.candidates(text) if self.patterns[i].search(text)]


def indexed_hits(df: DataFrame, text: Column, rules: list[Rule], *keys: str) -> DataFrame:
    """The same as `hits` through an index of the rules. Patterns are tried by Python's engine: those that mean something
    else there than in the JVM's have to be screened in an expression."""
    rows = df.select(*keys, F.lower(text).alias("_low")).where(F.col("_low").isNotNull())
    told = [(r.name, r.group, r.severity, RANK.get(r.severity, 0), r.source) for r in rules]
    patterns = [r.pattern for r in rules]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
    names = [*keys, "rule", "concern", "severity", "rank", "source"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(patterns)
        for batch in batches:
            at, hit = [], []
            for i, low in enumerate(batch.column("_low")):
                mine = index.matches(low.as_py())
                at += [i] * len(mine)
                hit += mine
            own = batch.select(list(keys)).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([told[h][k] for h in hit], kind) for k, kind in enumerate(kinds))], names)

    schema = rows.select(*keys).schema
    for name, kind in zip(names[len(keys) :], ("string", "string", "string", "integer", "string"), strict=True):
        schema = schema.add(name, kind)
    return rows.mapInArrow(found, schema)


def categories(text: Column, table: list[tuple[str, str]]) -> Column:
    """All categories whose pattern the text matches, in the order of the table."""
    low = F.lower(text)
    return F.filter(F.array(*(F.when(low.rlike(p), F.lit(c)) for p, c in table)), lambda x: x.isNotNull())


def category_counts(df: DataFrame, text: Column, table: list[tuple[str, str]], none: str = "unclassified") -> DataFrame:
    """Rows of each category; a row counts in each of its own, so the sum may exceed the rows."""
    found = categories(text, table)
    return df.select(F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(none)))).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


def unified(found: DataFrame, key: str) -> DataFrame:
    """Hits of a row, alike ones (concern and name) merged over sources: counts, sources, worst severity."""
    name = F.regexp_replace(F.lower("rule"), "[ -]", "_")
    merged = found.groupBy(key, "concern", name.alias("name")).agg(F.max("rank").alias("rank"), F.count("*").alias("raw"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    worst = F.when(F.max("rank") == 2, "critical").when(F.max("rank") == 1, "warning").otherwise("info")
    return merged.groupBy(key).agg(F.sum("raw").alias("raw"), F.count("*").alias("deduped"), F.count_distinct("concern").alias("concerns"), worst.alias("worst"))


def first_category(text: Column, table: list[tuple[str, str]], default: str) -> Column:
    """The category of the first row of the table whose pattern the text matches."""
    out = F.lit(default)
    for pattern, category in reversed(table):
        out = F.when(F.lower(text).rlike(pattern), category).otherwise(out)
    return out


# Patterns of content that uploads must not have, by name.
SUSPICIOUS = {
    "script tag": "<script",
    "script protocol": "javascript:",
    "frame": "<iframe",
    "error handler": r"onerror\s*=",
    "click handler": r"onclick\s*=",
    "load handler": r"onload\s*=",
    "object tag": "<object",
    "embed tag": "<embed",
    "html data": "data:text/html",
    "null byte": r"\x00",
}


def suspicious(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    """All findings of each row, joined by commas in order, and their number."""
    found = F.filter(F.array(*(F.when(F.lower(text).rlike(p), F.lit(n)) for n, p in SUSPICIOUS.items())), lambda x: x.isNotNull())
    return df.select(*keys, F.array_join(F.array_sort(found), ",").alias("findings"), F.size(found).cast("long").alias("n"))


def catalogue_listing(rules: DataFrame) -> DataFrame:
    """Of each catalogue (source) its rules, how many are of each severity, and the concerns that they stand for, in order."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return rules.groupBy("source").agg(F.count("*").alias("rules"), n("critical"), n("warning"), n("info"), F.array_join(F.array_sort(F.collect_set("concern")), ",").alias("concerns"))
