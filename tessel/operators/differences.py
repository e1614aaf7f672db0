"""Differences of two structs of descriptors, by declared fields.

One rule for all comparisons of before and after: signed changes of numbers, what was added and what removed, losses, and
whether the two are the same by their key. A side that is null makes every change null and the pair not comparable.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("delta", "percent", "count", "loss", "key")


@dataclass(frozen=True)
class Field:
    """A field of both structs. kind: delta (after - before), percent (of before, 0 where that is 0), count (delta, and
    what was added and removed), loss (lower after than before), key (has to be equal)."""

    name: str
    kind: str
    places: int = 4

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"no kind {self.kind}; there are {', '.join(KINDS)}")


def difference(before: Column, after: Column, fields: list[Field]) -> Column:
    """A struct: the columns of each field, `losses` (fields that are lower after), `changed` (fields that differ, as
    `name: before → after`), `identical` (all keys equal) and `comparable`."""
    both = before.isNotNull() & after.isNotNull()
    out, losses, changed, same = [], [], [], [both]
    for f in fields:
        a, b = before.getField(f.name), after.getField(f.name)
        if f.kind in ("delta", "count", "loss"):
            out.append(F.round(b - a, f.places).alias(f"{f.name}_delta"))
        if f.kind == "percent":
            out.append(F.round(F.when(a == 0, 0.0).otherwise((b - a) / a * 100), f.places).alias(f"{f.name}_percent"))
        if f.kind == "count":
            zero = F.lit(0)
            out += [F.when(b.isNotNull() & a.isNotNull(), F.greatest(b - a, zero)).alias(f"{f.name}_added"), F.when(b.isNotNull() & a.isNotNull(), F.greatest(a - b, zero)).alias(f"{f.name}_removed")]
        if f.kind == "loss":
            losses.append(F.when(b < a, F.lit(f.name)))
        if f.kind == "key":
            same.append(a.eqNullSafe(b))
        show = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
        changed.append(F.when(both & ~a.eqNullSafe(b), F.concat(F.lit(f"{f.name}: "), show(a), F.lit(" → "), show(b))))
    listed = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    return F.struct(*out, listed(losses).alias("losses"), listed(changed).alias("changed"), reduce(Column.__and__, same).alias("identical"), both.alias("comparable"))
