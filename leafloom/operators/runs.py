"""Runs over text: arrays of struct<s: int, e: int, v: string>, half-open offsets, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def run(s: Column, e: Column, v: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), v.cast("string").alias("v"))


def sliced(runs: Column, a: Column, b: Column) -> Column:
    """The runs of text[a:b], counted from its beginning; what falls outside goes."""
    cut = F.transform(runs, lambda r: run(F.greatest(r["s"], a) - a, F.least(r["e"], b) - a, r["v"]))
    return F.filter(cut, lambda r: r["s"] < r["e"])


def shifted(runs: Column, by: Column) -> Column:
    return F.transform(runs, lambda r: run(r["s"] + by, r["e"] + by, r["v"]))


def joined(text: Column, runs: Column, more: Column, more_runs: Column, between: str = " ") -> Column:
    """Two texts in one, the second's runs moved along: struct<text, runs>."""
    glue = F.lit(between)
    return F.struct(F.concat(text, glue, more).alias("text"), F.concat(runs, shifted(more_runs, F.length(text) + F.length(glue))).alias("runs"))


def overlaps(s: Column, e: Column, spans: Column) -> Column:
    return F.exists(spans, lambda r: (s < r["e"]) & (e > r["s"]))


def merged(runs: Column, gap: int = 1) -> Column:
    """Neighbouring runs of one value no further apart than gap become one."""
    ordered = F.array_sort(runs)
    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def add(held: Column, r: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        fits = (F.size(held) > 0) & (last["v"].eqNullSafe(r["v"])) & (r["s"] - last["e"] <= gap)
        return F.when(fits, F.concat(F.slice(held, 1, F.greatest(F.lit(0), F.size(held) - 1)), F.array(run(last["s"], F.greatest(last["e"], r["e"]), last["v"])))).otherwise(F.concat(held, F.array(r)))

    return F.aggregate(ordered, empty, lambda held, r: F.when(F.size(held) == 0, F.array(r)).otherwise(add(held, r)))
