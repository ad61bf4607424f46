"""Contents lists from their raw lines: titles, pages and levels.

Nulls: lines without text, key or place give no entry. Equal rows count as they
stand. An empty table gives an empty result. A contents list is a few pages long;
one task takes it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grouped import grouped
from . import patterns

#: A number in a column of its own belongs to the line within this height; indents within a step of this width are one.
HEIGHT, STEP = 6.0, 8.0
DEEPEST = 6


def entry_key(title: Column) -> Column:
    """A title in lower-case words, without the number or chapter before it."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(title), patterns.SECTION_NUMBER, ""), patterns.CHAPTER, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def _line(text: Column) -> Column:
    """struct<alone, page, body> of a line of a contents list."""
    said = F.regexp_replace(text, r"^\s+|\s+$", "")
    lead = F.regexp_extract(said, patterns.PAGE_LEAD, 1)
    tail = F.coalesce(F.nullif(F.regexp_extract(said, patterns.PAGE_TAIL, 1), F.lit("")), F.nullif(F.regexp_extract(said, patterns.PAGE_TAIL, 2), F.lit("")))
    page = F.when(lead != "", lead).otherwise(tail)
    body = F.when(lead != "", F.regexp_extract(said, patterns.PAGE_LEAD, 2)).when(tail.isNotNull(), F.regexp_replace(said, patterns.PAGE_TAIL, "")).otherwise(said)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\s+$", ""), patterns.LEADERS, ""), patterns.DASHES, "")
    return F.struct(said.rlike(patterns.PAGE_ALONE).alias("alone"), said.alias("said"), page.alias("page"), F.regexp_replace(clean, r"^\s+|\s+$", "").alias("body"))


def levels(entries: list[tuple[float, int | None, bool]]) -> list[int | None]:
    """Levels of (x, depth of a dotted number, begins like a chapter): dotted numbers say theirs, below the deepest of the others, which go by steps of indent, or, where all stand alike, by chapters."""
    steps: list[float] = []
    for x in sorted({round(x, 1) for x, depth, _ in entries if depth is None}):
        if not steps or x - steps[-1] > STEP:
            steps.append(x)
    indented = len(steps) >= 2 and steps[-1] - steps[0] >= STEP
    out: list[int | None] = []
    for x, depth, chapter in entries:
        if depth is not None:
            out.append(None)
        elif indented:
            out.append(min(max([k + 1 for k, s in enumerate(steps) if x >= s - STEP / 2], default=1), DEEPEST))
        else:
            out.append(1 if chapter else None)
    deepest = max((v for v in out if v), default=1)
    return [v if depth is None else min(deepest + depth - 1, DEEPEST) for v, (_, depth, _) in zip(out, entries)]


def assembled(lines: list[tuple]) -> list[tuple]:
    """Entries (title, page, x) of lines (x, y, alone, said, page, body, n letters of the key, title of a list, first letter small, dotted depth, chapter) from the top down.

    A line goes on with the entry before it where it begins with a small letter, or
    has no page while that has one. A number that stands alone belongs to the nearest
    line without one, each to one line.
    """
    numbers = [[y, said, False] for _, y, alone, said, *_ in lines if alone]
    out: list[list] = []
    for x, y, alone, _, page, body, n, heading, small, depth, chapter in lines:
        if alone or n < 2 or heading:
            continue
        if page is None:
            near = min((k for k in numbers if not k[2] and abs(k[0] - y) < HEIGHT), key=lambda k: abs(k[0] - y), default=None)
            if near:
                near[2], page = True, near[1]
        if out and (small or (page is None and out[-1][1])):
            out[-1][0] = f"{out[-1][0]} {body}".strip()
            out[-1][1] = out[-1][1] if out[-1][1] is not None else page
        else:
            out.append([body, page, x, depth, chapter])
    return [(title, page, level) for (title, page, *_), level in zip(out, levels([(x, d, c) for _, _, x, d, c in out]))]


def parsed(lines: DataFrame, key: str, x: str, y: str, text: str) -> DataFrame:
    """key, entry (from 0), title, page, level, norm. x, y: a line's left edge and middle."""
    held = lines.where(F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_l", _line(F.coalesce(text, F.lit("")))).where("_l.said <> ''")
    norm = entry_key(F.col("_l.body"))
    dotted = F.regexp_extract("_l.body", patterns.SECTION_NUMBER, 1)
    depth = F.when(dotted.contains("."), F.length(dotted) - F.length(F.replace(dotted, F.lit("."), F.lit(""))) + 1)
    small = F.regexp_extract("_l.body", r"(\p{L})", 1).rlike(r"^\p{Ll}")
    rows = held.select(key, F.col(x).cast("double").alias("_x"), (-F.col(y).cast("double")).alias("_down"), "_l.alone", "_l.said", "_l.page", "_l.body", F.length(norm).alias("_n"), norm.isin(*patterns.CONTENTS_TITLES).alias("_heading"), small.alias("_small"), depth.alias("_depth"), F.col("_l.body").rlike(patterns.CHAPTER).alias("_chapter"))
    schema = T.StructType([rows.schema[key], *[T.StructField(n, t) for n, t in (("entry", T.IntegerType()), ("title", T.StringType()), ("page", T.StringType()), ("level", T.IntegerType()))]])

    def work(group: list[tuple]) -> list[tuple]:
        return [(group[0][0], k, *e) for k, e in enumerate(assembled([(g[1], -g[2], *g[3:]) for g in group]))]

    return grouped(rows, [key], ["_down", "_x", "said"], work, schema).withColumn("norm", entry_key(F.col("title")))
