"""Contents lists against headings: who matches whom, what is missed, what is extra."""

from __future__ import annotations

from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grouped import grouped


def title_key(title: Column) -> Column:
    """A title without numbering before it and page number behind it, in lower-case words."""
    bare = F.regexp_replace(F.regexp_replace(title, r"^\s*(?:[0-9]+(?:\.[0-9]+)*\.?|[ivxlcIVXLC]+\.)\s+", ""), r"[\s.]*[0-9]+\s*$", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def dot_depth(title: Column) -> Column:
    """Depth of a dotted number ahead of a title; 0 if there is none."""
    number = F.regexp_extract(title, r"^\s*([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(number == "", 0).otherwise(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)


def paired(entries: list[tuple], headings: list[tuple]) -> list[tuple]:
    """entries and headings: (ord, key, page, level). Out: (status, entry ord, heading ord).

    Pages are shifted by the median difference over keys that both sides have
    once; then each entry, in order, takes the free heading of its key whose page
    is nearest to where it should be.
    """
    by_key: dict[str, list[tuple]] = {}
    for h in headings:
        by_key.setdefault(h[1], []).append(h)
    n_entries: dict[str, int] = {}
    for e in entries:
        n_entries[e[1]] = n_entries.get(e[1], 0) + 1
    apart = [by_key[e[1]][0][2] - e[2] for e in entries if n_entries[e[1]] == 1 and len(by_key.get(e[1], ())) == 1 and e[2] is not None and by_key[e[1]][0][2] is not None]
    offset = median(apart) if len(apart) >= 2 else 0
    taken: set = set()
    out: list[tuple] = []
    for e in entries:
        free = [h for h in by_key.get(e[1], ()) if h[0] not in taken]
        if not free:
            out.append(("missed", e[0], None))
            continue
        best = min(free, key=lambda h: (abs((h[2] or 0) - (e[2] or 0) - offset), h[0]))
        taken.add(best[0])
        out.append(("match" if e[3] is None or e[3] == best[3] else "level", e[0], best[0]))
    return out + [("extra", None, h[0]) for h in headings if h[0] not in taken]


def reconcile(entries: DataFrame, headings: DataFrame, doc: str) -> DataFrame:
    """entries, headings: (doc, ord, title, page, level). Out: doc, status, entry, heading. A document's titles are few and are matched in one place."""
    side = lambda df, n: df.select(doc, F.lit(n).alias("side"), F.col("ord").cast("long"), title_key(F.col("title")).alias("key"), F.col("page").cast("long"), F.col("level").cast("int"))
    both = side(entries, 0).unionByName(side(headings, 1))
    schema = T.StructType([both.schema[doc], T.StructField("status", T.StringType()), T.StructField("entry", T.LongType()), T.StructField("heading", T.LongType())])

    def work(group: list[tuple]) -> list[tuple]:
        return [(group[0][0], *r) for r in paired([g[2:] for g in group if g[1] == 0], [g[2:] for g in group if g[1] == 1])]

    return grouped(both, [doc], ["side", "ord", "key"], work, schema)
