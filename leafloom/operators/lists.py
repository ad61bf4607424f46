"""Lists that pages and columns tear apart: definitions, continued items, lists over a gutter.

Nulls: nodes without key or place are left out; null text is empty. Equal rows count
as they stand. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grouped import grouped
from . import patterns

#: Terms are no longer than this; a list has so many of them at least.
TERM, TERMS = 60, 3
#: A list goes on at the top of the next column, within this distance of the band's edge.
TOP = 15.0


def definition_pairs(nodes: list[tuple]) -> list[tuple[int, int, int]]:
    """(section, term, definition) places among nodes (heading, glossary, term, definition, style): after a glossary's heading terms and definitions take turns until one doesn't fit; terms share one style."""
    out, i = [], 0
    while i < len(nodes):
        at = i
        i += 1
        if not (nodes[at][0] and nodes[at][1]):
            continue
        pairs, j = [], i
        while j + 1 < len(nodes) and nodes[j][2] and nodes[j + 1][3] and (not pairs or nodes[j][4] == nodes[pairs[0][1]][4]):
            pairs.append((at, j, j + 1))
            j += 2
        if len(pairs) >= TERMS:
            out += pairs
            i = j
    return out


def definition_lists(nodes: DataFrame, key: str, order: str, kind: str = "kind", text: str = "text", style: str = "style") -> DataFrame:
    """key, section, term, definition (places) of every pair of a definition list. Texts stay where they are: only what they are passes through the fold."""
    said = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    term = F.col(kind).isin("heading", "paragraph") & F.length(said).between(1, TERM) & ~said.rlike(patterns.NOTES_HEADING)
    definition = (F.col(kind) == "paragraph") & ~F.coalesce(F.col(text), F.lit("")).startswith("»")
    fact = lambda c: F.coalesce(c, F.lit(False))
    rows = nodes.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(key, order, fact(F.col(kind) == "heading").alias("_h"), fact(said.rlike(patterns.GLOSSARY)).alias("_g"), fact(term).alias("_t"), fact(definition).alias("_d"), F.col(style).cast("string").alias("_s"))
    place = rows.schema[order].dataType
    schema = T.StructType([rows.schema[key], *[T.StructField(n, place) for n in ("section", "term", "definition")]])

    def work(group: list[tuple]) -> list[tuple]:
        return [(group[0][0], *(group[k][1] for k in pair)) for pair in definition_pairs([g[2:] for g in group])]

    return grouped(rows, [key], [order, "_h", "_g", "_t", "_d", "_s"], work, schema)


_TOKEN = re.compile(r"(?:^|(?<=\s))([0-9]{1,2}|[a-z])[.)]\s*")


def continued(text: str, number: int, letter: int) -> list[tuple[str, int, str]]:
    """('item' or 'sub', number, text) of a paragraph that goes on with a list whose next item is `number` and next lettered one `letter`; empty unless two follow, from the paragraph's beginning."""
    found = []
    for m in _TOKEN.finditer(text):
        if m[1].isdigit():
            if int(m[1]) == number:
                found.append(("item", number, m))
                number, letter = number + 1, 1
        elif ord(m[1]) - 96 == letter:
            found.append(("sub", letter, m))
            letter += 1
    if len(found) < 2 or text[: found[0][2].start()].strip():
        return []
    ends = [f[2].start() for f in found[1:]] + [len(text)]
    return [(kind, n, text[m.end() : end].strip()) for (kind, n, m), end in zip(found, ends)]


CONTINUED = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("text", T.StringType())]))


def list_continuations(nodes: DataFrame, key: str, order: str, kind: str = "kind", text: str = "text", start: str = "start", items: str = "items", subs: str = "subs") -> DataFrame:
    """key, order (of the paragraph), list (place), item (from 0), kind, n, text: what paragraphs right behind a numbered list go on with.

    nodes: of a list, start (first number), items (how many it has) and subs (how
    many lettered ones its last item has). The list before a paragraph is found by
    one window; the items are read from the paragraph alone.
    """
    held = nodes.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    along = Window.partitionBy(key).orderBy(order, F.asc_nulls_first(kind), F.asc_nulls_first(text))
    before = F.lag(F.when(F.col(kind) == "list", F.struct(F.col(order).alias("at"), (F.coalesce(F.col(start), F.lit(1)) + F.col(items)).cast("int").alias("number"), (1 + F.coalesce(F.col(subs), F.lit(0))).cast("int").alias("letter"), F.col(items).alias("items")))).over(along)
    asked = held.withColumn("_l", before).where((F.col(kind) == "paragraph") & (F.col("_l.items") > 0))

    @F.pandas_udf(CONTINUED)
    def read(said: pd.Series, number: pd.Series, letter: pd.Series) -> pd.Series:
        return pd.Series([continued(t or "", n, k) for t, n, k in zip(said, number, letter)])

    found = asked.select(key, order, F.col("_l.at").alias("list"), F.posexplode(read(F.col(text), "_l.number", "_l.letter")).alias("item", "_f"))
    return found.select(key, order, "list", "item", "_f.kind", "_f.n", "_f.text")


def lists_over_columns(nodes: DataFrame, model: DataFrame, page: list[str], node: str, order: str, kind: str = "kind", ordered: str = "ordered") -> DataFrame:
    """page, node, into: bulleted lists that go on with one that ends the column before, on the same page and in the same band of the column model (layout.column_model), with nothing read between them.

    A list opens the next column where its top lies near the band's upper edge.
    Lists over three columns go into the first.
    """
    box = F.col("l").isNotNull() & F.col("b").isNotNull() & F.col("r").isNotNull() & F.col("t").isNotNull()
    held = nodes.where(box & F.col(order).isNotNull()).select(*page, node, order, kind, ordered, "l", "b", "r", "t")
    lists = held.where(F.col(kind) == "list").join(model.select(*page, "band", "y0", "y1", "cols"), page)
    tall = F.greatest(F.lit(0.0), F.least("t", "y1") - F.greatest("b", "y0"))
    best = lists.groupBy(*page, node, "l", "r", "t").agg(F.min(F.struct((-tall).alias("v"), "band", "y1", "cols")).alias("m")).where("m.v < 0 AND size(m.cols) >= 2")
    share = F.transform("m.cols", lambda c: F.greatest(F.lit(0.0), F.least(F.col("r"), c.x1) - F.greatest(F.col("l"), c.x0)))
    at = best.select(*page, node, F.col("m.band").alias("band"), (F.array_position(share, F.array_max(share)) - 1).alias("col"), (F.col("t") >= F.col("m.y1") - TOP).alias("top"))
    read = held.select(*page, node, order, F.when((F.col(kind) == "list") & F.col(ordered).isNull(), F.lit(True)).otherwise(F.lit(False)).alias("bullets")).join(at, [*page, node], "left")
    along = Window.partitionBy(*page).orderBy(order, node)
    before = F.lag(F.struct("bullets", "band", "col")).over(along)
    seen = read.withColumn("_p", before)
    goes = F.coalesce(F.col("bullets") & F.col("_p.bullets") & (F.col("band") == F.col("_p.band")) & (F.col("col") == F.col("_p.col") + 1) & F.col("top"), F.lit(False))
    chains = seen.withColumn("_go", goes).withColumn("_first", F.last(F.when(~F.col("_go"), F.col(node)), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return chains.where("_go").select(*page, node, F.col("_first").alias("into"))
