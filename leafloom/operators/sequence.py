"""Order-dependent passes over a document's leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grouped import grouped


def joined(leaves: DataFrame, key: str, order: str, text: str, continues: Column) -> DataFrame:
    """Leaves that continue the one before them are joined to it: key, ord (of the first), n, text."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = leaves.withColumn("_new", F.when(F.coalesce(continues, F.lit(False)), 0).otherwise(1)).withColumn("_part", F.sum("_new").over(w))
    parts = opened.groupBy(key, "_part").agg(F.min(order).alias("ord"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text)))).alias("_t"))
    return parts.select(key, "ord", "n", F.array_join(F.transform("_t", lambda x: x[text]), " ").alias("text"))


def sequenced(markers: list[int | None]) -> list[int | None]:
    """Note numbers in order: what fits the count goes on (one may be missing), a lone jump is a misreading and takes the expected number."""
    out: list[int | None] = []
    expected = 1
    for k, m in enumerate(markers):
        follows = next((x for x in markers[k + 1 :] if x is not None), None)
        if m is None:
            out.append(None)
            continue
        if m in (expected, expected + 1) or m == 1:
            number = m
        elif follows == m + 1:
            number = m  # a new run, confirmed by what comes next
        else:
            number = expected
        out.append(number)
        expected = number + 1
    return out


def note_numbers(notes: DataFrame, key: str, order: str, marker: str) -> DataFrame:
    """notes (key, order, marker) with number. One document's notes are few and strictly sequential."""
    rows = notes.select(key, order, marker)
    schema = T.StructType([*rows.schema.fields, T.StructField("number", T.IntegerType())])
    return grouped(rows, [key], [order, marker], lambda g: [(*r, n) for r, n in zip(g, sequenced([m for _, _, m in g]))], schema)


def cover(group: list[tuple], cap: int) -> list:
    """Pages of (page, weight, signature, features): the heaviest of each signature, in order of signatures (the caller puts the largest first), then the heaviest for each feature not shown yet."""
    ranked = sorted(group, key=lambda r: (-(r[1] or 0), r[0]))
    members: dict = {}
    for r in ranked:
        members.setdefault(r[2], []).append(r)
    chosen = [rows[0] for _, rows in sorted(members.items())][:cap]
    shown = {f for r in chosen for f in r[3] or ()}
    for r in ranked:
        if len(chosen) < cap and set(r[3] or ()) - shown:
            chosen.append(r)
            shown.update(r[3])
    return [r[0] for r in chosen]


def covering_pages(pages: DataFrame, key: str, page: str, weight: str, signature: str, features: str, cap: int = 10) -> DataFrame:
    """key, page, pick (from 1): at most `cap` pages of each key, as cover() chooses them.

    Before the shuffle only a signature's and a feature set's heaviest pages are
    kept, with the signature's size beside, so a key of any size is a short list.
    """
    w = Window.partitionBy(key, signature, features).orderBy(F.desc_nulls_last(weight), page)
    first = pages.select(key, page, weight, signature, features).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    sizes = pages.groupBy(key, signature).agg(F.count(F.lit(1)).alias("_n"))
    rows = first.join(sizes, [key, signature]).select(key, page, weight, signature, features, "_n")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("pick", T.IntegerType())])

    def work(group: list[tuple]) -> list[tuple]:
        listed = [(p, w_, (-n, s), f) for _, p, w_, s, f, n in group]
        return [(group[0][0], p, k) for k, p in enumerate(cover(listed, cap), 1)]

    return grouped(rows, [key], [page], work, schema)


def ordinal_lists(leaves: DataFrame, key: str, order: str, number: Column, least: int = 2) -> DataFrame:
    """Leaves whose numbers count up by one from leaf to leaf: key, first (order), start (number), n; at least `least` of them."""
    w = Window.partitionBy(key).orderBy(order)
    placed = leaves.withColumns({"_n": number, "_p": F.row_number().over(w)}).where("_n IS NOT NULL")
    # leaf place and number go up together inside a list
    islands = placed.withColumn("_d", F.col("_n") - F.col("_p")).withColumn("_g", F.col("_p") - F.row_number().over(Window.partitionBy(key, "_d").orderBy("_p")))
    return islands.groupBy(key, "_d", "_g").agg(F.min(order).alias("first"), F.min("_n").alias("start"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_d", "_g")


def marked_lists(leaves: DataFrame, key: str, order: str, marked: Column, least: int = 3) -> DataFrame:
    """Unbroken stretches of marked leaves: key, first, n; at least `least` of them."""
    w = Window.partitionBy(key).orderBy(order)
    placed = leaves.withColumns({"_m": F.coalesce(marked, F.lit(False)), "_p": F.row_number().over(w)}).where("_m")
    islands = placed.withColumn("_g", F.col("_p") - F.row_number().over(Window.partitionBy(key).orderBy("_p")))
    return islands.groupBy(key, "_g").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_g")
