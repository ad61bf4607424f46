"""A graph of what is mentioned together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(*parts: Column) -> Column:
    return F.concat(F.lit("g_"), F.substring(F.sha1(F.to_json(F.array(*[p.cast("string") for p in parts]))), 1, 12))


def nodes(mentions: DataFrame, kind: str, label: str, doc: str) -> DataFrame:
    """id, kind, label, mentions, n_documents."""
    found = mentions.where(F.col(label).isNotNull()).groupBy(kind, label).agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct(doc).alias("n_documents"))
    return found.select(digest(F.col(kind), F.col(label)).alias("id"), kind, label, "mentions", "n_documents")


def comentions(leaves: DataFrame, names: Column, doc: str) -> DataFrame:
    """source, target, n, n_documents: pairs of different names in one leaf, in alphabetical order.

    names is a short array per leaf (extractors bound it), so pairs are made inside the row.
    """
    ordered = F.array_sort(F.array_distinct(names))
    pairs = F.flatten(F.transform(ordered, lambda x, i: F.transform(F.slice(ordered, i + 2, F.greatest(F.lit(0), F.size(ordered) - i - 1)), lambda y: F.struct(x.alias("source"), y.alias("target")))))
    return leaves.select(doc, F.explode(pairs).alias("p")).groupBy("p.source", "p.target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(doc).alias("n_documents"))
