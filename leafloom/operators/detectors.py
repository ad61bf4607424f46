"""Typed candidates of seven families from lines by plain patterns; `scan` has all families and their rules.

A candidate has document, type, layer, confidence, detector, quote, value and a
digest for an id. Confidences are fixed per family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as t

# Type -> (layer, confidence).
KINDS = {
    "legal_reference": (0, 0.82),
    "funding_event": (1, 0.76),
    "statistic": (0, 0.72),
    "date_time_period": (0, 0.78),
    "question": (1, 0.82),
    "named_entity": (0, 0.66),
    "label_value": (0, 0.72),
}

LEGAL = r"((?:H\.R\.|S\.) ?[0-9]+|[0-9]+ U\.S\.C\. [0-9]+|Section [0-9]+(?:\([a-z0-9]\))*)"


def values_of(kind: str, line: Column) -> Column:
    """What a family finds in a line, as an array of strings."""
    if kind == "legal_reference":
        return t.extract_all(line, LEGAL)
    if kind == "funding_event":
        return F.when(line.rlike(t.FUNDING), t.extract_all(line, t.MONEY)).otherwise(F.array().cast("array<string>"))
    if kind == "date_time_period":
        return t.extract_all(line, t.DATE)
    if kind == "statistic":  # numbers outside money, dates and legal references
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, t.MONEY, " "), t.DATE, " "), LEGAL, " ")
        return t.extract_all(bare, r"(?:^|[^A-Za-z0-9#.,-])([0-9][0-9,]*(?:\.[0-9]+)?%?)")
    if kind == "question":
        return F.when(line.rlike(t.QUESTION), F.array(F.trim(line))).otherwise(F.array().cast("array<string>"))
    if kind == "named_entity":
        return t.entities(line)
    if kind == "label_value":
        return F.when(line.rlike(t.LABEL_VALUE), F.array(F.regexp_extract(line, t.LABEL_VALUE, 2))).otherwise(F.array().cast("array<string>"))
    raise KeyError(kind)


def candidates(leaves: DataFrame, doc_id: str, order: str, line: str, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """document_id, ord, pattern_type, layer, confidence, quote, value, pattern_id; each distinct value once per document and type.

    All families are found in one scan of the leaves: a map of arrays is exploded, not a union of scans.
    """
    found = F.array(*[F.struct(F.lit(k).alias("pattern_type"), F.lit(KINDS[k][0]).alias("layer"), F.lit(KINDS[k][1]).alias("confidence"), values_of(k, F.col(line)).alias("found")) for k in kinds])
    each = leaves.select(F.col(doc_id).alias("document_id"), F.col(order).alias("ord"), t.clean_quote(F.col(line)).alias("quote"), F.explode(found).alias("f")).where(F.size("f.found") > 0)
    rows = each.select("document_id", "ord", "quote", "f.pattern_type", "f.layer", "f.confidence", F.explode("f.found").alias("value"))
    first = rows.groupBy("document_id", "pattern_type", "value").agg(F.min_by(F.struct("ord", "layer", "confidence", "quote"), F.struct("ord", "quote")).alias("x"))
    digest = F.concat(F.lit("c_"), F.substring(F.sha1(F.to_json(F.array(F.col("document_id").cast("string"), "pattern_type", "value"))), 1, 12))
    return first.select("document_id", "x.ord", "pattern_type", "x.layer", "x.confidence", "x.quote", "value", digest.alias("pattern_id"))


def inventory(found: DataFrame) -> DataFrame:
    return found.groupBy("pattern_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("n_documents"))


def page_inventory(found: DataFrame, page: Column) -> DataFrame:
    return found.groupBy(page.alias("page"), "pattern_type").agg(F.count(F.lit(1)).alias("n")).groupBy("page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pattern_type", "n")))).alias("types"))


def review_focus(found: DataFrame, most: int = 3) -> DataFrame:
    """Per type its count and the `most` best: by confidence, then order, then id."""
    # Spark keeps only the first `most` of each task before the shuffle (window group limit)
    w = Window.partitionBy("pattern_type").orderBy(F.desc("confidence"), "ord", "document_id", "pattern_id")
    best = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).groupBy("pattern_type").agg(F.array_sort(F.collect_list(F.struct("_r", "pattern_id"))).alias("b"))
    counts = found.groupBy("pattern_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(best, "pattern_type").select("pattern_type", "n", F.transform("b", lambda x: x["pattern_id"]).alias("best"))
