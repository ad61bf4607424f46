"""Matching: token overlap through an inverted index, nearest in time, reconciliation both ways, containment, fuzzy."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import tokens


def best_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str = "text", least: float = 0.0) -> DataFrame:
    """For each left row the right row of highest token overlap (ties: smallest id), if above `least`.

    The score is the Jaccard similarity, or 0.85 of the share of the shorter text's
    tokens that the other has, if that is more and both have four tokens. Tokens are joined through an inverted index, never all rows with all rows.
    """
    a = left.select(F.col(left_id).alias("a"), tokens(F.col(text)).alias("ta"))
    b = right.select(F.col(right_id).alias("b"), tokens(F.col(text)).alias("tb"))
    ia = a.select("a", F.size("ta").alias("na"), F.explode("ta").alias("t"))
    ib = b.select("b", F.size("tb").alias("nb"), F.explode("tb").alias("t"))
    both = ia.join(ib, "t").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    jaccard, fewer = F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), F.least("na", "nb")
    score = F.when(fewer >= 4, F.greatest(jaccard, F.col("n") / fewer * 0.85)).otherwise(jaccard)
    scored = both.select("a", "b", score.alias("score")).where(F.col("score") > least)
    best = scored.groupBy("a").agg(F.max(F.struct("score", (-F.col("b")).alias("back"))).alias("m"))
    return best.select(F.col("a").alias(left_id), (-F.col("m.back")).alias(right_id), F.round("m.score", 6).alias("score"))


def nearest_before(left: DataFrame, right: DataFrame, key: str, time: str, value: str, line: str) -> DataFrame:
    """left with the last `value` of right at or before its time (as-of), by one sort of the union; no pairs are made."""
    a = left.withColumns({"_right": F.lit(0), "_seen": F.lit(None).cast(right.schema[value].dataType), "_line": F.col(line)})
    b = right.select(key, time, F.col(value).alias("_seen"), F.col(line).alias("_line"), F.lit(1).alias("_right"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, F.desc("_right"), "_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("nearest", F.last("_seen", ignorenulls=True).over(w)).where("_right = 0").drop("_right", "_seen", "_line")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of either side with what is missing: `both`, `left_only` or `right_only`."""
    a = left.select(key).distinct().withColumn("_a", F.lit(1))
    b = right.select(key).distinct().withColumn("_b", F.lit(1))
    state = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    return a.join(b, key, "full").select(key, state.alias("status"))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, 0 to 1; null where a side is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def letter_bound(a: Column, b: Column) -> Column:
    """What the similarity of two texts can be at most: twice the letters they share over all letters."""
    shared = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.least(_count(a, x), _count(b, x)))
    return F.lit(2.0) * shared(F.array_distinct(F.split(a, ""))) / F.nullif(F.length(a) + F.length(b), F.lit(0))


def _count(text: Column, letter: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, letter, F.lit("")))


def fuzzy_remap(old: DataFrame, new: DataFrame, block: list[str], old_id: str, new_id: str, text: str, least: float = 0.6) -> DataFrame:
    """Each old row's best new row of the same block by similarity; equal texts first, ties by smallest id.

    Equal texts meet by an equality join with one new row each, and their old rows
    are done. The others are held against the distinct texts of their block: a pair
    whose lengths, or then whose letters, can't reach `least` isn't compared. Each
    different text of a block is compared once, however many rows have it.
    """
    texts = new.groupBy(*block, F.col(text).alias("_b")).agg(F.min(new_id).alias("_new")).where("_b IS NOT NULL")
    asked = old.select(*block, F.col(old_id), F.col(text).alias("_a")).where("_a IS NOT NULL")
    exact = asked.join(texts.withColumnRenamed("_b", "_a"), [*block, "_a"]).select(old_id, "_new", F.lit(1.0).alias("ratio"))
    rest = asked.join(texts.select(*block, F.col("_b").alias("_a")), [*block, "_a"], "left_anti")
    shorter, longer = F.least(F.length("_a"), F.length("_b")), F.greatest(F.length("_a"), F.length("_b"))
    near = rest.select(*block, "_a").distinct().join(texts, block).where(2 * shorter >= least * (shorter + longer)).where(letter_bound(F.col("_a"), F.col("_b")) >= least - 1e-9)
    scored = near.select(*block, "_a", "_new", similarity("_a", "_b").alias("ratio")).where(F.col("ratio") >= least)
    best = scored.groupBy(*block, "_a").agg(F.max(F.struct("ratio", (-F.col("_new")).alias("back"))).alias("m")).select(*block, "_a", (-F.col("m.back")).alias("_new"), "m.ratio")
    found = exact.unionByName(rest.join(best, [*block, "_a"]).select(old_id, "_new", "ratio"))
    return found.groupBy(old_id).agg(F.max(F.struct("ratio", (-F.col("_new")).alias("back"))).alias("m")).select(old_id, (-F.col("m.back")).alias(new_id), F.round("m.ratio", 6).alias("ratio"))
