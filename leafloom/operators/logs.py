"""Append-only logs: latest-wins views and what is counted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], time: str, line: str) -> DataFrame:
    """The last row of each key; of rows equal in time, the later line wins. Rows with a null key go.

    An aggregate, not a window: partial maxima are taken before the shuffle, so a
    key with a third of all rows moves only one row from each task.
    """
    rest = [c for c in log.columns if c not in keys]
    order = F.struct(F.col(time), F.col(line))
    known = log.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    out = known.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return out.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def conflicts(log: DataFrame, keys: list[str], decision: str, time: str, line: str) -> DataFrame:
    """Keys with more than one distinct decision: the sorted decisions, the latest one, the number of rows."""
    order = F.struct(F.col(time), F.col(line))
    return (
        log.groupBy(*keys)
        .agg(F.array_sort(F.collect_set(decision)).alias("decisions"), F.max_by(decision, order).alias("latest"), F.count(F.lit(1)).alias("n_rows"))
        .where(F.size("decisions") > 1)
    )


def quality(log: DataFrame, kind: str, accepted: Column, rejected: Column, gap: Column) -> DataFrame:
    """Per kind: reviewed, accepted, rejected, those that a review leaves open, and the share of all reviewed that is accepted."""
    yes = F.count_if(accepted)
    return log.groupBy(kind).agg(F.count(F.lit(1)).alias("reviewed"), yes.alias("accepted"), F.count_if(rejected).alias("rejected"), F.count_if(gap).alias("review_gap"), F.round(yes / F.count(F.lit(1)), 3).alias("acceptance_rate"))


def rollup_counts(log: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by a and by a x b, and of all rows."""
    return log.rollup(a, b).agg(F.count(F.lit(1)).alias("n"))


def recent(log: DataFrame, time: str, line: str, most: int) -> DataFrame:
    return log.orderBy(F.desc(time), F.desc(line)).limit(most)


def stale(reviews: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Reviews whose subject is no longer there."""
    return reviews.join(current.select(*keys).distinct(), keys, "left_anti")


def top_values(log: DataFrame, values: Column, most: int) -> DataFrame:
    """The most frequent values of an array column; ties by value."""
    return log.select(F.explode(values).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)


def upsert(held: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """held with the rows of changes put in place of those of the same key, or added."""
    return held.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def term_stats(terms: DataFrame, term: str, page: str, example: str, most: int = 3) -> DataFrame:
    """Per term, whatever its case: n, its most frequent spelling, number of pages, the first few distinct examples."""
    key = F.lower(term).alias("key")
    spellings = terms.groupBy(key, term).agg(F.count(F.lit(1)).alias("_n"))
    best = spellings.groupBy("key").agg(F.sum("_n").alias("n"), F.min_by(F.col(term), F.struct((-F.col("_n")).alias("a"), F.col(term))).alias("spelling"))
    pages = terms.groupBy(key).agg(F.count_distinct(page).alias("n_pages"))
    w = Window.partitionBy("key").orderBy(example)
    few = terms.select(key, example).distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).groupBy("key").agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return best.join(pages, "key").join(few, "key")


def usage_summary(calls: DataFrame, kind: str, tokens: str, cost: str) -> DataFrame:
    """Per kind: calls, tokens, the cost that is known, and whether all of it is."""
    return calls.groupBy(kind).agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("tokens"), F.round(F.sum(cost), 2).alias("cost"), F.bool_and(F.col(cost).isNotNull()).alias("complete"))
