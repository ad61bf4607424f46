"""Order-dependent operators as windows: intervals, islands, budgets, boundaries, ranks and modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import new_folder


def merged_intervals(df: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """Overlapping or touching intervals of a key become one: key, lo, hi, n."""
    w = Window.partitionBy(key).orderBy(lo, hi)
    before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.when(before.isNull() | (F.col(lo) > before), 1).otherwise(0))
    numbered = opened.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "_island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count(F.lit(1)).alias("n")).drop("_island")


def interior_gaps(df: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """What lies between a key's merged intervals: key, gap_lo, gap_hi."""
    merged = merged_intervals(df, key, lo, hi)
    following = F.lead("lo").over(Window.partitionBy(key).orderBy("lo"))
    return merged.select(key, F.col("hi").alias("gap_lo"), following.alias("gap_hi")).where("gap_hi IS NOT NULL")


def chains(df: DataFrame, key: str, value: str, reach: float) -> DataFrame:
    """1-D clustering: neighbours within reach share a cluster, numbered from 0 in each key."""
    w = Window.partitionBy(key).orderBy(value)
    jump = (F.col(value) - F.lag(value).over(w) > reach).cast("int")
    return df.withColumn("cluster", F.coalesce(F.sum(jump).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)).cast("long"))


def compressed_runs(df: DataFrame, key: str, value: str) -> DataFrame:
    """Whole numbers as runs, in order: key, runs ("1-3,5")."""
    distinct = df.select(key, value).distinct()
    islands = distinct.withColumn("_i", F.col(value) - F.row_number().over(Window.partitionBy(key).orderBy(value)))
    runs = islands.groupBy(key, "_i").agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    label = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("string")).otherwise(F.concat_ws("-", F.col("_a").cast("string"), F.col("_b").cast("string")))
    return runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_a", label.alias("l")))).alias("_r")).select(key, F.concat_ws(",", F.transform("_r", lambda x: x["l"])).alias("runs"))


def within_budget(df: DataFrame, key: str, order: str, size: Column, budget: int) -> DataFrame:
    """A key's rows in order, up to but not with the first that would exceed the budget."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def sections(df: DataFrame, key: str, order: str, is_heading: Column) -> DataFrame:
    """Rows with the order of the heading they stand under, and of the next one."""
    w = Window.partitionBy(key).orderBy(order)
    head = F.when(is_heading, F.col(order))
    return df.withColumns({"section": F.last(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "next_section": F.first(head, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})


def interpolated(df: DataFrame, key: str, order: str, pin: Column) -> DataFrame:
    """Rows without a pinned rank follow the last pinned row before them: pin, then place behind it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_pin", pin).withColumns({"rank_base": F.coalesce(F.last("_pin", ignorenulls=True).over(w), F.lit(0)), "_block": F.count("_pin").over(w)}).withColumn("rank_step", F.row_number().over(Window.partitionBy(key, "_block").orderBy(order)) - 1).drop("_pin", "_block")


def levels(df: DataFrame, size: str, least: float, most: int = 6) -> DataFrame:
    """Distinct sizes above `least`, largest first, as levels 1 .. most. Sizes are few: they are made distinct before the one sort."""
    sizes = df.select(size).where(F.col(size) > least).distinct()
    return sizes.withColumn("level", F.least(F.lit(most), F.dense_rank().over(Window.orderBy(F.desc(size)))))


def weighted_mode(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """The value of most weight in each key; ties to the smallest value."""
    sums = df.groupBy(key, value).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(key).agg(F.min(F.struct((-F.col("_w")).alias("w"), F.col(value).alias("v"))).alias("_m")).select(key, F.col("_m.v").alias(value), (-F.col("_m.w")).alias("weight"))


def least_of_share(df: DataFrame, key: str, value: str, weight: str, share: float) -> DataFrame:
    """The least value among those with at least `share` of the key's weight; among all, if none has."""
    sums = df.groupBy(key, value).agg(F.sum(weight).alias("_w"))
    shares = sums.withColumn("_s", F.col("_w") / F.sum("_w").over(Window.partitionBy(key)))
    return shares.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("_s") >= share, F.col(value))), F.min(value)).alias(value))


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """df with place, the row's number in the order. Ranges are sorted and counted each by a task; only their counts meet."""
    path = new_folder(df.sparkSession, "placed")
    df.sort(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_range", F.shiftright("_id", 33))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    return rows.join(F.broadcast(starts), "_range").withColumn("place", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_range", "_id", "_before")


def placed_within(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """df with place, the row's number in its group's order; a group of any size is spread over tasks.

    All rows are placed in the order of key, then `order`; a group's first place is taken off.
    """
    all_ = placed(df, *[F.col(k) for k in keys], *order)
    first = all_.groupBy(*keys).agg(F.min("place").alias("_first"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    joined = all_.alias("a").join(first.alias("f"), same)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a.place") - F.col("f._first") + 1).alias("place"))
