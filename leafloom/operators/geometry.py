"""Boxes (l, b, r, t; origin at the bottom left): predicates as Columns, reading order page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grouped import grouped


def overlap_area(a: str, b: str) -> Column:
    """Area that the boxes of two sides share; a and b are column prefixes."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(a + hi), F.col(b + hi)) - F.greatest(F.col(a + lo), F.col(b + lo)))
    return side("l", "r") * side("b", "t")


def area(a: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(a + "r") - F.col(a + "l")) * F.greatest(F.lit(0.0), F.col(a + "t") - F.col(a + "b"))


def overlap_share(a: str, b: str) -> Column:
    """Shared area over a's own."""
    return F.coalesce(overlap_area(a, b) / F.nullif(area(a), F.lit(0.0)), F.lit(0.0))


def centre_inside(a: str, b: str) -> Column:
    x, y = (F.col(a + "l") + F.col(a + "r")) / 2, (F.col(a + "b") + F.col(a + "t")) / 2
    return (x >= F.col(b + "l")) & (x <= F.col(b + "r")) & (y >= F.col(b + "b")) & (y <= F.col(b + "t"))


def near(a: str, b: str, gap: float) -> Column:
    return (F.col(a + "l") <= F.col(b + "r") + gap) & (F.col(b + "l") <= F.col(a + "r") + gap) & (F.col(a + "b") <= F.col(b + "t") + gap) & (F.col(b + "b") <= F.col(a + "t") + gap)


def region_votes(blocks: DataFrame, regions: DataFrame, page: str, block: str, role: str) -> DataFrame:
    """Each block's role by area-weighted vote of the regions of its page that overlap it, and how much of it they cover (at most 1)."""
    votes = blocks.join(regions, page).withColumn("_a", overlap_area("", "r_")).where("_a > 0").groupBy(page, block, role).agg(F.sum("_a").alias("_a"), F.min(area("")).alias("_own"))
    best = votes.groupBy(page, block).agg(F.min(F.struct((-F.col("_a")).alias("v"), F.col(role))).alias("m"), F.sum("_a").alias("_all"), F.min("_own").alias("_own"))
    return best.select(page, block, F.col("m")[role].alias(role), F.least(F.lit(1.0), F.col("_all") / F.col("_own")).alias("coverage"))


def _valley(boxes: list[tuple], ids: list[int], lo: int, gap: float) -> tuple[list[int], list[int]] | None:
    """The two sides of the widest empty band across one axis, if it is at least `gap` wide."""
    ranked = sorted(ids, key=lambda k: (boxes[k][lo], k))
    reach, widest, at = boxes[ranked[0]][lo + 2], -1.0, 0
    for n, k in enumerate(ranked[1:], 1):
        width = boxes[k][lo] - reach
        if width >= gap and width > widest:
            widest, at = width, n
        reach = max(reach, boxes[k][lo + 2])
    return (ranked[:at], ranked[at:]) if at else None


def _side_by_side(boxes: list[tuple], left: list[int], right: list[int]) -> bool:
    """Whether two sides stand next to each other: they share half the height of the lower one."""
    span = [(min(boxes[k][1] for k in side), max(boxes[k][3] for k in side)) for side in (left, right)]
    shared = min(span[0][1], span[1][1]) - max(span[0][0], span[1][0])
    return shared >= 0.5 * max(1.0, min(hi - lo for lo, hi in span))


def cut(boxes: list[tuple], gap: float) -> list[int]:
    """Reading order by recursive cuts. boxes: (l, b, r, t).

    Columns first: a gutter between sides that stand next to each other is cut
    before any band, left side first; else the widest band, upper side first. Where
    neither is free, the uppermost box that alone closes a gutter is read between
    what lies above and below its middle; else by tops, then left edges.
    """
    order: list[int] = []
    todo = [list(range(len(boxes)))]
    while todo:
        ids = todo.pop()
        if len(ids) < 2:
            order += ids
            continue
        columns = _valley(boxes, ids, 0, gap)
        if columns and _side_by_side(boxes, *columns):
            todo += [columns[1], columns[0]]  # the last is taken first
            continue
        bands = _valley(boxes, ids, 1, gap)
        if bands:
            todo += [bands[0], bands[1]]
            continue
        for k in sorted(ids, key=lambda k: (-boxes[k][3], boxes[k][0], k)):
            others = [j for j in ids if j != k]
            free = _valley(boxes, others, 0, gap) if len(others) > 1 else None
            if free and _side_by_side(boxes, *free):
                middle = boxes[k][1] + boxes[k][3]
                above = [j for j in others if boxes[j][1] + boxes[j][3] > middle]
                todo += [[j for j in others if j not in set(above)], [k], above]
                break
        else:
            order += sorted(ids, key=lambda k: (-boxes[k][3], boxes[k][0], k))
    return order


def reading_order(blocks: DataFrame, page: list[str], block: str, gap: float = 8.0) -> DataFrame:
    """page columns, block, place (from 0). A page is a unit of layout: its blocks are few, and one task takes it whole."""
    rows = blocks.select(*page, block, "l", "b", "r", "t")
    n = len(page) + 1
    schema = T.StructType([*rows.schema.fields[:n], T.StructField("place", T.LongType())])

    def work(group: list[tuple]) -> list[tuple]:
        return [(*group[k][:n], place) for place, k in enumerate(cut([g[n:] for g in group], gap))]

    return grouped(rows, page, [block, "l", "b", "r", "t"], work, schema)


def near_groups(boxes: list[tuple], gap: float) -> list[int]:
    """The group of each box: boxes within gap of each other, and what that reaches. Groups are numbered by their first box.

    One sweep from left to right: a box is held against those still open.
    """
    parent = list(range(len(boxes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    open_: list[int] = []
    for k in sorted(range(len(boxes)), key=lambda k: (boxes[k][0], k)):
        left, low, _, high = boxes[k]
        open_ = [j for j in open_ if boxes[j][2] + gap >= left]
        for j in open_:
            if boxes[j][1] <= high + gap and low <= boxes[j][3] + gap:
                a, b = find(j), find(k)
                parent[max(a, b)] = min(a, b)
        open_.append(k)
    return [find(k) for k in range(len(boxes))]


def clusters(boxes: DataFrame, page: list[str], box: str, gap: float = 8.0) -> DataFrame:
    """page columns, box, cluster (from 0 in each page)."""
    rows = boxes.select(*page, box, "l", "b", "r", "t")
    n = len(page) + 1
    schema = T.StructType([*rows.schema.fields[:n], T.StructField("cluster", T.LongType())])
    return grouped(rows, page, [box, "l", "b", "r", "t"], lambda g: [(*r[:n], c) for r, c in zip(g, near_groups([x[n:] for x in g], gap))], schema)
