"""Columns, reading order and tables from boxes (l, b, r, t; origin at the bottom left).

Nulls: rows without a box or a page are not laid out and give no rows. Equal rows
count as they stand. An empty table gives an empty result. Everything is grouped
by page; a page is a unit of layout, and its boxes are what one task holds at most.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grouped import grouped
from ..plans.storage import stored

#: Narrower gaps between lines are raggedness inside a column.
LEAST_GUTTER = 10.0
#: Distance of the places where a band's lines are counted.
STEP = 2.0
#: A gutter of this width is beyond doubt.
COMFORTABLE = 18.0
#: Bands lower than this hold nothing.
LEAST_BAND = 4.0

BOX = ("l", "b", "r", "t")


def _boxed(df: DataFrame, page: list[str]) -> DataFrame:
    ok = F.lit(True)
    for c in (*page, *BOX):
        ok &= F.col(c).isNotNull()
    return df.where(ok).withColumns({c: F.col(c).cast("double") for c in BOX})


def bands(blocks: DataFrame, page: list[str]) -> tuple[DataFrame, DataFrame]:
    """Horizontal bands between blocks that span the page (page, band, y0, y1, left, right), and the blocks that don't.

    A block spans that is at least 0.6 of the content and 1.3 of the median width.
    """
    width = F.col("r") - F.col("l")
    held = _boxed(blocks, page)
    median = F.when(F.row_number().over(Window.partitionBy(*page).orderBy(width)) == F.floor(F.count(F.lit(1)).over(Window.partitionBy(*page)) / 2) + 1, width)
    stats = (
        held.withColumn("_m", median)
        .groupBy(*page)
        .agg(F.min("l").alias("left"), F.max("r").alias("right"), F.min("b").alias("_low"), F.max("t").alias("_high"), F.max("_m").alias("_m"), F.count(F.lit(1)).alias("_n"))
        .where("_n >= 2 AND right > left")
        .withColumn("_span", F.greatest(0.6 * (F.col("right") - F.col("left")), 1.3 * F.col("_m")))
    )
    sized = held.join(stats, page)
    inner = F.when(width >= F.col("_span"), F.filter(F.array(F.round("b", 1), F.round("t", 1)), lambda y: (F.col("_low") < y) & (y < F.col("_high"))))
    edges = sized.select(*page, F.explode(F.array_distinct(F.concat(F.coalesce(inner, F.array().cast("array<double>")), F.array("_low", "_high")))).alias("y")).distinct()
    down = Window.partitionBy(*page).orderBy(F.desc("y"))
    pairs = edges.select(*page, F.col("y").alias("y1"), F.lead("y").over(down).alias("y0")).where(F.col("y1") - F.col("y0") >= LEAST_BAND)
    found = pairs.withColumn("band", F.row_number().over(Window.partitionBy(*page).orderBy(F.desc("y1"))) - 1).join(stats.select(*page, "left", "right"), page)
    return found.select(*page, "band", "y0", "y1", "left", "right"), sized.where(width < F.col("_span")).select(*page, *[c for c in blocks.columns if c not in page])


def profile(lines: DataFrame, band: list[str]) -> DataFrame:
    """How many lines of a band cover each place between its edges: band columns, lo, hi, n, k0, k1, crossing for places lo + STEP * k, k from k0 to k1.

    A sweep over line edges: each line adds one where it begins and takes one where
    it ends, and a running sum gives the coverage.
    """
    ends = lines.groupBy(*band).agg(F.min("l").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("n")).withColumn("_last", F.ceil((F.col("hi") - STEP - F.col("lo")) / STEP) - 1)
    first, last = F.floor((F.col("l") - F.col("lo")) / STEP) + 1, F.ceil((F.col("r") - F.col("lo")) / STEP) - 1
    step = lambda k, d: F.struct(k.cast("long").alias("k"), F.lit(d).alias("d"))
    spans = lines.join(ends, band).select(*band, "_last", F.greatest(F.lit(1), first).alias("a"), F.least(F.col("_last"), last).alias("z"))
    edges = F.array(step(F.lit(1), 0), step(F.col("_last") + 1, 0))  # a band is covered from end to end, whatever its lines cover
    steps = F.when(F.col("a") <= F.col("z"), F.concat(F.array(step(F.col("a"), 1), step(F.col("z") + 1, -1)), edges)).otherwise(edges)
    summed = spans.select(*band, F.explode(steps).alias("e")).groupBy(*band, F.col("e.k").alias("k")).agg(F.sum("e.d").alias("d"))
    along = Window.partitionBy(*band).orderBy("k")
    runs = summed.select(*band, F.col("k").alias("k0"), (F.lead("k").over(along) - 1).alias("k1"), F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("crossing"))
    return ends.join(runs.where("k1 IS NOT NULL"), band).where("k0 <= _last").select(*band, "lo", "hi", "n", "k0", "k1", "crossing")


def gutters(lines: DataFrame, band: list[str]) -> DataFrame:
    """band columns, x0, x1, bridged, n: stretches that few lines of the band cross, with two lines at least on either side."""
    n = F.col("n")
    allowed = F.greatest(F.when(n >= 12, 1).otherwise(0), F.rint(0.06 * n).cast("int"))
    along = Window.partitionBy(*band).orderBy("k0").rowsBetween(Window.unboundedPreceding, 0)
    open_ = profile(lines, band).withColumn("_ok", F.col("crossing") <= allowed)
    parts = open_.withColumn("_g", F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(along)).where("_ok")
    runs = parts.groupBy(*band, "_g").agg((F.min("lo") + STEP * F.min("k0")).alias("x0"), (F.min("lo") + STEP * F.max("k1")).alias("x1"), F.max("crossing").alias("bridged"), F.min("n").alias("n")).where(F.col("x1") - F.col("x0") >= LEAST_GUTTER).drop("_g")
    sides = runs.join(lines.select(*band, "l", "r"), band).groupBy(*band, "x0", "x1", "bridged", "n")
    return sides.agg(F.count_if(F.col("r") <= F.col("x0")).alias("_a"), F.count_if(F.col("l") >= F.col("x1")).alias("_b")).where("_a >= 2 AND _b >= 2").drop("_a", "_b")


def column_model(blocks: DataFrame, lines: DataFrame, page: list[str], block: str) -> DataFrame:
    """One row per band: page, band, y0, y1, n_lines, cols (array of x0, x1), gutters (widths), bridged, n_cols and conf of the page.

    Full-width blocks cut a page into bands; in a band the coverage of the lines of
    its blocks shows the gutters. conf: the narrowest gutter against a comfortable
    one, less the share of lines that bridge it; 1 where there is none. Pages with
    fewer than two blocks have no model.
    """
    found, rest = bands(stored(_boxed(blocks, page), "page-blocks"), page)
    height = F.col("t") - F.col("b")
    shared = F.least("y1", "t") - F.greatest("y0", "b")
    members = rest.join(found.select(*page, "band", "y0", "y1"), page).where(shared > 0.5 * height).select(*page, block, "band")
    held = stored(_boxed(lines, page).join(members, [*page, block]).select(*page, "band", "l", "r"), "band-lines")
    key = [*page, "band"]
    counts = held.groupBy(*key).agg(F.count(F.lit(1)).alias("n_lines"), F.min("l").alias("lo"), F.max("r").alias("hi"))
    between = gutters(held.join(counts.where("n_lines >= 4").select(*key), key), key)
    by_band = between.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("_g"), F.max("bridged").alias("bridged"))
    rows = found.join(counts, key, "left").join(by_band, key, "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0).cast("long")))
    gaps = F.coalesce("_g", F.array().cast("array<struct<x0:double,x1:double>>"))
    narrow = F.col("n_lines") < 4
    left, right = F.when(narrow, F.col("left")).otherwise(F.col("lo")), F.when(narrow, F.col("right")).otherwise(F.col("hi"))
    starts = F.concat(F.array(left), F.transform(gaps, lambda g: g.x1))
    stops = F.concat(F.transform(gaps, lambda g: g.x0), F.array(right))
    cols = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("z")), lambda c: F.struct(F.round(c.a, 1).alias("x0"), F.round(c.z, 1).alias("x1")))
    rows = rows.withColumns({"cols": cols, "gutters": F.transform(gaps, lambda g: F.round(g.x1 - g.x0, 1))})
    worst = F.least(F.array_min("gutters") / COMFORTABLE, F.lit(1.0)) * (1 - F.col("bridged") / F.col("n_lines"))
    whole = Window.partitionBy(*page)
    return rows.select(
        *page, "band", F.round("y0", 1).alias("y0"), F.round("y1", 1).alias("y1"), "n_lines", "cols", "gutters", "bridged", F.max(F.size("cols")).over(whole).alias("n_cols"), F.round(F.coalesce(F.min(worst).over(whole), F.lit(1.0)), 2).alias("conf")
    )


def modelled_order(blocks: DataFrame, model: DataFrame, page: list[str], block: str) -> DataFrame:
    """page, block, place (from 0) of the pages that have a model: by band, then column, then from the top.

    A block that takes up two or more of its band's columns is read between what
    lies above and below its middle. Ties go to the smaller block; equal rows count once.
    """
    held = _boxed(blocks, page).select(*page, block, *BOX).join(model.select(*page, "band", "y0", "y1", "cols"), page)
    tall = F.greatest(F.lit(0.0), F.least("t", "y1") - F.greatest("b", "y0"))
    own = held.withColumn("_tall", tall).groupBy(*page, block, *BOX).agg(F.min(F.struct((-F.col("_tall")).alias("v"), "band", "cols")).alias("m")).select(*page, block, *BOX, "m.band", "m.cols")
    wide = lambda c: F.greatest(F.lit(0.0), F.least(F.col("r"), c.x1) - F.greatest(F.col("l"), c.x0))
    taken = F.filter("cols", lambda c: wide(c) > F.greatest(0.25 * F.least(F.col("r") - F.col("l"), c.x1 - c.x0), F.lit(3 * LEAST_GUTTER)))
    shares = F.transform("cols", wide)
    at = own.withColumns({"_split": (F.size("cols") > 1) & (F.size(taken) >= 2), "_mid": (F.col("b") + F.col("t")) / 2, "_col": F.array_position(shares, F.array_max(shares)) - 1})
    band = Window.partitionBy(*page, "band")
    count = F.sum(F.col("_split").cast("int"))
    above = count.over(band.orderBy(F.desc("_mid"))) - count.over(Window.partitionBy(*page, "band", "_mid"))
    # of splitters at one height the smaller block comes first
    among = F.row_number().over(Window.partitionBy(*page, "band", "_split").orderBy(F.desc("_mid"), block))
    keyed = at.withColumns({"_above": above, "_nth": among})
    sub = F.when(F.col("_split"), 2 * F.col("_nth") - 1).otherwise(2 * F.col("_above"))
    order = [F.col("band"), sub, F.when(F.col("_split"), 0).otherwise(F.col("_col")), F.when(F.col("_split"), 0.0).otherwise(-F.col("t")), F.col("l"), F.col(block)]
    return keyed.select(*page, block, (F.row_number().over(Window.partitionBy(*page).orderBy(*order)) - 1).cast("long").alias("place"))


def precedence(boxes: np.ndarray) -> np.ndarray:
    """before[i, j]: i is read before j: i is the higher of two that share a column, or lies left of j with nothing across the gap between them."""
    l, b, r, t = boxes.T
    share = (l[:, None] < r[None, :]) & (r[:, None] > l[None, :])
    before = share & (t[:, None] > t[None, :])
    left = ~share & (r[:, None] <= l[None, :])
    for i in np.flatnonzero(left.any(axis=1)).tolist():
        to = np.flatnonzero(left[i])
        high, low = np.maximum(t[i], t[to]), np.minimum(b[i], b[to])
        # a box across the gap begins left of i's right edge and ends right of j's left one
        wide = np.flatnonzero(l < r[i])
        across = (r[wide, None] > l[to][None, :]) & (b[wide, None] < high[None, :]) & (t[wide, None] > low[None, :])
        across &= (wide[:, None] != i) & (wide[:, None] != to[None, :])
        before[i, to[~across.any(axis=0)]] = True
    np.fill_diagonal(before, False)
    return before


def topological(boxes: list[tuple]) -> list[tuple[int, bool]]:
    """(box, forced) in order: of those that nothing unread precedes the highest, then leftmost, then first; forced where a circle had to be broken."""
    n = len(boxes)
    before = precedence(np.array(boxes, np.float64).reshape(n, 4))
    waits = before.sum(axis=0)
    rank = lambda k: (-boxes[k][3], boxes[k][0], k)
    ready = [rank(k) for k in range(n) if not waits[k]]
    heapq.heapify(ready)
    every = sorted(rank(k) for k in range(n))
    done, out, at = [False] * n, [], 0
    while len(out) < n:
        if ready:
            k, forced = heapq.heappop(ready)[2], False
            if done[k]:
                continue
        else:
            while done[every[at][2]]:
                at += 1
            k, forced = every[at][2], True
        done[k] = True
        out.append((k, forced))
        for j in np.flatnonzero(before[k]).tolist():
            waits[j] -= 1
            if not waits[j] and not done[j]:
                heapq.heappush(ready, rank(j))
    return out


def topological_order(blocks: DataFrame, page: list[str], block: str) -> DataFrame:
    """page, block, place (from 0), forced: reading order as a topological sort of which block comes before which. One task takes a page whole."""
    rows = _boxed(blocks, page).select(*page, block, *BOX)
    n = len(page) + 1
    schema = T.StructType([*rows.schema.fields[:n], T.StructField("place", T.LongType()), T.StructField("forced", T.BooleanType())])
    return grouped(rows, page, [block, *BOX], lambda g: [(*g[k][:n], place, forced) for place, (k, forced) in enumerate(topological([x[n:] for x in g]))], schema)


def _clustered(xs: DataFrame, key: list[str], gap: float) -> DataFrame:
    """Means of the groups of x that lie less than gap from their neighbour."""
    along = Window.partitionBy(*key).orderBy("x")
    opened = xs.withColumn("_new", F.when(F.col("x") - F.lag("x").over(along) < gap, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return opened.groupBy(*key, "_g").agg(F.avg("x").alias("x")).drop("_g")


def table_grids(regions: DataFrame, marks: DataFrame, blocks: DataFrame, page: str, region: str, block: str) -> tuple[DataFrame, DataFrame]:
    """Cells of the regions whose grid is drawn, and all regions with what became of them.

    regions: page, region, box, strict (sparse ones are refused). marks: page, box,
    filled; drawn paths. blocks: page, region, block, box, text, parts (array: the
    text's stretches of one colour). Cells: page, region, row, col (from 0), span,
    text. Outcomes: page, region, n_blocks, n_rules, n_posts, n_cols, n_rows,
    outcome ('table' or the reason: too-few-blocks, no-grid, no-columns,
    too-few-rows, strict-sparse). A block over several columns is a cell for each
    where its parts are as many as the columns, else one cell over them.
    """
    key = [page, region]
    areas = _boxed(regions, key).select(*key, F.col("l").alias("l0"), F.col("b").alias("b0"), F.col("r").alias("r0"), F.col("t").alias("t0"), F.coalesce("strict", F.lit(False)).alias("strict"))
    drawn = _boxed(marks, [page]).join(areas, page).where("l >= l0 - 5 AND r <= r0 + 5 AND b >= b0 - 5 AND t <= t0 + 5")
    kind = F.when((F.col("t") - F.col("b") < 3) & (F.col("r") - F.col("l") > 30), "rule").when((F.col("r") - F.col("l") < 3) & (F.col("t") - F.col("b") > 10), "post").when(F.coalesce("filled", F.lit(False)) & (F.col("r") - F.col("l") > 10) & (F.col("t") - F.col("b") > 8), "fill")
    drawn = drawn.withColumn("kind", kind)
    lines = drawn.groupBy(*key).agg(F.count_if(F.col("kind") == "rule").alias("n_rules"), F.count_if(F.col("kind") == "post").alias("n_posts"))
    held = _boxed(blocks, key).join(areas, key)
    sizes = held.groupBy(*key).agg(F.count(F.lit(1)).alias("n_blocks"))
    long = F.lit(0).cast("long")
    known = areas.join(sizes, key, "left").join(lines, key, "left").withColumns({c: F.coalesce(c, long) for c in ("n_blocks", "n_rules", "n_posts")})
    gridded = known.where("n_blocks >= 4 AND n_rules >= 3 AND n_posts >= 2")
    xs = drawn.select(*key, "l0", "r0", F.explode(F.when(F.col("kind") == "post", F.array((F.col("l") + F.col("r")) / 2)).when(F.col("kind") == "fill", F.array("l", "r"))).alias("x")).where("x >= l0 + 8 AND x <= r0 - 8").select(*key, "x")
    inner = _clustered(xs, key, 6.0)
    # where nothing is drawn between them, columns are told by wide steps between the blocks' middles
    middle = held.select(*key, ((F.col("l") + F.col("r")) / 2).alias("x"))
    before = F.lag("x").over(Window.partitionBy(*key).orderBy("x"))
    steps = middle.withColumn("_b", before).where("x - _b > 50").select(*key, ((F.col("x") + F.col("_b")) / 2).alias("x"))
    edges = inner.unionByName(steps.join(inner.select(*key).distinct(), key, "left_anti")).groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias("_x"))
    columns = gridded.join(edges, key, "left").withColumn("_e", F.concat(F.array("l0"), F.coalesce("_x", F.array().cast("array<double>")), F.array("r0")))
    columns = columns.withColumns({"n_cols": (F.size("_e") - 1).cast("long"), "cols": F.transform(F.sequence(F.lit(1), F.size("_e") - 1), lambda k: F.struct((k - 1).alias("c"), F.element_at("_e", k).alias("x0"), F.element_at("_e", k + 1).alias("x1")))})
    usable = columns.where("n_cols >= 2").select(*key, "cols", "n_cols")
    at = _boxed(blocks, key).select(*key, block, *BOX, "text", "parts").join(usable, key)
    mid = (F.col("l") + F.col("r")) / 2
    away = lambda among: F.array_min(F.transform(among, lambda c: F.struct(F.abs((c.x0 + c.x1) / 2 - mid).alias("d"), c.c.alias("c"))))["c"]
    touched = F.filter("cols", lambda c: F.least(F.col("r"), c.x1) - F.greatest(F.col("l"), c.x0) > 4)
    at = at.withColumn("_s", touched)
    narrow = (F.col("r") - F.col("l")) < 0.5 * (F.element_at("_s", -1).x1 - F.element_at("_s", 1).x0)
    one = F.when(F.size("_s") == 0, away(F.col("cols"))).when(F.size("_s") == 1, F.get("_s", F.lit(0)).c).when(narrow, away(F.col("_s")))
    at = at.withColumns({"_one": one, "_n": F.size("_s")})
    whole = F.array(F.struct(F.coalesce("_one", F.get("_s", F.lit(0)).c).alias("col"), F.when(F.col("_one").isNull(), F.col("_n")).otherwise(1).alias("span"), F.coalesce("text", F.lit("")).alias("text")))
    split = F.transform(F.arrays_zip("_s", "parts"), lambda x: F.struct(x["_s"].c.alias("col"), F.lit(1).alias("span"), F.coalesce(x["parts"], F.lit("")).alias("text")))
    cells = at.select(*key, block, "b", "t", F.explode(F.when(F.col("_one").isNull() & (F.size("parts") == F.col("_n")), split).otherwise(whole)).alias("c")).select(*key, block, "b", "t", "c.col", "c.span", "c.text")
    # a cell opens a row where it lies below all that came before: tops go down, so the lowest bottom so far is the open row's
    down = Window.partitionBy(*key).orderBy(F.desc("t"), block, "col").rowsBetween(Window.unboundedPreceding, -1)
    opened = cells.withColumn("_low", F.min("b").over(down)).withColumn("_new", F.when(F.col("t") > F.col("_low"), 0).otherwise(1))
    placed = opened.withColumn("row", F.sum("_new").over(Window.partitionBy(*key).orderBy(F.desc("t"), block, "col").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    texts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("t")).alias("t"), block, "text"))), lambda x: x.text)
    merged = placed.groupBy(*key, "row", "col").agg(F.max("span").alias("span"), F.array_join(F.filter(texts, lambda x: x != ""), " ").alias("text"))
    shape = placed.groupBy(*key).agg((F.max("row") + 1).alias("n_rows")).join(merged.where(F.trim("text") != "").groupBy(*key).agg(F.count(F.lit(1)).alias("_filled")), key, "left")
    told = known.join(columns.select(*key, "n_cols"), key, "left").join(shape, key, "left").withColumns({c: F.coalesce(c, long) for c in ("n_cols", "n_rows", "_filled")})
    outcome = (
        F.when(F.col("n_blocks") < 4, "too-few-blocks")
        .when((F.col("n_rules") < 3) | (F.col("n_posts") < 2), "no-grid")
        .when(F.col("n_cols") < 2, "no-columns")
        .when(F.col("n_rows") < 2, "too-few-rows")
        .when(F.col("strict") & ((F.col("n_rows") < 3) | (F.col("_filled") < 0.6 * F.col("n_rows") * F.col("n_cols"))), "strict-sparse")
        .otherwise("table")
    )
    told = told.select(*key, "n_blocks", "n_rules", "n_posts", "n_cols", "n_rows", outcome.alias("outcome"))
    return merged.join(told.where("outcome = 'table'").select(*key), key).select(*key, "row", "col", "span", "text"), told
