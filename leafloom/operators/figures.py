"""Figures that grow over their labels.

Nulls: blocks and regions without page or box take no part; null text is empty.
Equal rows count as they stand. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grouped import grouped
from . import markers, patterns

#: Labels are within this reach; charts have so many paths at least; growth ends after so many rounds.
REACH, PATHS, ROUNDS = 28.0, 8, 8


def label_shaped(text: Column, lines: Column, size: Column, body: Column, noteish: Column) -> Column:
    """Whether a block reads like a chart's label: no sentence, caption or note, no larger print, and short, in small print, or of short lines."""
    said = F.coalesce(text, F.lit(""))
    sentence = (F.length(said) > 25) & said.rlike("[.!?]")
    short = F.array_max(F.transform(lines, lambda x: markers.letters(F.coalesce(x, F.lit(""))))) <= 20
    small = (F.length(said) <= 40) | (size < 0.9 * body) | F.coalesce(short, F.lit(False))
    return F.coalesce(~sentence & ~said.rlike(patterns.CAPTION_START) & ~F.coalesce(noteish, F.lit(False)) & (size < 1.05 * body) & small, F.lit(False))


def grow(regions: list[list[float]], blocks: list[tuple]) -> tuple[list[list[float]], list[int | None]]:
    """Boxes after growth and the region that took each block. Blocks are taken in order, each by the nearest region in reach (of equals the first), which covers it from then on; rounds go on while any grows."""
    boxes = np.array(regions, np.float64).reshape(len(regions), 4)
    taken: list[int | None] = [None] * len(blocks)
    for _ in range(ROUNDS):
        grew = False
        for k, (l, b, r, t) in enumerate(blocks):
            if taken[k] is not None:
                continue
            apart = np.maximum(np.maximum(boxes[:, 0] - r, l - boxes[:, 2]), np.maximum(boxes[:, 1] - t, b - boxes[:, 3])).clip(0)
            near = int(apart.argmin())
            if apart[near] <= REACH:
                taken[k], grew = near, True
                boxes[near] = (min(boxes[near, 0], l), min(boxes[near, 1], b), max(boxes[near, 2], r), max(boxes[near, 3], t))
        if not grew:
            break
    return boxes.tolist(), taken


def grown(regions: DataFrame, blocks: DataFrame, page: list[str], region: str, block: str, paths: str = "paths", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Regions with their boxes after growth, and the blocks they took (page, region, block).

    Regions with fewer than PATHS paths stay as they are. Only blocks that are
    labels meet the regions of their page, by arrays of all regions at a time, so a
    page of thousands of marks costs a pass over its regions for each.
    """
    whole = F.lit(True)
    for c in (*page, "l", "b", "r", "t"):
        whole &= F.col(c).isNotNull()
    box = [F.col(c).cast("double").alias(c) for c in ("l", "b", "r", "t")]
    charts = regions.where(whole & (F.col(paths) >= PATHS)).select(*page, F.lit(0).alias("_kind"), F.col(region).cast("string").alias("_id"), *box)
    labels = blocks.where(whole & F.coalesce(F.col(label), F.lit(False))).select(*page, F.lit(1).alias("_kind"), F.col(block).cast("long").alias("_nth"), *box)
    rows = charts.withColumn("_nth", F.lit(None).cast("long")).unionByName(labels.withColumn("_id", F.lit(None).cast("string"))).select(*page, "_kind", "_id", "_nth", "l", "b", "r", "t")
    n = len(page)
    schema = T.StructType([*rows.schema.fields])

    def work(group: list[tuple]) -> list[tuple]:
        held = [g for g in group if g[n] == 0]
        asked = [g for g in group if g[n] == 1]
        if not held:
            return []
        boxes, taken = grow([list(g[n + 3 :]) for g in held], [g[n + 3 :] for g in asked])
        return [(*g[: n + 3], *b) for g, b in zip(held, boxes)] + [(*g[: n + 1], held[at][n + 1], *g[n + 2 :]) for g, at in zip(asked, taken) if at is not None]

    done = grouped(rows, page, ["_kind", "_id", "_nth", "l", "b", "r", "t"], work, schema)
    kind = regions.schema[region].dataType
    return done.where("_kind = 0").select(*page, F.col("_id").cast(kind).alias(region), "l", "b", "r", "t"), done.where("_kind = 1").select(*page, F.col("_id").cast(kind).alias(region), F.col("_nth").alias(block))
