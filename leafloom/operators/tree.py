"""Trees as flat tables: a node has its parent and the path of its ancestors' places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import new_folder


def with_paths(nodes: DataFrame, nid: str = "nid", parent: str = "parent") -> DataFrame:
    """nodes with path (ids from the root down) and depth, whatever their depth.

    Each round puts a node's path behind that of the node it has come up to, so
    that paths double and a depth of d takes log2(d) rounds, each a table of its
    own. Nodes that no root is above (a missing parent, a cycle) are left out;
    `unreached` tells them.
    """
    state = _round(nodes.withColumns({"path": F.array(nid), "_up": F.col(parent)}))
    while not state.where("_up IS NOT NULL").isEmpty():
        above = state.select(F.col(nid).alias("_n"), F.col("_up").alias("_next"), F.col("path").alias("_above"))
        open_ = state.where(F.col("_up").isNotNull() & ~F.array_contains("path", F.col("_up")))
        moved = open_.join(above, F.col("_up") == F.col("_n")).withColumns({"path": F.concat("_above", "path"), "_up": F.col("_next")}).drop("_n", "_next", "_above")
        state = _round(state.where("_up IS NULL").unionByName(moved))
    return state.drop("_up").withColumn("depth", F.size("path") - 1)


def _round(state: DataFrame) -> DataFrame:
    path = new_folder(state.sparkSession, "tree-paths")
    state.write.parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path)


def unreached(nodes: DataFrame, paths: DataFrame, nid: str = "nid") -> DataFrame:
    """Nodes that with_paths left out: their parent is missing, or they are below themselves."""
    return nodes.join(paths.select(nid), nid, "left_anti")


def subtree(paths: DataFrame, value: str, nid: str = "nid") -> DataFrame:
    """For each node, the values of all nodes below and itself, joined in order: nid, n, text."""
    up = paths.select(F.explode("path").alias("_a"), "path", value).where(F.col(value).isNotNull())
    return up.groupBy(F.col("_a").alias(nid)).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.col("path"), F.col(value)))).alias("_v")).select(nid, "n", F.concat_ws(" ", F.transform("_v", lambda x: x[value])).alias("text"))


def walked(paths: DataFrame, kind: str, skip: tuple[str, ...] = (), prune: tuple[str, ...] = (), nid: str = "nid") -> DataFrame:
    """Nodes without the subtrees of `skip` kinds and without what is inside `prune` kinds (those nodes themselves stay)."""
    out = paths
    if skip:
        gone = paths.where(F.col(kind).isin(*skip)).select(F.col(nid).alias("_x"))
        out = _outside(out, gone, F.col("path"), nid)
    if prune:
        gone = paths.where(F.col(kind).isin(*prune)).select(F.col(nid).alias("_x"))
        out = _outside(out, gone, F.slice("path", 1, F.greatest(F.lit(0), F.size("path") - 1)), nid)
    return out


def _outside(nodes: DataFrame, gone: DataFrame, ancestors, nid: str) -> DataFrame:
    hit = nodes.select(F.col(nid).alias("_n"), F.explode(ancestors).alias("_x")).join(gone, "_x", "left_semi").select("_n").distinct()
    return nodes.join(hit, nodes[nid] == hit["_n"], "left_anti")


def first_text(paths: DataFrame, value: str, nid: str = "nid") -> DataFrame:
    """For each node the first text of its subtree, in document order."""
    up = paths.select(F.explode("path").alias("_a"), "path", value).where(F.col(value).isNotNull())
    return up.groupBy(F.col("_a").alias(nid)).agg(F.min_by(value, "path").alias("text"))
