"""Checks of registries, reports and node tables that return error rows; none means valid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registry_errors(registry: DataFrame, key: str, required: list[str]) -> DataFrame:
    """subject, error: missing ids, repeated ids, missing fields."""
    subject = F.coalesce(F.col(key).cast("string"), F.lit("?")).alias("subject")
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    missing = F.filter(F.array(F.when(blank(key), "no id"), *[F.when(blank(c), F.lit(f"no {c}")) for c in required]), lambda x: x.isNotNull())
    one = registry.select(subject, F.explode(missing).alias("error"))
    twice = registry.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(subject, F.lit("repeated id").alias("error"))
    return one.unionByName(twice)


def report_errors(candidates: DataFrame, registry: DataFrame, key: str, kind: str, confidence: str) -> DataFrame:
    """subject, error: kinds the registry doesn't have, confidences outside 0 to 1."""
    subject = F.col(key).cast("string").alias("subject")
    unknown = candidates.join(registry.select(F.col("id").alias(kind)).distinct(), kind, "left_anti").select(subject, F.lit("unknown kind").alias("error"))
    outside = candidates.where(~F.coalesce(F.col(confidence).between(0, 1), F.lit(False))).select(subject, F.lit("confidence outside 0 to 1").alias("error"))
    return unknown.unionByName(outside)


def tree_errors(nodes: DataFrame, nid: str = "nid", parent: str = "parent") -> DataFrame:
    """subject, error: nodes without an id, with a repeated id, or below one that isn't there."""
    ids = nodes.select(F.col(nid).alias("_p")).distinct()
    orphans = nodes.where(F.col(parent).isNotNull()).join(ids, nodes[parent] == ids["_p"], "left_anti").select(F.col(nid).cast("string").alias("subject"), F.lit("parent not there").alias("error"))
    return registry_errors(nodes, nid, []).unionByName(orphans)
