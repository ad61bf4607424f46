"""Candidates held against annotated texts, and stages of a conversion against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import collapsed


def _plain(text: Column) -> Column:
    return F.lower(collapsed(F.coalesce(text, F.lit(""))))


def gold_match(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """gold (doc_id, gold_id, kind, page, text, expected) with matched and the first matching candidate's candidate_id, ord.

    A candidate (doc_id, candidate_id, ord, kind, page, text) matches if it is of
    the same kind, of the same page where both have one, and one text holds the
    other (white space and case aside). An empty gold text matches any of the kind.
    """
    a = gold.select("doc_id", "gold_id", "kind", F.col("page").alias("_gp"), _plain(F.col("text")).alias("_need"))
    b = candidates.select("doc_id", "kind", "candidate_id", "ord", F.col("page").alias("_cp"), _plain(F.col("text")).alias("_hay"))
    holds = (F.col("_need") == "") | F.col("_hay").contains(F.col("_need")) | F.col("_need").contains(F.col("_hay"))
    same_page = F.col("_gp").isNull() | F.col("_cp").isNull() | (F.col("_gp") == F.col("_cp"))
    found = a.join(b, ["doc_id", "kind"]).where(same_page & holds).groupBy("doc_id", "gold_id").agg(F.min_by("candidate_id", F.struct("ord", "candidate_id")).alias("candidate_id"))
    return gold.join(found, ["doc_id", "gold_id"], "left").withColumn("matched", F.col("candidate_id").isNotNull())


def gold_rates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per document: type_recall (kinds expected that were found at all), hit_rate (expected texts matched), negative_hits, gold_count; rates are null where nothing was expected."""
    kinds = candidates.select("doc_id", "kind").distinct().withColumn("_found", F.lit(True))
    wanted = matches.where("expected").select("doc_id", "kind").distinct().join(kinds, ["doc_id", "kind"], "left")
    recall = wanted.groupBy("doc_id").agg(F.round(F.count("_found") / F.count(F.lit(1)), 3).alias("type_recall"))
    counted = matches.groupBy("doc_id").agg(
        F.round(F.avg(F.when(F.col("expected"), F.col("matched").cast("int"))), 3).alias("hit_rate"),
        F.count_if(~F.col("expected") & F.col("matched")).alias("negative_hits"),
        F.count_if(F.col("expected")).alias("gold_count"),
    )
    return counted.join(recall, "doc_id", "left")


def overlap_counts(findings: DataFrame, kind: str, other: str) -> DataFrame:
    """One row: findings whose best overlap is of the same kind, of another, or that have none."""
    return findings.agg(F.count_if(F.col(other) == F.col(kind)).alias("same_kind"), F.count_if(F.col(other) != F.col(kind)).alias("other_kind"), F.count_if(F.col(other).isNull()).alias("alone"))


def first_statistics(stats: DataFrame, value: str, quote: str, order: str) -> DataFrame:
    """Statistics once each: of those equal in value and in the first 120 word characters of the quote, the first by order."""
    key = F.substring(F.regexp_replace(F.lower(F.coalesce(quote, F.lit(""))), r"[^\p{L}\p{N}_]+", ""), 1, 120)
    rest = F.struct(*stats.columns)
    return stats.groupBy(F.col(value).alias("_v"), key.alias("_k")).agg(F.min_by(rest, order).alias("_r")).select("_r.*")


def claimed(checks: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """check_id, passed, place: whether texts that an earlier stage had are gone from a later one on purpose.

    checks: check_id, doc_id, args. before, after: doc_id, text. A text that was
    not there before is lost upstream, one that is still there is kept; the check
    passes if every text was there and none is. place: claimed, lost or kept (of
    the first text that fails).
    """
    asked = checks.select("check_id", "doc_id", F.posexplode("args").alias("_i", "_a"))

    def seen(stage: DataFrame, name: str) -> DataFrame:
        hit = asked.join(stage.select("doc_id", "text"), "doc_id").where(collapsed(F.col("text")).contains(collapsed(F.col("_a"))))
        return hit.select("check_id", "_i").distinct().withColumn(name, F.lit(True))

    state = asked.join(seen(before, "_was"), ["check_id", "_i"], "left").join(seen(after, "_is"), ["check_id", "_i"], "left")
    place = F.when(F.col("_was").isNull(), "lost").when(F.col("_is"), "kept").otherwise("claimed")
    out = state.groupBy("check_id").agg(F.bool_and(place == "claimed").alias("passed"), F.min_by(place, F.when(place == "claimed", F.lit(2**30)).otherwise(F.col("_i"))).alias("place"))
    return checks.select("check_id").join(out, "check_id", "left").select("check_id", F.coalesce("passed", F.lit(True)).alias("passed"), F.coalesce("place", F.lit("claimed")).alias("place"))
