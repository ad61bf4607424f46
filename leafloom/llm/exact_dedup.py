"""Exact dedup (9): group by a 128-bit content hash, keep one row by a stable rule, compare bytes inside groups.

Texts are equal when they are the same after white space is deleted. Of equal
texts the row with the most code points in its original text stays, then the
smallest id; a null id loses to any other. Null text counts as empty. Rows that
repeat an id are rows of their own; rows equal in id and text can't be told
apart and are kept or dropped together. Rows without an id are compared by bytes
like any other. An empty table gives an empty result.

Only 16-byte hashes are shuffled for all rows. Text moves only for rows whose
hash occurs twice or more, and each of them is compared with its group's first
row. A group's size and best row are partial aggregates. Where a group's rows
are joined with what holds for the group, both sides are plain tables, so that
Spark can split a hash that many rows have; a row whose hash is its own joins
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, wide_shuffle, written

#: What is deleted before texts are compared.
SPACE = " \t\n\x0b\x0c\r"


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def content_hash(norm):
    return F.unhex(F.md5(norm))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_of=content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    hash_of: the 128-bit hash, as a function of the normalised text column.
    Where it collides, the texts' bytes decide.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("norm", normalised(F.col("text")))
    hashed = written(
        rows.select("doc_id", hash_of(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")),
        "exact-hashed",
    )
    several = written(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep")).where("copies > 1").select("h", "rep"), "exact-several")
    n = wide_shuffle(docs.sparkSession)  # rows are told apart where they lie by id, not by hash
    members = hashed.where("doc_id IS NOT NULL").join(several, "h").select("doc_id", "h", "rep").repartition(n, "doc_id").distinct()
    # text is fetched once, for these rows alone
    named = rows.join(members, "doc_id").where(hash_of(F.col("norm")) == F.col("h")).select("doc_id", "h", "rep", "norm")
    nameless = rows.where("doc_id IS NULL").withColumn("h", hash_of(F.col("norm"))).join(several, "h").select("doc_id", "h", "rep", "norm")
    fetched = written(named.unionByName(nameless), "exact-fetched")
    # a repeated id may have several texts of one hash: then the least of them stands for the group
    first = written(fetched.where("doc_id <=> rep").groupBy("h").agg(F.min("norm").alias("first")), "exact-first")
    unlike = written(
        fetched.join(first, "h").where(F.col("norm") != F.col("first")).select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"), F.col("norm").alias("bytes")).repartition(n, "doc_id", "text_sha256").distinct(), "exact-unlike"
    )
    # rows of hashes that occur twice, each with the bytes that tell it from others of its hash
    shared = hashed.join(several.select("h"), "h")
    other = unlike.toDF("_id", "_h", "_sha", "bytes")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("text_sha256") == F.col("_sha"))
    own = written(shared.join(other, same, "left").drop("_id", "_h", "_sha").withColumns({"other": F.col("bytes").isNotNull(), "bytes": F.coalesce("bytes", F.lit(""))}), "exact-own")
    best = written(own.groupBy("h", "other", "bytes").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("n", (-F.col("doc_id")).alias("back"))).alias("top")), "exact-best")
    kept = (F.col("n") == F.col("top.n")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    copies = own.join(best, ["h", "other", "bytes"]).withColumn("keep_id", -F.col("top.back")).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    alone = hashed.join(several.select("h"), "h", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(copies)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, first_value(doc_id) OVER w AS keep_id, norm, count(*) OVER (PARTITION BY norm) AS group_size
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id ASC)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
