"""Line dedup (2): lines that many sites share go.

A line is what stands between two line feeds, trimmed of white space; blank
lines are never counted or removed. A line's spread is the number of distinct
sites that have it. Each line hash gets a HyperLogLog sketch of its sites, made
before the shuffle and merged after it. Where the estimate is within the
sketch's error of the threshold, the sites are counted exactly. Every line with
a spread of at least `min_sites` is removed wherever it stands.

Null text has no lines and stays null. A null site is a site of its own. Rows
that repeat an id are treated each by its own text. All columns of the input
are kept, but for n_lines and n_removed in any case, which the operator's own
replace. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Sites that make a line boilerplate.
MIN_SITES = 10
#: Sketches of 2^12 registers; their relative standard error is about 1.04 / sqrt(2^12).
LG_K = 12
#: Standard errors to each side of the threshold within which sites are counted exactly.
BAND = 6


#: White space other than the line feed.
BLANK = " \t\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hash(line: Column) -> Column:
    """128 bits, so that different lines do not meet at any corpus size."""
    return F.unhex(F.md5(F.trim(line, F.lit(BLANK))))


def _each_line(docs: DataFrame, text: str, *beside: str) -> DataFrame:
    """A row h for each distinct line of each row."""
    hashes = F.transform(F.filter(lines_of(F.col(text)), lambda x: F.trim(x, F.lit(BLANK)) != ""), line_hash)
    return docs.select(*beside, F.explode(F.array_distinct(hashes)).alias("h"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source") -> DataFrame:
    """The line hashes with at least min_sites distinct sites: h."""
    sites = docs.select(F.col(text).alias("text"), F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("")).alias("site"))
    each = _each_line(sites, "text", "site")
    width = max(1.0, BAND * 1.04 / 2 ** (LG_K / 2) * min_sites)
    sketched = each.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    spread = written(sketched.where(F.col("sites") >= min_sites - width), "line-spread")
    near = spread.where(F.col("sites") <= min_sites + width).select("h")
    exact = each.join(near, "h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where(F.col("sites") > min_sites + width).select("h").unionByName(exact.select("h"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source") -> DataFrame:
    """docs with the boilerplate lines taken out of its text, and n_lines, n_removed beside.

    What to take out is looked up by the hash of the whole text, so equal texts
    share one entry and a repeated or null id does no harm.
    """
    common = written(boilerplate(docs, min_sites, text, site), "line-common")
    # the input's columns travel in a struct, whatever their names
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"), F.unhex(F.md5(F.col(text))).alias("_key"))
    gone = written(_each_line(keyed, "_text", "_key").join(common, "h").groupBy("_key").agg(F.collect_set("h").alias("_gone")), "line-gone")
    all_lines = lines_of(F.col("_row")[text])
    kept = F.filter(all_lines, lambda x: ~F.array_contains(F.col("_gone"), line_hash(x)))
    n_lines = F.when(F.col("_row")[text].isNull(), 0).otherwise(F.size(all_lines)).cast("long")
    joined = keyed.drop("_text").join(gone, "_key", "left").select("_row", "_gone", n_lines.alias("_n"), F.when(F.col("_gone").isNotNull(), kept).alias("_kept"))
    own = [F.col("_row")[c].alias(c) if c.lower() != text.lower() else F.coalesce(F.array_join("_kept", "\n"), F.col("_row")[text]).alias(text) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    n_removed = F.when(F.col("_gone").isNull(), F.lit(0).cast("long")).otherwise(F.col("_n") - F.size("_kept"))
    return joined.select(*own, F.col("_n").alias("n_lines"), n_removed.alias("n_removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return without_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH l AS (
  SELECT DISTINCT trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line, coalesce('s' || source, '') AS site FROM documents
), b AS (
  SELECT list(line) AS lines FROM (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES})
), d AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines,
         list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS kept
  FROM documents, (SELECT coalesce((SELECT lines FROM b), []) AS gone)
)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_removed, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM d
"""
