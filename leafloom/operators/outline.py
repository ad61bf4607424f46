"""What a document is made of: outline, summary, page signals, running heads, styles.

Nodes come as rows of doc_id, ord (reading order), page, kind, level, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import markers
from .text import collapsed

# What begins like a caption or back matter; what a summary stands under; what an introduction is called.
_BACK_MATTER = r"(?i)^\s*(figure|table|appendix|references|bibliography|acknowledg|notes?\b|endnotes|index)"
_SUMMARY = r"(?i)\b(abstract|executive\s+summary|summary|overview|introduction)\b"
_INTRODUCTION = "(?i)executive summary|abstract|overview|introduction"


def highlights(nodes: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, highlights: the first distinct texts of headings of level 2 and 3, in order (a top-k report)."""
    heads = nodes.where("kind = 'heading' AND level IN (2, 3)").select("doc_id", F.trim("text").alias("_t"), "ord").where("_t <> ''")
    first = heads.groupBy("doc_id", "_t").agg(F.min("ord").alias("_o"))
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("_o"))).where(F.col("_r") <= most)
    return ranked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_r", "_t"))).alias("_l")).select("doc_id", F.transform("_l", lambda x: x["_t"]).alias("highlights"))


def contents(nodes: DataFrame, titles: DataFrame | None = None, most: int = 8, least: int = 3) -> DataFrame:
    """doc_id, level, n, entries: the headings of one level, the first `most` in order.

    The level is the shallowest with `least` headings, else the one with most
    (ties: the one met first). Back matter is left out, and so is a heading that is
    the document's title or its beginning. titles: doc_id, title.
    """
    heads = nodes.where("kind = 'heading'").where(F.trim("text") != "").where(~F.col("text").rlike(_BACK_MATTER)).select("doc_id", "ord", F.coalesce("level", F.lit(99)).alias("level"), F.trim("text").alias("text"))
    if titles is not None:
        key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
        named = heads.join(titles.select("doc_id", key(F.col("title")).alias("_title")), "doc_id", "left").withColumn("_h", key(F.col("text")))
        is_title = (F.col("_title") != "") & ((F.col("_h") == F.col("_title")) | ((F.length("_h") >= 8) & F.startswith(F.col("_title"), F.col("_h"))))
        heads = named.where(~F.coalesce(is_title, F.lit(False))).drop("_title", "_h")
    levels = heads.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("_first"))
    enough = F.col("n") >= least
    rank = F.struct(F.when(enough, 0).otherwise(1).alias("a"), F.when(enough, F.col("level")).otherwise(-F.col("n")).alias("b"), F.col("_first"))
    chosen = levels.groupBy("doc_id").agg(F.min_by(F.struct("level", "n"), rank).alias("_c")).select("doc_id", "_c.level", "_c.n")
    listed = heads.join(chosen, ["doc_id", "level"]).withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("_r") <= most)
    out = listed.groupBy("doc_id", "level", "n").agg(F.array_sort(F.collect_list(F.struct("_r", "text"))).alias("_l"))
    return out.select("doc_id", "level", "n", F.transform("_l", lambda x: x["text"]).alias("entries"))


def trimmed(text: Column, most: int = 400) -> Column:
    """Text with single spaces, cut behind the last end of a sentence within `most` characters; where there is none, behind the last whole word, with a mark of the cut."""
    one = collapsed(text)
    cut = F.substring(one, 1, most)
    whole = F.regexp_extract(cut, r"(?s)^(.*[.!?])\s", 1)
    return F.when(F.length(one) <= most, one).when(whole != "", whole).otherwise(F.concat(F.rtrim(F.regexp_replace(cut, " [^ ]*$", "")), F.lit("…")))


def summary(nodes: DataFrame, near: int = 80, far: int = 120, most: int = 400) -> DataFrame:
    """doc_id, summary: the first paragraph over `near` characters behind a summary-like heading and before the next heading; else the first of `far`; else the first; trimmed to `most`."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    under = nodes.select("doc_id", "ord", "kind", "text", F.last(F.when(F.col("kind") == "heading", F.coalesce(F.col("text").rlike(_SUMMARY), F.lit(False))), ignorenulls=True).over(w).alias("_under"))
    paras = under.where("kind = 'paragraph' AND text <> ''")
    rank = F.when(F.coalesce("_under", F.lit(False)) & (F.length("text") > near), 0).when(F.length("text") >= far, 1).otherwise(2)
    return paras.groupBy("doc_id").agg(F.min_by("text", F.struct(rank.alias("r"), F.col("ord"))).alias("_t")).select("doc_id", trimmed(F.col("_t"), most).alias("summary"))


def profile(nodes: DataFrame) -> DataFrame:
    """doc_id, words (between white space), headings (with text), pages (the last page's number, else words / 450), intro_words, kinds (map of counts).

    intro_words: of what stands behind the first heading of an introduction, up to the next heading as high; null where there is none.
    """
    said = F.trim(collapsed(F.coalesce("text", F.lit(""))))
    sized = nodes.select("doc_id", "ord", "page", "kind", "level", F.col("text").rlike(_INTRODUCTION).alias("_i"), F.when(said == "", 0).otherwise(F.size(F.split(said, " "))).alias("_w"))
    head = F.col("kind") == "heading"
    by_kind = sized.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_w"), F.count_if(head & (F.col("_w") > 0)).alias("_h"), F.max("page").alias("_p"))
    whole = by_kind.groupBy("doc_id").agg(F.sum("_w").alias("words"), F.sum("_h").alias("headings"), F.max("_p").alias("_p"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "_n")))).alias("kinds"))
    intro = sized.where(head & F.col("_i") & (F.col("_w") > 0)).groupBy("doc_id").agg(F.min(F.struct("ord", F.coalesce("level", F.lit(1)).alias("level"))).alias("_f"))
    behind = sized.join(intro, "doc_id").where(F.col("ord") > F.col("_f.ord"))
    stop = behind.where(head & (F.coalesce("level", F.lit(9)) <= F.col("_f.level"))).groupBy("doc_id").agg(F.min("ord").alias("_stop"))
    counted = behind.join(stop, "doc_id", "left").where(F.col("_stop").isNull() | (F.col("ord") < F.col("_stop"))).groupBy("doc_id").agg(F.sum("_w").alias("_iw"))
    found = intro.join(counted, "doc_id", "left").select("doc_id", F.coalesce("_iw", F.lit(0).cast("long")).alias("intro_words"))
    pages = F.coalesce(F.nullif(F.col("_p"), F.lit(0)).cast("long"), F.greatest(F.lit(1).cast("long"), F.rint(F.col("words") / 450).cast("long")))
    return whole.join(found, "doc_id", "left").select("doc_id", "words", "headings", pages.alias("pages"), "intro_words", "kinds")


def page_signals(nodes: DataFrame, events: DataFrame, kinds: tuple[str, ...], reasons: tuple[str, ...]) -> DataFrame:
    """doc_id, page, n_<kind> for nodes, r_<reason> for events whose reason speaks of it, ncols (most), confidence (least). Rows without a page are left out; both sides are counted before they meet."""
    counted = nodes.groupBy("doc_id", "page").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    heard = events.groupBy("doc_id", "page").agg(*[F.count_if(F.lower("reason").contains(r)).alias(f"r_{r}") for r in reasons], F.max("ncols").alias("ncols"), F.min("confidence").alias("confidence"))
    both = counted.unionByName(heard, allowMissingColumns=True).where("page IS NOT NULL")
    sums = [c for c in both.columns if c[:2] in ("n_", "r_")]
    return both.groupBy("doc_id", "page").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.max("ncols").alias("ncols"), F.min("confidence").alias("confidence"))


def without_running_heads(blocks: DataFrame, least: int = 3) -> DataFrame:
    """Blocks (doc_id, ord, text) without headings that stand on `least` of the document's blocks.

    A block that is such a heading goes; one that begins with it (the longest
    counts) loses it, and the page number behind it. Headings have at most twelve
    words, so a block has at most that many beginnings to look up: an equality
    join on what a block's first words are, no comparison of all with all.
    """
    heads = blocks.where(markers.may_repeat(F.col("text"))).groupBy("doc_id", markers.heading_key(F.col("text")).alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    rest = [c for c in blocks.columns if c not in ("doc_id", "text")]
    longest = heads.groupBy("doc_id").agg(F.max(F.length("_h")).alias("_most"))
    asked = blocks.join(longest, "doc_id", "left").withColumns({"_id": F.struct("doc_id", *rest), "_room": F.least(F.length("text"), F.coalesce("_most", F.lit(0)))})
    # a beginning ends before a space or at the end of the text, and is no longer than the longest heading
    ends = F.filter(F.sequence(F.lit(1), "_room"), lambda k: (F.substring(F.col("text"), k + 1, F.lit(1)) == " ") | (k == F.length("text")))
    starts = asked.where("_room > 0").select("doc_id", "_id", F.explode(F.transform(ends, lambda k: F.substring(F.col("text"), F.lit(1), k))).alias("_h"))
    hit = starts.join(heads, ["doc_id", "_h"]).groupBy("_id").agg(F.max(F.length("_h")).alias("_cut"))
    cut = asked.join(hit, "_id", "left")
    tail = F.regexp_replace(F.trim(F.substring(F.col("text"), F.col("_cut") + 1, F.length("text"))), r"^[0-9]{1,4}\b\s*", "")
    return cut.select("doc_id", *rest, F.when(F.col("_cut").isNull(), F.col("text")).otherwise(tail).alias("text")).where("text <> ''")


def repeated_images(images: DataFrame, pages: DataFrame, share: float = 0.4, least: int = 3) -> DataFrame:
    """doc_id, l, b, r, t (whole points), n: boxes that occur at least max(least, share of the document's pages) times, as logos do. pages: doc_id, n_pages."""
    snapped = images.select("doc_id", *[F.rint(c).alias(c) for c in "lbrt"])
    seen = snapped.groupBy("doc_id", "l", "b", "r", "t").agg(F.count(F.lit(1)).alias("n"))
    return seen.join(pages.select("doc_id", F.col("n_pages").alias("_all")), "doc_id").where(F.col("n") >= F.greatest(F.lit(least), F.rint(F.col("_all") * share))).drop("_all")


def main_styles(spans: DataFrame, keys: list[str], style: str, weight: str) -> DataFrame:
    """keys, style, share: the style with most weight of each key (ties: the smallest), and its part of all."""
    sums = spans.where(F.col(style).isNotNull()).groupBy(*keys, style).agg(F.sum(weight).alias("_w"))
    best = sums.groupBy(*keys).agg(F.min_by(style, F.struct((-F.col("_w")).alias("w"), F.col(style))).alias(style), F.max("_w").alias("_m"), F.sum("_w").alias("_s"))
    return best.select(*keys, style, F.round(F.col("_m") / F.col("_s"), 4).alias("share"))


def line_pitch(lines: DataFrame, keys: list[str], top: str, least: int = 8, share: float = 0.35) -> DataFrame:
    """keys, pitch: the most frequent whole gap between lines that follow each other, where there are `least` gaps and it is `share` of them (ties: the smallest)."""
    gap = F.round(F.col(top) - F.lead(top).over(Window.partitionBy(*keys).orderBy(F.desc(top)))).cast("int")
    counted = lines.select(*keys, gap.alias("_g")).where("_g > 0").groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_n"))
    best = counted.groupBy(*keys).agg(F.min_by("_g", F.struct((-F.col("_n")).alias("n"), F.col("_g"))).alias("pitch"), F.max("_n").alias("_m"), F.sum("_n").alias("_s"))
    return best.where((F.col("_s") >= least) & (F.col("_m") >= share * F.col("_s"))).select(*keys, "pitch")


def text_of(nodes: DataFrame, most: int) -> DataFrame:
    """doc_id, text, whole: texts in order with a mark where the page changes, for as long as they fit in `most` characters (marks not counted).

    Lengths are summed before texts are gathered, so that no row grows beyond `most`.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    held = nodes.where("text <> ''").withColumns({"_used": F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_before": F.lag("page").over(w)})
    line = F.when(F.col("_before").eqNullSafe(F.col("page")), F.col("text")).otherwise(F.concat(F.lit("[page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("]\n"), F.col("text")))
    fits = F.col("_used") <= most
    out = held.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(fits, F.struct("ord", line.alias("s"))))).alias("_l"), F.bool_and(fits).alias("whole"))
    return out.select("doc_id", F.array_join(F.transform("_l", lambda x: x["s"]), "\n").alias("text"), "whole")


def severities(flags: DataFrame, keys: list[str], severity: str, names: tuple[str, ...] = ("low", "medium", "high", "critical")) -> DataFrame:
    return flags.groupBy(*keys).agg(*[F.count_if(F.col(severity) == s).alias(s) for s in names])


def with_ids(nodes: DataFrame, base: Column, order: list[str], within: list[str], into: str = "node_id") -> DataFrame:
    """nodes with ids made of their content: base, and -2, -3 ... behind it where others of the same base come first."""
    k = F.row_number().over(Window.partitionBy(*within, base).orderBy(*order))
    return nodes.withColumn(into, F.when(k == 1, base).otherwise(F.concat_ws("-", base, k.cast("string"))))


def content_id(kind: Column, page: Column, text: Column) -> Column:
    """n and ten hex digits of kind, page and the first 60 letters and digits of the text."""
    key = F.substring(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", ""), 1, 60)
    return F.concat(F.lit("n"), F.substring(F.sha1(F.concat_ws("|", kind, page.cast("string"), key)), 1, 10))


def heading_slug(text: Column) -> Column:
    """At most 60 characters of lower-case words with hyphens; section where nothing is left."""
    made = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 60), "-$", "")
    return F.when(made == "", "section").otherwise(made)
