"""Pages of documents: how hard they are, which to look at first, how far a review has come, captions, lists over page breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grouped import grouped

#: What a page may show, and the signal that counts it; several columns are two or more.
FEATURES = (("table", "n_tables", 1), ("figure", "n_figures", 1), ("callout", "n_callouts", 1), ("multicol", "ncols", 2), ("hero", "hero", 1), ("list", "n_lists", 1))
_TROUBLE = ("label_soup", "assembled", "grown", "hero", "dissolve", "questions", "uncertain")
SIGNALS = (*_TROUBLE, "n_tables", "n_callouts", "n_figures", "n_asides", "n_lists", "ncols", "fig_anatomy")


def page_class() -> Column:
    """hard, moderate or easy, from a page's signals (SIGNALS and colconf; null counts as none, an unknown colconf as sure)."""
    v = {c: F.coalesce(F.col(c), F.lit(0)) for c in SIGNALS}
    hard = (v["n_tables"] >= 1) | (v["n_callouts"] >= 2) | (v["n_figures"] > 4) | ((v["ncols"] >= 2) & (F.coalesce("colconf", F.lit(1.0)) < 0.55))
    for c in _TROUBLE:
        hard = hard | (v[c] > 0)
    moderate = (v["n_figures"] >= 2) | (v["n_callouts"] >= 1) | (v["n_asides"] >= 1) | ((v["n_figures"] == 1) & (v["fig_anatomy"] > 0))
    return F.when(hard, "hard").when(moderate, "moderate").otherwise("easy")


def signature() -> Column:
    """What hard pages of one kind have in common."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return F.concat_ws("/", *[n(c).cast("string") for c in ("n_figures", "n_tables", "n_callouts", "ncols")], ((n("assembled") > 0) | (n("fig_anatomy") > 0)).cast("string"), (n("hero") > 0).cast("string"))


def pages_to_scan(signals: DataFrame, cap: int = 10) -> DataFrame:
    """doc_id, page, reason: at most `cap` pages of each document that show what it has.

    One page for each kind of hard page, the most frequent kinds first (ties: the
    smallest page); then, for a feature no chosen page shows, the page with most of
    it; then an easy page, for which a place is kept. Pages scanned before (column
    scanned) come behind others. Everything is counted before it meets: a document
    is one row of at most cap kinds, one page a feature and one easy page.
    """
    seen = F.coalesce(F.col("scanned"), F.lit(False))
    shows = F.array(*[F.coalesce(F.col(c), F.lit(0)) >= least for _, c, least in FEATURES])
    rows = signals.where("doc_id IS NOT NULL AND page IS NOT NULL").select("doc_id", "page", seen.alias("_seen"), page_class().alias("_class"), signature().alias("_kind"), shows.alias("_shows"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(f"_v{k}") for k, (_, c, _) in enumerate(FEATURES)])
    row = lambda why: F.struct(F.col("page"), F.col("_shows").alias("shows"), (F.col("_class") == "easy").alias("easy"), why.alias("reason"))
    kinds = rows.where("_class = 'hard'").groupBy("doc_id", "_kind").agg(F.min_by(F.struct("page", "_shows"), F.struct("_seen", "page")).alias("_p"), F.min("page").alias("_first"), F.count(F.lit(1)).alias("_n"))
    top = kinds.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("_n"), "_first"))).where(F.col("_r") <= cap)
    reps = top.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_r", F.struct(F.col("_p.page"), F.col("_p._shows").alias("shows"), F.lit(False).alias("easy"), F.lit("kind").alias("reason")).alias("x")))).alias("_reps"))
    best = [F.max_by(F.when(F.col("_shows")[k], row(F.lit(name))), F.when(F.col("_shows")[k], F.struct(F.col(f"_v{k}"), ~F.col("_seen"), -F.col("page")))).alias(f"_f{k}") for k, (name, _, _) in enumerate(FEATURES)]
    rest = rows.groupBy("doc_id").agg(*best, F.min_by(F.when(F.col("_class") == "easy", row(F.lit("easy"))), F.when(F.col("_class") == "easy", F.struct("_seen", "page"))).alias("_easy"))
    whole = rest.join(reps, "doc_id", "left")
    room = F.lit(cap) - F.when(F.col("_easy").isNull(), 0).otherwise(1)
    # one fold, so that no plan has each step's whole expression in the next
    reps_first = F.when(F.col("_reps").isNull(), F.slice(F.array("_easy"), 1, 0)).otherwise(F.slice(F.transform("_reps", lambda x: x["x"]), F.lit(1), room))
    offers = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_f{k}").alias("x"), room.alias("room")) for k in range(len(FEATURES))])
    new = lambda held, f: f["x"].isNotNull() & ~F.exists(held, lambda h: h["shows"][f["k"]]) & (F.size(held) < f["room"]) & ~F.exists(held, lambda h: h["page"] == f["x"]["page"])
    chosen = F.aggregate(offers, reps_first, lambda held, f: F.when(new(held, f), F.concat(held, F.array(f["x"]))).otherwise(held))
    whole = whole.select("doc_id", "_easy", chosen.alias("_chosen"))
    enough = F.col("_easy").isNull() | F.exists("_chosen", lambda h: h["easy"])
    whole = whole.select("doc_id", F.when(enough, F.col("_chosen")).otherwise(F.concat("_chosen", F.array("_easy"))).alias("_chosen"))
    return whole.select("doc_id", F.explode("_chosen").alias("x")).select("doc_id", "x.page", "x.reason")


def scoreboard(pages: DataFrame, reviews: DataFrame, group: str, page: str, good: Column, bad: Column, flagged: Column) -> DataFrame:
    """Per group: pages, those reviewed, good, bad and flagged ones, and ring: open (none reviewed), failing (one is bad) or passing."""
    board = pages.join(reviews.withColumn("_seen", F.lit(1)), page, "left")
    seen, red = F.count("_seen"), F.count_if(bad)
    return board.groupBy(group).agg(F.count(F.lit(1)).alias("n_pages"), seen.alias("n_reviewed"), F.count_if(good).alias("green"), red.alias("red"), F.count_if(flagged).alias("flagged"), F.when(seen == 0, "open").when(red > 0, "failing").otherwise("passing").alias("ring"))


def ledger(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, n_in, n_out, lost: what came in and what is left, each side counted already (key, n)."""
    both = before.select(key, F.col("n").alias("n_in")).join(after.select(key, F.col("n").alias("n_out")), key, "full").na.fill(0, ["n_in", "n_out"])
    return both.withColumn("lost", F.greatest(F.lit(0), F.col("n_in") - F.col("n_out")))


def without_repeated_lines(lines: DataFrame, group: str, line: str, doc: str, least: int = 3) -> DataFrame:
    """Lines but those that `least` documents of the group have."""
    repeated = lines.groupBy(group, line).agg(F.count_distinct(doc).alias("_n")).where(F.col("_n") >= least)
    return lines.join(repeated, [group, line], "left_anti")


def _captioned(pairs: list[tuple]) -> list[tuple]:
    taken: set = set()
    out, done = [], set()
    for page, figure, _, block, _, weak in pairs:
        if figure not in done and block not in taken:
            done.add(figure)
            taken.add(block)
            out.append((page, figure, block, weak))
    return out


def captions(figures: DataFrame, blocks: DataFrame, body_size: float, nearest: float = -2.0, farthest: float = 25.0) -> DataFrame:
    """page, figure, block, weak: the block below each figure that is its caption.

    figures: page, figure, l, b, r, t. blocks: page, block, l, b, r, t, text, size.
    A caption's top is at most `farthest` below the figure, shares some of its
    width, is under 500 characters, and says what it is (Figure, Table, Source ...)
    or is set smaller than the body (weak). A figure takes the first such block
    that no figure before it has taken; figures and blocks go by their ids.
    """
    f = figures.select("page", "figure", F.col("l").alias("_l"), F.col("b").alias("_b"), F.col("r").alias("_r"))
    gap = F.col("_b") - F.col("t")
    named = F.col("text").rlike(r"(?i)^(figure|fig\.|table|chart|exhibit|source[:.])")
    pairs = f.join(blocks, "page").where(gap.between(nearest, farthest) & (F.least("r", "_r") > F.greatest("l", "_l")) & (F.length("text") < 500) & (named | (F.col("size") < 0.95 * body_size)))
    rows = pairs.select("page", "figure", F.lit(0).alias("_x"), "block", F.lit(0).alias("_y"), (~named).alias("weak"))
    kept = [rows.schema[c] for c in ("page", "figure", "block", "weak")]
    return grouped(rows, ["page"], ["figure", "block"], _captioned, T.StructType(kept))


def lists_over_breaks(nodes: DataFrame, foot: float = 0.22, head: float = 0.78) -> DataFrame:
    """nodes (doc_id, ord, page, kind, ordered, b, t, height) with into: the ord of the list that a bulleted list carries on, else null.

    It does if the node before it is a bulleted list at the foot of the page
    before and it stands at the head of its own. A list that carries one on is not
    carried on itself, as the joined list lies on the first one's page.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = lambda c: F.lag(c).over(w)
    bullets = (F.col("kind") == "list") & ~F.coalesce("ordered", F.lit(False))
    placed = nodes.withColumns({"_is": F.coalesce(bullets, F.lit(False)), "_n": F.row_number().over(w)})
    meets = F.col("_is") & before("_is") & (F.col("page") == before("page") + 1) & (before("b") < foot * before("height")) & (F.col("t") > head * F.col("height"))
    marked = placed.withColumn("_m", F.coalesce(meets, F.lit(False))).withColumn("_up", before("ord"))
    run = F.col("_n") - F.max(F.when(~F.col("_m"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.select(*nodes.columns, F.when(F.col("_m") & (run % 2 == 1), F.col("_up")).alias("into"))
