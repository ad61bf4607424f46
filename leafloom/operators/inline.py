"""Inline markup and flowing text, as Column expressions over arrays of runs (see runs.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runs

#: White space, in any script.
SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
RUNS = "array<struct<s:int,e:int,v:string>>"
WRAP = "array<struct<rank:int,s:int,back:int,i:int,e:int,open:string,close:string>>"


def plain(text: Column) -> Column:
    """Text with its white space runs as one space each and none at its ends; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "), "^ | $", "")


def _usable(held: Column) -> Column:
    return F.filter(F.coalesce(held, F.array().cast(RUNS)), lambda r: r["s"].isNotNull() & r["e"].isNotNull())


def woven(df: DataFrame, text: str, emphasis: str, links: str, into: str) -> DataFrame:
    """df with `into`: the text with its links (outside) and strong and em runs (inside) as markup.

    An event sweep: the text is cut at every end of a run, each piece lies in a set
    of runs, ranked, and from piece to piece what no longer fits is closed and what
    is new is opened, so that marks that cross are split and the markup is nested.
    Links of one target no more than a character apart are one. Runs that are empty,
    reach out of the text or are of another kind leave no mark; a null text is empty;
    a link without target points to nothing. White space is joined at the end.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    ranked = lambda rank, r, i, open_, close: F.struct(F.lit(rank).alias("rank") if isinstance(rank, int) else rank.alias("rank"), r["s"].alias("s"), (-r["e"]).alias("back"), i.cast("int").alias("i"), r["e"].alias("e"), open_.alias("open"), close.alias("close"))
    joined = F.transform(runs.merged(_usable(F.col(links))), lambda r, i: ranked(0, r, i, F.concat(F.lit('<a href="'), F.coalesce(r["v"], F.lit("")), F.lit('">')), F.lit("</a>")))
    kinds = F.filter(_usable(F.col(emphasis)), lambda r: r["v"].isin("strong", "em"))
    marks = F.transform(kinds, lambda r, i: ranked(F.when(r["v"] == "strong", 1).otherwise(2), r, i, F.concat(F.lit("<"), r["v"], F.lit(">")), F.concat(F.lit("</"), r["v"], F.lit(">"))))
    ends = F.flatten(F.transform("_wraps", lambda w: F.array(w["s"], w["e"])))
    inside = F.filter(ends, lambda p: (p >= 0) & (p <= F.length("_said")))
    points = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.length("_said")), inside)))
    pieces = F.when(F.size("_points") > 1, F.transform(F.sequence(F.lit(1), F.size("_points") - 1), lambda k: F.struct(F.element_at("_points", k).alias("a"), F.element_at("_points", k + 1).alias("b"))))
    sets = F.transform("_pieces", lambda p: F.filter("_wraps", lambda w: (w["s"] <= p["a"]) & (p["b"] <= w["e"])))
    tags = lambda held, of: F.array_join(F.transform(held, lambda w: w[of]), "")
    from_ = lambda held, n: F.slice(held, n + 1, F.greatest(F.lit(0), F.size(held) - n))

    # each step is a column of its own, so that nothing is worked out twice for a piece
    pairs = F.transform("_pieces", lambda p, k: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.coalesce(F.get("_sets", k - 1), F.array().cast(WRAP)).alias("before"), F.get("_sets", k).alias("now")))
    kept = F.transform("_pairs", lambda x: F.array_position(F.zip_with(x["before"], x["now"], lambda v, w: v["i"].eqNullSafe(w["i"]) & v["rank"].eqNullSafe(w["rank"])), False))
    same = F.zip_with("_pairs", "_kept", lambda x, f: F.when(f > 0, f - 1).otherwise(F.size(x["now"])).cast("int"))
    piece = F.zip_with("_pairs", "_same", lambda x, n: F.concat(tags(F.reverse(from_(x["before"], n)), "close"), tags(from_(x["now"], n), "open"), F.substring(F.col("_said"), x["a"] + 1, x["b"] - x["a"])))

    steps = df.withColumns({"_said": said, "_wraps": F.array_sort(F.concat(joined, marks).cast(WRAP))})
    steps = steps.withColumn("_points", points).withColumn("_pieces", pieces).withColumn("_sets", sets)
    steps = steps.withColumn("_pairs", pairs).withColumn("_kept", kept).withColumn("_same", same)
    body = F.array_join(piece, "")
    last = tags(F.reverse(F.element_at("_sets", -1)), "close")
    return steps.withColumn(into, plain(F.when(F.col("_pieces").isNull(), "").otherwise(F.concat(body, last)))).drop("_said", "_wraps", "_points", "_pieces", "_sets", "_pairs", "_kept", "_same")


def canonical(kind: Column, level: Column, marked: Column, text: Column) -> Column:
    """The lasting form of a heading or paragraph, by its marks; of anything else its text alone."""
    tag = F.concat(F.lit("h"), F.coalesce(level.cast("string"), F.lit("")))
    return F.when(kind == "heading", F.concat(F.lit("<"), tag, F.lit(">"), marked, F.lit("</"), tag, F.lit(">"))).when(kind == "paragraph", marked).otherwise(plain(text))


def canonical_lists(items: DataFrame, keys: list[str], order: str, marked: str, ordered: str) -> DataFrame:
    """keys, canonical: a list's items in order, in <ol> where `ordered` names their style, else in <ul>."""
    listed = F.array_sort(F.collect_list(F.struct(order, F.col(marked).alias("_m"))))
    body = F.array_join(F.transform(listed, lambda x: F.concat(F.lit("<li>"), F.coalesce(x["_m"], F.lit("")), F.lit("</li>"))), "")
    style = F.max(ordered)
    tag = F.when(F.col("_style").isNull(), "ul").otherwise("ol")
    kind = F.when(F.col("_style").isNull(), "").otherwise(F.concat(F.lit(' type="'), F.col("_style"), F.lit('"')))
    return items.groupBy(*keys).agg(body.alias("_body"), style.alias("_style")).select(*keys, F.concat(F.lit("<"), tag, kind, F.lit(">"), "_body", F.lit("</"), tag, F.lit(">")).alias("canonical"))


def flowed(lines: Column) -> Column:
    """Lines as one text with the runs of all: struct<text, runs>.

    lines: array<struct<text, runs, glue>> in order; glue: how a line goes on with
    the one before: 'join' (the hyphen between them goes), 'keep' (it stays, without
    a space), else by a space. Runs of one value that meet over a break are one.
    """
    empty = F.struct(F.lit("").alias("text"), F.array().cast(RUNS).alias("runs"))

    def add(held: Column, line: Column) -> Column:
        said = F.coalesce(line["text"], F.lit(""))
        hyphen = held["text"].endswith("-")
        out = F.when(hyphen & (line["glue"] == "join"), F.substring(held["text"], F.lit(1), F.length(held["text"]) - 1)).when(hyphen & (line["glue"] == "keep"), held["text"]).when(held["text"] == "", held["text"]).otherwise(F.concat(held["text"], F.lit(" ")))
        return F.struct(F.concat(out, said).alias("text"), F.concat(held["runs"], runs.shifted(_usable(line["runs"]), F.length(out))).alias("runs"))

    return F.aggregate(lines, empty, add, lambda held: F.struct(held["text"].alias("text"), runs.merged(held["runs"]).alias("runs")))
