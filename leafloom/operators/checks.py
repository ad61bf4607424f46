"""Assertions about a document's content: one row per check, with whether it holds.

Checks come as rows (check_id, doc_id, kind, args array). Each is answered from
the leaves that contain its arguments, found by one join on the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import key_text



def results(checks: DataFrame, leaves: DataFrame, doc_id: str, order: str, text: str, kind: str = "kind_of_leaf") -> DataFrame:
    """check_id, kind, passed.

    in_flow: a leaf has the text; absent: none has; order: the first text comes
    before the second; merge: one leaf has both; split: no leaf has both; role:
    the leaf with the first text is of the kind named second; freeze: a leaf
    equals the text.
    """
    a, b = key_text(F.element_at("args", 1)), key_text(F.coalesce(F.try_element_at("args", F.lit(2)), F.lit("")))
    keyed = leaves.select(F.col(doc_id).alias("_d"), F.col(order).alias("_o"), key_text(F.col(text)).alias("_t"), F.col(kind).alias("_k"))
    asked = checks.withColumns({"_a": a, "_b": b})
    both = asked.join(keyed, asked.doc_id == keyed._d, "left")
    has_a, has_b = F.col("_t").contains(F.col("_a")), F.col("_t").contains(F.col("_b"))
    found = both.groupBy("check_id", "kind").agg(
        F.min(F.when(has_a, F.col("_o"))).alias("at_a"),
        F.min(F.when(has_b, F.col("_o"))).alias("at_b"),
        F.coalesce(F.bool_or(has_a & has_b), F.lit(False)).alias("together"),
        F.coalesce(F.bool_or(F.col("_t") == F.col("_a")), F.lit(False)).alias("same"),
        F.coalesce(F.bool_or(has_a & (F.lower("_k") == F.lower(F.element_at("args", -1)))), F.lit(False)).alias("of_kind"),
    )
    known, other = F.col("at_a").isNotNull(), F.col("at_b").isNotNull()
    passed = (
        F.when(F.col("kind") == "in_flow", known)
        .when(F.col("kind") == "absent", ~known)
        .when(F.col("kind") == "order", known & other & (F.col("at_a") < F.col("at_b")))
        .when(F.col("kind") == "merge", F.col("together"))
        .when(F.col("kind") == "split", known & other & ~F.col("together"))
        .when(F.col("kind") == "role", F.col("of_kind"))
        .when(F.col("kind") == "freeze", F.col("same"))
    )
    return found.select("check_id", "kind", F.coalesce(passed, F.lit(False)).alias("passed"))


def container_results(checks: DataFrame, leaves: DataFrame) -> DataFrame:
    """check_id, kind, passed, for checks about what stands inside what.

    leaves: doc_id, ord, text, path (ids from the root down to the leaf) and
    kinds (of those nodes). in_figure: all texts stand below one figure;
    not_in_figure: all are there, none below a figure; list: all stand in one
    list, in the order given; not_list: all are there, none in a list; nested:
    the second text stands in a list below the list item of the first.
    """
    asked = checks.select("check_id", "doc_id", "kind", F.size("args").alias("_n"), F.posexplode("args").alias("_i", "_arg"))
    found = asked.join(leaves, "doc_id").where(key_text(F.col("text")).contains(key_text(F.col("_arg"))))
    want = F.when(F.col("kind").isin("in_figure", "not_in_figure"), "figure").otherwise("list")
    pairs = F.arrays_zip(F.col("path").alias("id"), F.col("kinds").alias("of"))
    inside = F.filter(pairs, lambda p: p["of"] == F.col("_want"))
    held = found.withColumn("_want", want).select("check_id", "kind", "_n", "_i", "ord", "path", "kinds", F.transform(inside, lambda p: p["id"]).alias("_in"))
    there = held.groupBy("check_id").agg(F.count_distinct("_i").alias("_there"), F.max(F.size("_in")).alias("_deep"))
    # one row for each container that has any of the texts
    by_box = held.select("check_id", "_n", "_i", "ord", F.explode("_in").alias("_box")).groupBy("check_id", "_box", "_n", "_i").agg(F.min("ord").alias("_o"))
    whole = by_box.groupBy("check_id", "_box", "_n").agg(F.array_sort(F.collect_list(F.struct("_i", "_o"))).alias("_at")).where(F.size("_at") == F.col("_n"))
    places = F.transform("_at", lambda x: x["_o"])
    rising = F.forall(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(places) - 1)), lambda k: (F.size(places) < 2) | (F.try_element_at(places, k) < F.try_element_at(places, k + 1))), lambda x: x)
    together = whole.groupBy("check_id").agg(F.lit(True).alias("_one"), F.bool_or(rising).alias("_order"))
    item = F.transform(F.filter(pairs, lambda p: p["of"] == "item"), lambda p: p["id"])
    own = held.where("kind = 'nested'").select("check_id", "_i", "path", "kinds", item.alias("_items"), F.size("_in").alias("_lists"))
    first = own.where("_i = 0").select("check_id", F.try_element_at("_items", F.lit(-1)).alias("_item"), F.col("_lists").alias("_outer"))
    nested = own.where("_i = 1").join(first, "check_id").where(F.array_contains("_items", F.col("_item")) & (F.col("_lists") > F.col("_outer"))).select("check_id", F.lit(True).alias("_nested")).distinct()
    all_ = checks.select("check_id", "kind", F.size("args").alias("_n")).join(there, "check_id", "left").join(together, "check_id", "left").join(nested, "check_id", "left")
    every, yes = F.coalesce(F.col("_there") == F.col("_n"), F.lit(False)), lambda c: F.coalesce(F.col(c), F.lit(False))
    passed = (
        F.when(F.col("kind") == "in_figure", yes("_one"))
        .when(F.col("kind") == "list", yes("_order"))
        .when(F.col("kind").isin("not_in_figure", "not_list"), every & (F.coalesce(F.col("_deep"), F.lit(0)) == 0))
        .when(F.col("kind") == "nested", yes("_nested"))
    )
    return all_.select("check_id", "kind", F.coalesce(passed, F.lit(False)).alias("passed"))


def attribute_results(checks: DataFrame, nodes: DataFrame) -> DataFrame:
    """check_id, passed: some node that the anchor names (its id, or the beginning of its text) has all the wanted attributes (float, colour, header, columns ...).

    checks: check_id, doc_id, anchor, wanted map<string,string>. nodes: doc_id, nid, text, attrs map<string,string>.
    """
    named = (F.col("nid") == F.col("anchor")) | F.startswith(F.col("text"), F.col("anchor"))
    held = F.forall(F.map_keys("wanted"), lambda k: F.col("attrs")[k].eqNullSafe(F.col("wanted")[k]))
    met = checks.join(nodes, "doc_id").where(named & held).select("check_id").distinct().withColumn("_yes", F.lit(True))
    return checks.select("check_id").join(met, "check_id", "left").select("check_id", F.coalesce("_yes", F.lit(False)).alias("passed"))


def cell_results(checks: DataFrame, rows: DataFrame) -> DataFrame:
    """check_id, passed: some table row's first cells begin with the given texts. rows: doc_id, cells array<string>."""
    fits = (F.size("cells") >= F.size("args")) & F.forall(F.arrays_zip(F.col("args").alias("a"), F.slice("cells", 1, F.size("args")).alias("c")), lambda p: F.coalesce(F.startswith(p["c"], p["a"]), F.lit(False)))
    met = checks.join(rows, "doc_id").where(fits).select("check_id").distinct().withColumn("_yes", F.lit(True))
    return checks.select("check_id").join(met, "check_id", "left").select("check_id", F.coalesce("_yes", F.lit(False)).alias("passed"))
