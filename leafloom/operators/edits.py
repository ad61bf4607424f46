"""Replay of an edit log over the nodes of documents.

Edits come in order of `seq` and concern one document each: set-text, set-level,
delete, note (the node's text becomes the record of note `value`), ref (a reference
to note `value` is added to the node's end), reorder (all nodes of a document, or
those of one page), merge (a node's text goes on with another's, which goes).

The edits of a node are folded in order by an aggregate; then nodes below a deleted
one go, siblings are put in order, and merges are applied. What can't be applied is
a row of its own with its reason, not a failure.

Nulls: edits without document, kind or seq are conflicts ('incomplete'); nodes
without document or id are left out. Edits of equal seq follow by node, kind and
value. Nodes that repeat an id are one (the first by place, parent, then a hash of the text). An empty log leaves
the nodes as they are; an empty table of nodes makes every edit a conflict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grouped import grouped
from ..plans.storage import stored
from . import markers

NODE = "kind string, level int, has boolean, gone string, touched string, refs array<int>"
ON_NODES = ("set-text", "set-level", "delete", "note", "ref")


def note_value(raw: Column) -> Column:
    """The note that an edit names: a number, or a letter (a is 1001)."""
    mark = F.trim(raw)
    return F.when(mark.rlike("^[0-9]+$"), mark.try_cast("int")).when(mark.rlike(r"^\p{L}$"), F.ascii(F.lower(mark)) - 96 + markers.LETTERS_FROM)


def applied(state: Column, op: Column) -> Column:
    """A node, but for its text, after one more edit; a node that is gone stays as it is."""
    level = op["value"].try_cast("int")
    into = lambda **new: F.struct(*[(new[c].cast(t) if c in new else state[c]).alias(c) for c, t in (x.strip().split(" ", 1) for x in NODE.split(", "))])
    has_text = state["has"]
    value = note_value(op["value"])
    kind = state["kind"]
    levelled = into(
        kind=F.when((level <= 0) & (kind == "heading"), "paragraph").when((level > 0) & (kind == "paragraph"), "heading").otherwise(kind),
        level=F.when((level <= 0) & (kind == "heading"), F.lit(None)).when((level > 0) & kind.isin("heading", "paragraph"), F.least(level, F.lit(6))).otherwise(state["level"]),
        refs=F.when((level > 0) & (kind == "paragraph"), F.array().cast("array<int>")).otherwise(state["refs"]),
    )
    return (
        F.when(state["gone"].isNotNull(), state)
        .when(op["kind"] == "delete", into(gone=F.lit("deleted")))
        .when((op["kind"] == "note") & has_text & value.isNotNull(), into(gone=F.lit("note"), touched=op["value"]))
        .when((op["kind"] == "ref") & has_text & value.isNotNull() & op["fresh"], into(refs=F.concat(state["refs"], F.array(value))))
        .when((op["kind"] == "set-text") & has_text, into(touched=F.lit("set-text"), refs=F.array().cast("array<int>")))
        .when((op["kind"] == "set-level") & level.isNotNull(), levelled)
        .otherwise(state)
    )


def spoken(state: Column, op: Column) -> Column:
    """A node's text (struct<text, over>) after one more edit; over: the node is gone, and its text stays as it was."""
    value = note_value(op["value"])
    as_ = lambda text, over: F.struct(text.alias("text"), over.alias("over"))
    return (
        F.when(state["over"] | state["text"].isNull(), state)
        .when((op["kind"] == "delete") | ((op["kind"] == "note") & value.isNotNull()), as_(state["text"], F.lit(True)))
        .when((op["kind"] == "ref") & value.isNotNull() & op["fresh"], as_(F.concat(state["text"], F.trim(op["value"])), F.lit(False)))
        .when(op["kind"] == "set-text", as_(F.coalesce(op["value"], F.lit("")), F.lit(False)))
        .otherwise(state)
    )


def merged(nodes: list[tuple], ops: list[tuple]) -> tuple[dict[str, list[str]], list[tuple]]:
    """Which nodes' texts each remaining node is made of, in order, and why merges were passed over. nodes: (nid, has text); ops: (seq, into, from)."""
    parts = {nid: [nid] for nid, text in nodes}
    plain = {nid for nid, text in nodes if text}
    why = []
    for seq, into, frm in ops:
        reason = (
            "into not found" if into not in parts
            else "from not found" if frm not in parts
            else "same node" if into == frm
            else "into has no text" if into not in plain
            else "from has no text" if frm not in plain
            else None
        )
        if reason:
            why.append((seq, into, frm, reason))
        else:
            parts[into] += parts.pop(frm)
    return parts, why


def replayed(nodes: DataFrame, edits: DataFrame, doc: str = "doc", parent: str = "parent", place: str = "place") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, note records and conflicts after all edits.

    nodes: doc, nid, parent (nid, null at the top), place (among siblings), page,
    kind, level, text, refs (array of note numbers). edits: doc, seq, kind, nid,
    value, other (merge: the node that goes), page and order (array of nids) of a
    reorder. Out: (doc, nid, parent, place, page, kind, level, text, refs, edited),
    (doc, page, n, marker, text), (doc, seq, kind, nid, reason).
    """
    # nodes without their texts take all the steps; texts come in where they are changed, and at the end
    named = nodes.where(F.col(doc).isNotNull() & F.col("nid").isNotNull()).withColumn("_h", F.xxhash64("text"))
    first = F.row_number().over(Window.partitionBy(doc, "nid").orderBy(F.col(place).cast("long"), F.asc_nulls_first(parent), "_h"))
    one = lambda *columns: named.select(doc, "nid", parent, place, "_h", *columns).withColumn("_r", first).where("_r = 1")
    structure = one("page", "kind", "level", F.col("text").isNotNull().alias("has"), "refs")
    held = stored(structure.select(F.col(doc).alias("doc"), "nid", F.col(parent).alias("parent"), F.col(place).cast("long").alias("place"), "page", "kind", F.col("level").cast("int").alias("level"), "has", F.coalesce(F.col("refs"), F.array()).cast("array<int>").alias("refs")), "edit-nodes")
    texts = one("text").select(F.col(doc).alias("doc"), "nid", "text")
    log = edits.select(F.col(doc).alias("doc"), "seq", "kind", "nid", "value", "other", F.col("page").alias("_page"), "order")
    whole = F.col("doc").isNotNull() & F.col("kind").isNotNull() & F.col("seq").isNotNull()
    faults = [log.where(~whole | ((F.col("kind") != "reorder") & F.col("nid").isNull())).select("doc", "seq", "kind", "nid", F.lit("incomplete").alias("reason"))]
    log = log.where(whole)
    known = ("reorder", "merge", *ON_NODES)
    faults.append(log.where(~F.col("kind").isin(*known) & F.col("nid").isNotNull()).select("doc", "seq", "kind", "nid", F.lit("unknown kind").alias("reason")))

    # -- edits of single nodes, folded in order
    single = log.where(F.col("kind").isin(*ON_NODES) & F.col("nid").isNotNull())
    # a reference is added only where the document has none to that note yet, and once
    cited = held.select("doc", F.explode("refs").alias("_n")).distinct()
    added = single.where("kind = 'ref'").withColumn("_n", note_value(F.col("value")))
    with_text = held.where("has").select("doc", "nid")
    fresh = added.where("_n IS NOT NULL").join(with_text, ["doc", "nid"]).join(cited, ["doc", "_n"], "left_anti").groupBy("doc", "_n").agg(F.min(F.struct("seq", "nid")).alias("_first"))
    fresh = fresh.select("doc", F.col("_first.seq").alias("seq"), F.col("_first.nid").alias("nid"), "_n", F.lit(True).alias("fresh"))
    told = single.withColumn("_n", F.when(F.col("kind") == "ref", note_value(F.col("value")))).join(fresh, ["doc", "seq", "nid", "_n"], "left")
    ops = told.groupBy("doc", "nid").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "value", F.coalesce("fresh", F.lit(False)).alias("fresh")))).alias("_ops"))
    node = f"struct<{','.join(c.replace(' ', ':', 1) for c in NODE.split(', '))}>"
    start = F.struct("kind", "level", "has", F.lit(None).cast("string").alias("gone"), F.lit(None).cast("string").alias("touched"), "refs").cast(node)
    folded = held.join(ops, ["doc", "nid"], "left").withColumn("_s", F.when(F.col("_ops").isNull(), start).otherwise(F.aggregate("_ops", start, applied)))
    state = stored(folded.select("doc", "nid", "parent", "place", "page", "_s.*"), "edit-state")
    said = F.aggregate("_ops", F.struct("text", F.lit(False).alias("over")), spoken, lambda x: x["text"])
    changed = stored(texts.join(ops, ["doc", "nid"]).select("doc", "nid", said.alias("_new")), "edit-texts")
    faults.append(single.join(held.select("doc", "nid"), ["doc", "nid"], "left_anti").select("doc", "seq", "kind", "nid", F.lit("node not found").alias("reason")))
    records = state.where("gone = 'note'").join(changed, ["doc", "nid"]).select("doc", "page", note_value(F.col("touched")).alias("n"), F.col("touched").alias("marker"), F.col("_new").alias("text"))

    # -- what lies below a node that is gone goes with it: each round takes the next level
    lost = state.where("gone IS NOT NULL").select("doc", "nid")
    every = lost
    while not lost.isEmpty():
        lost = stored(state.join(lost.withColumnRenamed("nid", "parent"), ["doc", "parent"]).join(every, ["doc", "nid"], "left_anti").select("doc", "nid"), "edit-lost")
        every = every.unionByName(lost)
    left = state.join(every, ["doc", "nid"], "left_anti").drop("gone")

    # -- order: the last whole-document order, then the last of each page
    orders = log.where("kind = 'reorder' AND size(order) > 0")
    last = orders.where("_page IS NULL").groupBy("doc").agg(F.max_by("order", "seq").alias("order"))
    ranks = last.select("doc", F.posexplode("order").alias("_rank", "nid")).groupBy("doc", "nid").agg(F.max("_rank").alias("_rank"))
    among = Window.partitionBy("doc", "parent").orderBy("place", "nid")
    ranked = left.join(ranks, ["doc", "nid"], "left").join(last.select("doc", F.lit(True).alias("_all")), "doc", "left")
    # a node that the order doesn't name stays behind the named one that it followed
    behind = F.coalesce(F.last("_rank", ignorenulls=True).over(among.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))
    keyed = ranked.withColumns({"_behind": F.when(F.col("_all"), behind).otherwise(0), "_was": F.row_number().over(among), "_before": F.lag("nid").over(among)})
    after = Window.partitionBy("doc", "parent").orderBy("_behind", F.asc(F.col("_rank").isNull()), "_was")
    moved = F.col("_all") & ~F.lag("nid").over(after).eqNullSafe(F.col("_before"))
    placed = keyed.withColumns({"place": F.row_number().over(after).cast("long") - 1, "_moved": F.coalesce(moved, F.lit(False))})
    pages = orders.where("_page IS NOT NULL").groupBy("doc", F.col("_page").alias("page")).agg(F.max_by("order", "seq").alias("order"))
    seats = pages.select("doc", "page", F.posexplode("order").alias("_seat", "nid")).groupBy("doc", "page", "nid").agg(F.max("_seat").alias("_seat"))
    top = placed.where("parent IS NULL").join(pages.select("doc", "page"), ["doc", "page"]).join(seats, ["doc", "page", "nid"], "left")
    own, new = Window.partitionBy("doc", "page").orderBy("place"), Window.partitionBy("doc", "page").orderBy(F.coalesce("_seat", F.lit(2**31 - 1)), "place")
    slots = top.select("doc", "page", "place", F.row_number().over(own).alias("_k"))
    seated = top.select("doc", "page", "nid", F.row_number().over(new).alias("_k")).join(slots, ["doc", "page", "_k"]).select("doc", "nid", F.col("place").alias("_slot"))
    ordered = placed.join(seated, ["doc", "nid"], "left").withColumn("place", F.coalesce("_slot", "place")).withColumn("edited", F.coalesce("touched", F.when(F.col("_moved"), "reorder"))).select("doc", "nid", "parent", "place", "page", "kind", "level", "has", "refs", "edited")
    ordered = stored(ordered, "edit-ordered")
    named = orders.select("doc", "seq", "kind", F.explode("order").alias("nid")).join(ordered.select("doc", "nid"), ["doc", "nid"], "left_anti")
    faults.append(named.select("doc", "seq", "kind", "nid", F.lit("node not found").alias("reason")))

    # -- merges: which texts join is decided on ids alone, by document; only those that a merge names take part
    asked = log.where("kind = 'merge' AND nid IS NOT NULL").select("doc", "seq", F.col("nid").alias("into"), F.col("other").alias("frm"))
    concerned = asked.select("doc", F.explode(F.array("into", "frm")).alias("nid")).where("nid IS NOT NULL").distinct()
    present = ordered.join(concerned, ["doc", "nid"]).select("doc", F.lit(None).cast("long").alias("seq"), F.col("nid").alias("a"), F.lit(None).cast("string").alias("b"), "has")
    rows = present.unionByName(asked.select("doc", F.col("seq").cast("long").alias("seq"), F.col("into").alias("a"), F.col("frm").alias("b"), F.lit(None).cast("boolean").alias("has")))
    schema = T.StructType([rows.schema["doc"], *[T.StructField(n, t) for n, t in (("seq", T.LongType()), ("nid", T.StringType()), ("part", T.StringType()), ("k", T.LongType()), ("reason", T.StringType()))]])

    def work(group: list[tuple]) -> list[tuple]:
        parts, why = merged([(a, has) for _, seq, a, _, has in group if seq is None], [(seq, a, b) for _, seq, a, b, _ in group if seq is not None])
        doc_ = group[0][0]
        return [(doc_, None, root, part, k, None) for root, held_ in parts.items() if len(held_) > 1 for k, part in enumerate(held_)] + [(doc_, seq, a, b, None, reason) for seq, a, b, reason in why]

    joined = stored(grouped(rows, ["doc"], ["seq", "a", "b"], work, schema), "edit-merges")
    faults.append(joined.where("reason IS NOT NULL").select("doc", "seq", F.lit("merge").alias("kind"), "nid", "reason"))
    # every node's text with those merged into it, by the node that stays
    parts = joined.where("reason IS NULL").select("doc", F.col("part").alias("nid"), F.col("nid").alias("_root"), "k")
    whole = ordered.join(texts, ["doc", "nid"]).join(changed, ["doc", "nid"], "left").join(parts, ["doc", "nid"], "left")
    own = whole.select("*", F.coalesce("_root", "nid").alias("_into"), F.coalesce("k", F.lit(0).cast("long")).alias("_k"), F.coalesce("_new", "text").alias("_said"))
    listed = F.array_sort(F.collect_list(F.struct("_k", "_said", "refs")))
    stays = F.max(F.when(F.col("_k") == 0, F.struct("parent", "place", "page", "kind", "level", "edited")))
    glue = lambda held_, x: F.concat(held_, F.when((held_ == "") | held_.endswith("-") | held_.endswith(" "), "").otherwise(" "), x["_said"])
    grouped_ = own.groupBy("doc", F.col("_into").alias("nid")).agg(listed.alias("_p"), stays.alias("_n"))
    text = F.aggregate(F.slice("_p", 2, F.size("_p")), F.get("_p", F.lit(0))["_said"], glue)
    out = grouped_.select("doc", "nid", *[F.col(f"_n.{c}").alias(c) for c in ("parent", "place", "page", "kind", "level")], text.alias("text"), F.flatten(F.transform("_p", lambda x: x["refs"])).alias("refs"), F.when(F.size("_p") > 1, "merge").otherwise(F.col("_n.edited")).alias("edited"))
    conflicts = faults[0].select("doc", F.col("seq").cast("long").alias("seq"), "kind", "nid", "reason")
    for f in faults[1:]:
        conflicts = conflicts.unionByName(f.select("doc", F.col("seq").cast("long").alias("seq"), "kind", "nid", "reason"))
    return out, records, conflicts
