"""Conversation prefix trie (13): chained prefix digests, a node for each (depth, digest), sums over subtrees.

A conversation's turns are hashed one by one where they lie; the digest of its
first d turns is SHA-256 of the digest of the first d - 1 and the dth turn's, so a
chain needs 32 bytes a turn and no text. Every prefix is a row; equal (depth,
digest) are a node. A node is named by (smallest member, depth), and its ancestors
are that member's shorter prefixes: it is exploded to those of its own block of
`BLOCK` depths and, as one sum for each block above, to theirs; then the sums are
added by node. So a conversation of D turns costs D * (BLOCK + D / BLOCK) rows and
not D * D, and up to BLOCK turns it is the plain explosion.

The list of a node's ending conversations is hashed in order without being held:
ranges of (node, id) are joined to pieces, and one task for each node hashes its
pieces one after another. Nothing but sums is grouped by node.

Defined cases. Turns are ordered by turn (null first), equal ones by role, then
text; null role or text counts as empty. Rows that repeat are turns of their own.
Rows without a conv_id belong to no conversation. A conversation without turns
after rebuilding is a member of the root alone. An empty table has no node, not
even a root. Texts of any length are hashed where they lie. A conversation's chain
is sequential: one task streams it, holding one digest. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CRC32_SQL, table, wide_shuffle, written

#: Depths of a block of ancestors.
BLOCK = 32
#: Bytes of a piece of a list of ids.
PIECE = 1 << 16

ROOT = hashlib.sha256(b"").digest()
NO_ENDS = hashlib.sha256(b"").hexdigest()

PREFIXES = "conv_id long, depth long, digest binary, parent binary, bytes long, last boolean"


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 1), digest, bytes of every turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    one = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select("conv_id", place.cast("long").alias("place"), F.unhex(F.sha2(one, 256)).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def borrowed_turns(conv_id: Column) -> tuple[Column, Column]:
    """Which conversation a conversation's first turns come from, and how many."""
    return conv_id - conv_id % 5, F.crc32(conv_id.cast("string")) % 9


def rebuilt(said: DataFrame, source=borrowed_turns) -> DataFrame:
    """conv_id, own (0 borrowed, 1 its own), place, digest, bytes: the first turns of another conversation, then a conversation's own after as many. source: from conv_id, that conversation and the number; at most 8."""
    base, most = source(F.col("conv_id"))
    convs = said.where("place = 1").select("conv_id", base.alias("base"), most.alias("most"))
    lent = said.where("place <= 8").withColumnRenamed("conv_id", "base")
    borrowed = convs.join(lent, "base").where("place <= most").select("conv_id", F.lit(0).alias("own"), "place", "digest", "bytes")
    kept = said.where(F.col("place") > most).select("conv_id", F.lit(1).alias("own"), "place", "digest", "bytes")
    return borrowed.unionByName(kept)


def chained(rows: DataFrame) -> DataFrame:
    """Every prefix of every conversation (own, place: the order of its turns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PREFIXES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        waiting: tuple | None = None
        for batch in batches:
            out = []
            for conv, digest, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "bytes"))):
                same = waiting is not None and waiting[0] == conv
                if waiting is not None:
                    out.append((*waiting, not same))
                depth, parent = (waiting[1] + 1, waiting[2]) if same else (1, ROOT)
                waiting = (conv, depth, hashlib.sha256(parent + digest).digest(), parent, size)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)], names=names)
        if waiting is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip((*waiting, True), kinds)], names=names)

    n = wide_shuffle(rows.sparkSession)
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "own", "place").mapInArrow(run, PREFIXES)


def id_digests(ends: DataFrame) -> DataFrame:
    """depth, digest, ends_sha256 of the ascending ids that end at a node (ends: depth, digest, conv_id; a written table)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, held, size = None, None, [], 0

        def ready():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.binary()), pa.array([head], pa.int64()), pa.array([",".join(held)])], names=["depth", "digest", "head", "ids"])

        for batch in batches:
            for depth, digest, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "digest", "conv_id"))):
                if held and (key != (depth, digest) or size > PIECE):
                    yield ready()
                    held, size = [], 0
                if not held:
                    key, head = (depth, digest), conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield ready()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["depth", "digest", "ends_sha256"], [pa.int64(), pa.binary(), pa.string()]
        key, running = None, None
        for batch in batches:
            out = []
            for depth, digest, ids in zip(*(batch.column(c).to_pylist() for c in names[:2] + ["ids"])):
                if key == (depth, digest):
                    running.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, running.hexdigest()))
                key, running = (depth, digest), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip((*key, running.hexdigest()), kinds)], names=names)

    n = wide_shuffle(ends.sparkSession)
    order = ["depth", "digest", "conv_id"]
    joined = ends.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(pieces, "depth long, digest binary, head long, ids string")
    return joined.repartition(n, "depth", "digest").sortWithinPartitions("depth", "digest", "head").mapInArrow(hashed, "depth long, digest binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, prefixes: DataFrame, block: int = BLOCK) -> DataFrame:
    """depth, digest, n_leaves, saved_tokens: the nodes' own values (leaf, saved) summed over each node's subtree."""
    totals = [F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")]
    at = F.col("depth")
    first = F.col("depth") - F.col("depth") % block
    near = nodes.select("conv_id", F.explode(F.sequence(first, at)).alias("depth"), "leaf", "saved")
    above = nodes.where(first > 0).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), first - block, F.lit(block).cast("long"))).alias("first"), "leaf", "saved")
    whole = above.groupBy("conv_id", "first").agg(*totals)
    far = whole.select("conv_id", F.explode(F.sequence(F.col("first"), F.col("first") + block - 1)).alias("depth"), "leaf", "saved")
    by_prefix = near.unionByName(far).groupBy("conv_id", "depth").agg(*totals)
    below = by_prefix.where("depth > 0").join(prefixes.select("conv_id", "depth", "digest"), ["conv_id", "depth"]).select("depth", "digest", "leaf", "saved")
    root = by_prefix.where("depth = 0").select("depth", F.lit(ROOT).alias("digest"), "leaf", "saved")
    return below.unionByName(root).groupBy("depth", "digest").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def trie(conversations: DataFrame, rebuild=rebuilt, block: int = BLOCK, **columns: str) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rebuild: from the turns to conv_id, own, place, digest, bytes.
    """
    said = written(turns(conversations, **columns), "trie-turns")
    prefixes = written(chained(rebuild(said)), "trie-prefixes")
    convs = said.where("place = 1").select("conv_id")
    long = F.lit(0).cast("long")
    grouped = prefixes.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(long.alias("depth"), F.lit(ROOT).alias("digest"), "conv_id", "n_convs", F.lit(None).cast("binary").alias("parent"), long.alias("bytes"))
    members = written(grouped.unionByName(root), "trie-members")
    children = members.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = written(members.join(children, ["depth", "digest"], "left").withColumns({"n_children": F.coalesce("n_children", long), "leaf": F.when(F.col("n_children") > 0, 0).otherwise(1).cast("long"), "saved": saved}), "trie-nodes")
    turnless = convs.join(prefixes.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(long.alias("depth"), F.lit(ROOT).alias("digest"), "conv_id")
    ends = written(prefixes.where("last").select("depth", "digest", "conv_id").unionByName(turnless), "trie-ends")
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = written(nodes.where("depth > 0").join(parents, ["depth", "parent"]).select("depth", "digest", "parent_conv_id"), "trie-parents")
    return (
        nodes.join(found, ["depth", "digest"], "left")
        .join(subtree_sums(nodes, prefixes, block), ["depth", "digest"])
        .join(id_digests(ends), ["depth", "digest"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of every rebuilt conversation of the whole table."""
    return trie(table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT DISTINCT c, c - c % 5 AS base, {CRC32_SQL.format("CAST(c AS VARCHAR)")} % 9 AS h FROM t
), r AS (
  SELECT c.c, 0 AS own, place, role, text FROM c JOIN t ON t.c = c.base AND t.place <= c.h
  UNION ALL
  SELECT c.c, 1, place, role, text FROM c JOIN t ON t.c = c.c AND t.place > c.h
), p AS (
  SELECT c, row_number() OVER w AS depth, strlen(text) AS bytes, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER w AS path
  FROM r WINDOW w AS (PARTITION BY c ORDER BY own, place)
  UNION ALL
  SELECT c, 0, 0, '' FROM c
), n AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes FROM p GROUP BY path, depth
), k AS (
  SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM n LEFT JOIN k USING (path)
), s AS (
  SELECT path, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (
    SELECT left(path, 64 * unnest(range(depth + 1))) AS path, CAST(n_children = 0 AS BIGINT) AS leaf, saved FROM v
  ) GROUP BY path
), e AS (
  SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, max(path) AS path FROM p GROUP BY c) GROUP BY path
)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN n u ON v.depth > 0 AND u.path = left(v.path, 64 * (v.depth - 1))
"""
