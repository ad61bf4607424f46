"""Exact top-k search (11): distributed histogram selection.

Components are turned into floor(256 * x), x as double; a score is the integer
inner product. Every round scores all rows against all queries and counts, for
each query, the scores by their leading bits in one global histogram; the bin
that holds the query's kth score is cut into finer bins by the next round, until
a bin is one value. Then a last scan keeps the scores above the kth value and the
smallest ids among those equal to it.

Queries and rows meet in blocks: rows are dealt to `parts`, queries to `lanes` of
`LANE` rows, and a task takes one lane and one part, lane first, then streams its
part. It holds a lane, one Arrow batch of rows and at most k bins a query: a bin
below the task's own kth score can't hold the kth of all, so it is not counted.
Nothing passes through the driver but the number of queries and the largest norm.

Defined cases. Vectors null or holding a null or non-finite component take no
part, neither as query nor as row. A null id is no query; as a row it takes part,
and ties put it last. Rows that repeat an id are rows of their own, each a
candidate of the other; a query row leaves out itself alone. Vectors are compared
with those of the same number of components (none at all: score 0). Sums are
exact at any size: in single precision where the norms prove that they fit in 24
bits, in double where in 53, else in Python's integers; scores beyond a long are
given as its limits, and 256 * x beyond a double counts as the largest double. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, wide_shuffle, written

#: Queries of a lane; with their vectors they are what a task holds.
LANE = 16_384
#: Bits by which a round refines the histograms.
STEP = 10
#: Scores computed at a time.
PIECE = 1 << 20

LEAST, MOST = -(1 << 63), (1 << 63) - 1

QUANTISED = "rid long, id long, query boolean, v array<double>"


def quantised(rows: DataFrame) -> DataFrame:
    """rid, id, query and v with floor(256 * x) in place of x; rows with unusable vectors are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("v").is_valid())
            ends = np.r_[0, np.cumsum(pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False), dtype=np.int64)]
            x = pc.fill_null(batch.column("v").flatten(), np.nan).to_numpy(zero_copy_only=False)
            unusable = np.r_[0, np.cumsum(~np.isfinite(x))]
            ok = unusable[ends[1:]] == unusable[ends[:-1]]
            with np.errstate(over="ignore", invalid="ignore"):
                y = x * 256
                whole = np.where(np.isinf(y), np.copysign(np.finfo(np.float64).max, y), np.floor(y))
            vectors = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(whole))
            columns = [*(batch.column(c) for c in ("rid", "id", "query")), vectors]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "id", "query", "v"]).filter(pa.array(ok))

    return rows.mapInArrow(run, QUANTISED)


class Matrix:
    """Vectors of one length, kept as doubles, and in single precision where it is asked for."""

    def __init__(self, vectors: np.ndarray):
        self.wide = vectors
        with np.errstate(over="ignore"):
            self.norm = float(np.sqrt((vectors * vectors).sum(axis=1)).max()) if vectors.size else 0.0
        self.narrow = vectors.astype(np.float32) if self.norm < 1 << 24 else None


def scored(a: Matrix, b: Matrix) -> np.ndarray:
    """Inner products, as floats where the norms prove that every partial sum is exact, else as whole numbers."""
    bound = a.norm * b.norm * 1.001 + 1
    if bound < 1 << 24:
        return a.narrow @ b.narrow.T
    if bound < 1 << 53:
        return a.wide @ b.wide.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    exact = whole(a.wide) @ whole(b.wide).T
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def binned(scores: np.ndarray, shift: int) -> np.ndarray:
    """Scores by their leading bits: floor(score / 2 ** shift)."""
    if scores.dtype == np.int64:
        return scores >> np.int64(shift)
    return np.floor(scores.astype(np.float64) * 0.5**shift).astype(np.int64)


class Lane:
    """Queries of one vector length with where their kth score is known to be: its leading bits and how many are still to be taken there."""

    def __init__(self, rows: list[tuple], shift: int | None):
        self.rid = np.array([r[0] for r in rows], np.int64)
        self.known = np.array([r[1] for r in rows], np.int64)
        self.need = np.array([r[2] for r in rows], np.int64)
        self.vectors = np.array([r[3] for r in rows], np.float64).reshape(len(rows), -1)
        self.shift = shift
        n = len(rows)
        self.floor = np.full(n, LEAST, np.int64) if shift is None else self.known << np.int64(shift)
        self.matrices = {}
        self.held: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def slices(self, width: int) -> Iterator[tuple[int, int, Matrix]]:
        step = max(1, PIECE // max(1, width))
        if step not in self.matrices:
            self.matrices = {step: [Matrix(self.vectors[a : a + step]) for a in range(0, len(self.rid), step)]}
        for k, m in enumerate(self.matrices[step]):
            yield k * step, min(len(self.rid), (k + 1) * step), m


def best(q: np.ndarray, order: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Places of the first need[q] entries of each q, by `order` (least significant first)."""
    at = np.lexsort([*order, q])
    first = np.flatnonzero(np.r_[True, np.diff(q[at]) > 0]) if len(at) else np.zeros(0, np.int64)
    nth = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    return at[nth < need[q[at]]]


def above(scores: np.ndarray, floor: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of scores of at least the query's floor, but the query's own row."""
    limit = floor if scores.dtype == np.int64 else floor.astype(np.float64)
    if scores.dtype == np.float32:  # rounded down, so that no score is lost; what is let through is looked at again
        down = limit.astype(np.float32)
        limit = np.where(down > limit, np.nextafter(down, np.float32(-np.inf)), down).astype(np.float32)
    i, j = np.nonzero((scores >= limit[:, None]) & ~own)
    return i, j


def histogram(lane: Lane, rid: np.ndarray, vectors: np.ndarray, finer: int) -> None:
    """Counts the batch's scores by bins of 2 ** finer; only those that may hold the kth."""
    width = max(1, len(rid))
    rows = Matrix(vectors)
    for a, b, queries in lane.slices(width):
        s = scored(queries, rows)
        i, j = above(s, lane.floor[a:b], lane.rid[a:b, None] == rid[None, :])
        bins = binned(s[i, j], finer)
        ok = bins << np.int64(finer) >= lane.floor[a:b][i]
        if lane.shift is not None:
            ok &= bins >> np.int64(lane.shift - finer) == lane.known[a:b][i]
        lane.held.append((i[ok] + a, bins[ok]))
        lane.count += int(ok.sum())
        if lane.count > 4 * PIECE:
            settle(lane, finer)
    settle(lane, finer)


def settle(lane: Lane, finer: int) -> None:
    """Of the bins counted, those that may hold the kth; the lowest of them is the floor of what is counted from now on."""
    q, bins = (np.concatenate([x[k] for x in lane.held]) if lane.held else np.zeros(0, np.int64) for k in range(2))
    at = best(q, [~bins], lane.need)
    q, bins = q[at], bins[at]
    lane.held, lane.count = [(q, bins)], len(q)
    full = np.bincount(q, minlength=len(lane.rid)) >= lane.need
    low = np.full(len(lane.rid), MOST, np.int64)
    np.minimum.at(low, q, bins)
    full &= np.bincount(q, minlength=len(lane.rid)) > 0
    lane.floor[full] = np.maximum(lane.floor[full], low[full] << np.int64(finer))


def hits(lane: Lane, rid: np.ndarray, ids: list, vectors: np.ndarray) -> None:
    """Scores above the kth value, and of those equal to it the smallest ids."""
    rows = Matrix(vectors)
    null = np.array([x is None for x in ids], bool)
    value = np.array([0 if x is None else x for x in ids], np.int64)
    for a, b, queries in lane.slices(max(1, len(rid))):
        s = scored(queries, rows)
        i, j = above(s, lane.floor[a:b], lane.rid[a:b, None] == rid[None, :])
        lane.held.append((i + a, s[i, j].astype(np.int64), value[j], null[j]))
    q, s, v, n = (np.concatenate([x[k] for x in lane.held]) for k in range(4))
    ok = s >= lane.known[q]
    q, s, v, n = q[ok], s[ok], v[ok], n[ok]
    tie = s == lane.known[q]
    at = np.r_[np.flatnonzero(~tie), np.flatnonzero(tie)[best(q[tie], [v[tie], n[tie]], lane.need)]]
    lane.held = [(q[at], s[at], v[at], n[at])]


def scan(state: DataFrame, rows: DataFrame, lanes: int, parts: int, shift: int | None, finer: int | None) -> DataFrame:
    """One scoring of all rows against all queries: histogram rows (rid, need, bin, n), or with finer None hits (rid, score, id)."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mixed = F.xxhash64("rid")
    queries = state.select(spread(parts).alias("part"), F.pmod(mixed, F.lit(lanes)).cast("int").alias("lane"), F.lit(0).alias("kind"), "rid", F.lit(None).cast("long").alias("id"), "known", "need", "v")
    offered = rows.select(F.pmod(mixed, F.lit(parts)).cast("int").alias("part"), spread(lanes).alias("lane"), F.lit(1).alias("kind"), "rid", "id", F.lit(0).cast("long").alias("known"), F.lit(0).cast("long").alias("need"), "v")
    dealt = queries.unionByName(offered).repartitionById(lanes * parts, (F.col("lane") * parts + F.col("part")).cast("int")).sortWithinPartitions("kind").drop("part", "lane")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}
        held: dict[int, Lane] = {}
        for batch in batches:
            n = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            for size in np.unique(n):
                asked = batch.take(pa.array(np.flatnonzero((n == size) & (kind == 0))))
                waiting.setdefault(int(size), []).extend(zip(*(asked.column(c).to_pylist() for c in ("rid", "known", "need")), _vectors(asked, size)))
                for k in [k for k, r in waiting.items() if r and (kind == 1).any()]:
                    held[k] = Lane(waiting.pop(k), shift)
                if size in held:
                    found = batch.take(pa.array(np.flatnonzero((n == size) & (kind == 1))))
                    if found.num_rows and finer is not None:
                        histogram(held[size], found.column("rid").to_numpy(), _vectors(found, size), finer)
                    elif found.num_rows:
                        hits(held[size], found.column("rid").to_numpy(), found.column("id").to_pylist(), _vectors(found, size))
        for lane in held.values():
            if not lane.held:
                continue
            if finer is None:
                q, s, v, null = lane.held[0]
                yield pa.RecordBatch.from_arrays([pa.array(lane.rid[q]), pa.array(s), pa.array(v, mask=null)], names=["rid", "score", "id"])
            else:
                pairs, counts = np.unique(np.stack(lane.held[0]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lane.rid[pairs[0]]), pa.array(lane.need[pairs[0]]), pa.array(pairs[1]), pa.array(counts.astype(np.int64))], names=["rid", "need", "bin", "n"])

    return dealt.mapInArrow(run, "rid long, score long, id long" if finer is None else "rid long, need long, bin long, n long")


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, int(size))


def nearest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", query: Column | None = None, k: int = 5, lane: int = LANE) -> DataFrame:
    """The k highest scores of each query: query_id, rank (from 1), vec_id, score.

    query: which rows ask (default: ids divisible by 50); a null answer is a no.
    """
    spark = vectors.sparkSession
    asks = F.col(vec_id).cast("long") % 50 == 0 if query is None else query
    asks = F.coalesce(asks, F.lit(False)) & F.col(vec_id).isNotNull()
    rows = written(quantised(vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("long").alias("id"), asks.alias("query"), F.col(vector).cast("array<double>").alias("v"))), "search-rows")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, most = rows.agg(F.count_if("query"), F.max(squares)).first()
    lanes = max(1, -(-n // lane))
    parts = max(1, wide_shuffle(spark) // lanes)
    bits = int(min(63, np.ceil(np.log2(max(1.0, most or 0.0) * 1.01 + 2))))  # the product of two norms is no more than the largest squared
    state = rows.where("query").select("rid", F.lit(0).cast("long").alias("known"), F.lit(k).cast("long").alias("need"))
    asked = rows.where("query").select("rid", "v")
    shift = None
    while shift is None or shift > 0:
        finer = max(0, (bits if shift is None else shift) - STEP)
        counted = scan(asked.join(state, "rid"), rows, lanes, parts, shift, finer).groupBy("rid", "need", "bin").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("rid").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1))
        # the lowest bin with fewer than `need` above it holds the kth score, or, where there are fewer scores, the last
        below = counted.withColumn("over", F.coalesce(before, F.lit(0))).where("over < need").groupBy("rid").agg(F.min(F.struct("bin", (F.col("need") - F.col("over")).alias("need"))).alias("kth"))
        state = written(below.select("rid", F.col("kth.bin").alias("known"), F.col("kth.need").alias("need")), "search-kth")
        shift = finer
    found = scan(asked.join(state, "rid"), rows, lanes, parts, 0, None)
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    names = rows.where("query").select("rid", F.col("id").alias("query_id"))
    return ranked.join(names, "rid").select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 5 best rows of the whole embeddings table."""
    return nearest(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid AS query, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id ASC NULLS LAST) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
