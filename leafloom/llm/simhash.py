"""SimHash near-dedup (8): BK-trees over shards of fingerprints.

Text is lower-cased (A-Z only) and cut into words `[^\\x20\\x09-\\x0D]+`; a
shingle is three words joined by one space, repeats count, fewer words are one
shingle. Bit b of a fingerprint is 1 if it is set in over half of the shingles'
XXH64 hashes (seed 42). No words (and null text): fingerprint zero. Fingerprints
link at `radius` or fewer differing bits; a component is what links reach, named
by its smallest doc_id.

Fingerprints are cut into radius + m blocks of bits. Two that differ in at most
`radius` bits agree on at least m blocks, so each fingerprint is filed once under
each choice of m blocks, and every link lies within one shard. m follows from the
number of fingerprints, so that shards stay small at any size; every m finds
all links. A shard is a BK-tree: children are keyed by their integer Hamming
distance to the parent, and a search follows only edges within the radius.

A shard's tree goes to the task that holds the shard's fingerprints and to no
other: to send every tree to all tasks would compare all with all. Equal
fingerprints are one node, so a group of copies, of any size, costs one. A task
returns spanning edges, at most one for each fingerprint it was given, and the
components are joined by rounds of min-label hooking over those edges, which
stay distributed.

Rows that repeat an id are nodes of their own; a null id never names a component
unless nothing else does. An empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import combinations, islice
from math import acos, ceil, comb, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PASS_BYTES, buffer, discard, slices, table, wide_shuffle, written
from .words import words, xxh64

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Mean fingerprints that a shard may have before m grows.
SHARD_MEAN = 4096

# for each byte: its eight bits, one in each byte of a word; sums of up to 255 stay in their lanes
SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a batch, and how many each document has."""
    n = len(offsets) - 1
    w = words(data, offsets, lower=True)
    count = w.count
    shingles = np.where(count >= shingle, count - shingle + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(shingles)])
    doc = np.repeat(np.arange(n), shingles)
    at = np.arange(first[-1]) - first[doc] + w.first[doc]
    last = np.minimum(at + shingle - 1, w.first[doc + 1] - 1)
    return xxh64(w.data, w.start[at], w.end[last], seed), shingles


def majority(h: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """A fingerprint for each document: bits set in over half of its hashes."""
    n = len(shingles)
    out = np.zeros(n, np.uint64)
    if not len(h):
        return out
    first = np.concatenate([[0], np.cumsum(shingles)])
    # sums over runs of at most 255 shingles of one document, eight lanes at a time
    runs = (shingles + 254) // 255
    run_doc = np.repeat(np.arange(n), runs)
    run_at = first[run_doc] + 255 * (np.arange(len(run_doc)) - np.concatenate([[0], np.cumsum(runs)])[run_doc])
    full = np.flatnonzero(shingles)
    heads = np.searchsorted(run_doc, full)
    bits = np.zeros((len(full), 64), np.int64)
    by_byte = h.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(SPREAD[by_byte[:, k]], run_at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits[:, 8 * k : 8 * k + 8] = np.add.reduceat(lanes, heads, axis=0)
    set_bits = bits * 2 > shingles[full][:, None]
    out[full] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """A fingerprint for each document of a batch."""
    return majority(*shingle_hashes(data, offsets, shingle, seed))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            fp = fingerprints(*buffer(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id long, fp long (the fingerprint's 64 bits)."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


class BKTree:
    """Items by the Hamming distance of their fingerprints; a node is [value, {distance: child}, member, items].

    An item is the fingerprint itself, or what has it (then several may have the
    same). `member` is some item of the node's subtree while all of them are known
    to be of one component, else None. A search for an item passes over subtrees
    that are of its own component already, so a large group of near copies is not
    compared pair by pair.
    """

    def __init__(self, find):
        self.root: list | None = None
        self.find = find

    def add(self, value: int, item: int | None = None) -> None:
        """To be called when the item's links to what is in the tree have been joined."""
        item = value if item is None else item
        if self.root is None:
            self.root = [value, {}, item, [item]]
            return
        node, own = self.root, self.find(item)
        while True:
            if node[2] is not None and self.find(node[2]) != own:
                node[2] = None
            d = (node[0] ^ value).bit_count()
            if d == 0:
                node[3].append(item)
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}, item, [item]]
                return
            node = child

    def within(self, value: int, radius: int, item: int | None = None) -> Iterator[int]:
        """Items within the radius that are not of the item's component yet; the caller may join them on the way."""
        item = value if item is None else item
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[2] is not None and self.find(node[2]) == self.find(item):
                continue
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                for x in node[3]:
                    if self.find(x) != self.find(item):
                        yield x
            if len(node[1]) <= 2 * radius:
                todo += [child for k, child in node[1].items() if -radius <= k - d <= radius]
            else:
                todo += [node[1][k] for k in range(d - radius, d + radius + 1) if k in node[1]]


class Components:
    """Union-find."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> None:
        self.parent[self.find(a)] = self.find(b)


def shard_edges(fps: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning edges of the links among the fingerprints of one shard (unsigned, distinct)."""
    if len(fps) < 2:
        return []
    parts = Components()
    edges, tree = [], BKTree(parts.find)
    for x in fps:
        for y in tree.within(x, radius):
            parts.join(x, y)
            edges.append((x, y))
        tree.add(x)
    return edges


def block_choices(n: int, radius: int = RADIUS, mean: int = SHARD_MEAN) -> list[int]:
    """Masks of the bits that a shard's fingerprints share, one for each choice of m of radius + m blocks."""
    m = 1
    while m < 6 and n / 2 ** (64 * m / (radius + m)) > mean:
        m += 1
    cuts = [round(64 * k / (radius + m)) for k in range(radius + m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, m)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def by_shard(edges_of, names: list[str]):
    """Runs edges_of on each shard's rows (columns after the two of its key). Rows come sorted by shard; only the open one is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def ready():
            a = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            nth, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((np.diff(nth) != 0) | (np.diff(part) != 0)) + 1, [len(part)]]).tolist()
            for a, b in zip(starts, starts[1:]):
                if (nth[a], part[a]) != key:
                    if sum(x.num_rows for x in held) > 1:
                        out += edges_of(held)
                    key, held = (nth[a], part[a]), []
                held.append(batch.slice(a, b - a))
            if len(out) > 50_000:
                yield ready()
                out = []
        if sum(x.num_rows for x in held) > 1:
            out += edges_of(held)
        yield ready()

    return run


def _signed_edges(radius: int):
    def edges_of(held: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        fps = np.unique(np.concatenate([x.column(2).to_numpy() for x in held]).view(np.uint64)).tolist()
        return [(_signed(a), _signed(b)) for a, b in shard_edges(fps, radius)]

    return edges_of


def links(nodes: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that span every component."""
    masks = [_signed(m) for m in block_choices(n, radius)]
    filed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("nth", "part")).select("nth", "part", "fp")
    dealt = filed.repartition(wide_shuffle(nodes.sparkSession), "nth", "part").sortWithinPartitions("nth", "part")
    return dealt.mapInArrow(by_shard(_signed_edges(radius), ["a", "b"]), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of the edges (a, b).

    Each round hooks every node to the least label among its neighbours' labels
    and then follows that label's own label, which halves the depth of the
    forest. Rounds are written to the shared folder, the one before is removed.
    Joins on a hub's or a root's id read plain tables on both sides, so that
    Spark can split a key that many rows have.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = written(labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("to")), "cc-hooked")
        # a root follows the least label offered to any of its members
        offers = written(hooked.groupBy("label").agg(F.min("to").alias("offer")).where("offer < label").select("label", "offer"), "cc-offers")
        moved = written(hooked.join(offers, hooked.node == offers.label, "left").select("node", hooked.label, F.least("to", F.coalesce("offer", "to")).alias("to")), "cc-moved")
        up = moved.select(F.col("node").alias("to"), F.col("to").alias("root"))
        after = written(moved.join(up, "to").select("node", F.col("root").alias("label"), (F.col("root") != F.col("label")).alias("changed")), "cc-labels")
        for old in (labels, hooked, offers, moved):
            discard(old)
        labels = after
        if after.where("changed").isEmpty():
            discard(both)
            return labels.select("node", "label")


def near_components(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    fps = written(with_fingerprints(docs, doc_id, text), "simhash")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    joined = components(links(nodes, nodes.count(), radius))
    named = joined.join(nodes, joined.node == nodes.fp).groupBy("label").agg(F.min("rep").alias("component_id"))
    of = written(joined.join(named, "label").select(F.col("node").alias("fp"), "component_id"), "simhash-components")
    owners = nodes.join(of, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return fps.join(owners, "fp").select("doc_id", "fp", "component_id")


# --- components by similarity of five-word shingles

SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: Words of 64 bits in a fingerprint of distinct five-word shingles, each a SimHash under its own mixing.
WIDE = 4
#: Odds at which the fingerprints of two documents of the similarity may lie beyond the trees' radius.
LOST = 1e-9
#: Least shingle hashes, each under its own mixing; two documents of the similarity share none with odds of 0.2^8.
BANDS = 8
#: Bins of the sketch that sorts out the pairs far from the threshold (standard error 0.025 there).
BINS = 256
#: Standard errors from the threshold within which the sketch does not decide: those pairs are compared shingle by shingle.
SKETCH_ERRORS = 6
#: Documents that one numpy pass compares with another one, and bytes of a shard's shingles held in memory (more go to a file).
PASS_ROWS, PASS_HELD = 8192, 32 << 20
MIX = [int(x) for x in np.random.default_rng(11).integers(1, 2**63, BANDS) * 2 + 1]
WIDE_MIX = [int(x) for x in np.random.default_rng(12).integers(1, 2**63, WIDE - 1) * 2 + 1]


def flip_odds(similarity: float, most: int = 60) -> float:
    """The greatest odds at which a fingerprint bit differs between two sets of that similarity or more.

    Worked out for every way of sharing up to `most` hashes of random bits; larger
    sets come near acos(2s / (1 + s)) / pi from their side.
    """

    def above(n: int, held: np.ndarray, total: int) -> np.ndarray:
        # odds that `held` bits and those of n more hashes are over half of `total`
        tail = np.concatenate([np.cumsum([comb(n, k) / 2**n for k in range(n, -1, -1)])[::-1], [0.0]])
        return tail[np.clip(total // 2 + 1 - held, 0, n + 1)]

    worst = acos(2 * similarity / (1 + similarity)) / pi
    for union in range(1, most + 1):
        for common in range(max(1, ceil(union * similarity - 1e-9)), union + 1):
            held = np.arange(common + 1)
            odds = np.array([comb(common, k) / 2**common for k in range(common + 1)])
            for one in range(union - common + 1):
                a, b = above(one, held, common + one), above(union - common - one, held, union - one)
                worst = max(worst, float((odds * (a * (1 - b) + b * (1 - a))).sum()))
    return worst


def wide_radius(similarity: float = SIMILARITY, lost: float = LOST) -> int:
    """Bits of a wide fingerprint beyond which two sets of that similarity lie with odds of at most `lost`."""
    bits, p = 64 * WIDE, flip_odds(similarity)
    left, radius = 0.0, bits
    while radius and left + comb(bits, radius) * p**radius * (1 - p) ** (bits - radius) <= lost:
        left += comb(bits, radius) * p**radius * (1 - p) ** (bits - radius)
        radius -= 1
    return radius


def distinct(h: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes in ascending order, and how many they are."""
    doc = np.repeat(np.arange(len(shingles)), shingles)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], np.bincount(doc[fresh], minlength=len(shingles))


def mixed(h: np.ndarray, m: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h * np.uint64(m % 2**64)
    return h ^ (h >> np.uint64(32))


def sketches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each document: fingerprint of its distinct shingles (WIDE words), BANDS least hashes, BINS one-byte bins (0: empty), number of distinct shingles, and two sums that name their set."""
    h, shingles = shingle_hashes(data, offsets, SIMILAR_SHINGLE, SEED)
    h, sizes = distinct(h, shingles)
    fp = np.stack([majority(x, sizes) for x in (h, *(mixed(h, m) for m in WIDE_MIX))], axis=1)
    n, full = len(sizes), np.flatnonzero(sizes)
    bands, sums = np.full((n, BANDS), -1, np.int64), np.zeros((n, 2), np.int64)
    least = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    if len(h):
        heads = np.concatenate([[0], np.cumsum(sizes)])[full]
        for k, m in enumerate(MIX):
            bands[full, k] = np.minimum.reduceat(mixed(h, m), heads).view(np.int64)
        sums[full, 0] = np.add.reduceat(h, heads).view(np.int64)
        sums[full, 1] = np.add.reduceat(mixed(h, MIX[0]), heads).view(np.int64)
        np.minimum.at(least, np.repeat(np.arange(n), sizes) * BINS + (h >> np.uint64(56)).astype(np.int64), h)
    bins = np.where(least == np.iinfo(np.uint64).max, 0, least % np.uint64(255) + np.uint64(1)).astype(np.uint8).reshape(n, BINS)
    return fp, bands, bins, sizes, sums


SKETCH = "doc_id long, fp binary, bands array<long>, bins binary, size long, sum_a long, sum_b long"


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            fp, bands, bins, sizes, sums = sketches(*buffer(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            columns = [batch.column(0), pa.array([x.tobytes() for x in fp], pa.binary()), lists, pa.array([x.tobytes() for x in bins], pa.binary()), pa.array(sizes.astype(np.int64)), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "bands", "bins", "size", "sum_a", "sum_b"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sum_a, hashes): each document's distinct shingle hashes, ascending."""
    for whole in batches:
        for batch in slices(whole, 1, PASS_BYTES // 8):
            h, sizes = distinct(*shingle_hashes(*buffer(batch.column(1)), SIMILAR_SHINGLE, SEED))
            sets = np.split(h, np.cumsum(sizes)[:-1])
            sums = np.array([int(x.sum()) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "sum_a", "hashes"])


def verdicts(bins: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """What sketches and sizes say of document i and each of the others: 1 alike, -1 not alike, 0 too near the threshold to say."""
    own = np.flatnonzero(bins[i])
    theirs = bins[others]
    either = np.count_nonzero(theirs, axis=1) + len(own) - np.count_nonzero(theirs[:, own], axis=1)
    share = (np.count_nonzero(theirs[:, own] == bins[i, own], axis=1) / either - 1 / 255) / (1 - 1 / 255)
    error = SKETCH_ERRORS * np.sqrt(similarity * (1 - similarity) / either)
    far = (share < similarity - error) | (np.minimum(sizes[others], sizes[i]) / np.maximum(sizes[others], sizes[i]) < similarity)
    return np.where(far, -1, np.where(share >= similarity + error, 1, 0))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (ascending) are that similar."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both) >= similarity


def compared(fps: list[int], bins: np.ndarray, sizes: np.ndarray, similarity: float, radius: int, doubt, at_once: bool = False) -> list[tuple[int, int]]:
    """Spanning edges (positions) of what is alike in one shard.

    Row after row is searched for in BK-trees of the earlier rows' fingerprints,
    one tree for each class of sizes that similar sets may have. What a tree
    yields is judged by sketches in runs of 1, 2, 4 and so on: once a row is
    joined to a group, the search passes over the rest of it. doubt(i, others,
    parts, join) gets the rows that sketches leave open, after each run or, if not
    at_once, when row i's search is over.
    """
    parts, edges, trees = Components(), [], {}
    step = max(log(1 / similarity), 0.01)

    def join(i: int, j: int) -> None:
        if parts.find(i) != parts.find(j):
            parts.join(i, j)
            edges.append((i, j))

    for i, (fp, size) in enumerate(zip(fps, np.maximum(sizes, 1).tolist())):
        left = []
        for k in range(int(log(max(1, size * similarity * (1 - 1e-9))) / step), int(log(size / similarity * (1 + 1e-9)) / step) + 1):
            if k not in trees:
                continue
            found, most = trees[k].within(fp, radius, i), 1
            while some := list(islice(found, most)):
                some, most = np.array(some), min(2 * most, PASS_ROWS)
                says = verdicts(bins, sizes, i, some, similarity)
                for j in some[says == 1].tolist():
                    join(i, j)
                if at_once:
                    doubt(i, some[says == 0].tolist(), parts, join)
                else:
                    left += some[says == 0].tolist()
        left = [j for j in left if parts.find(j) != parts.find(i)]
        if left:
            doubt(i, left, parts, join)
        k = int(log(size) / step)
        if k not in trees:
            trees[k] = BKTree(parts.find)
        trees[k].add(fp, i)
    return edges


def shards(batches: Iterator[pa.RecordBatch], sets: bool = False) -> Iterator[tuple[tuple[int, int], pa.Table, tuple | None]]:
    """(key, rows, sets) of each shard of two rows or more. Rows come sorted by shard; only the open one is held, the last column's sets in a file if they are large."""
    key, held, file, ends = None, [], None, []

    def ready():
        if sum(x.num_rows for x in held) > 1:
            yield key, pa.Table.from_batches(held), (file, np.concatenate([[0], np.cumsum(np.concatenate(ends))])) if sets else None

    for batch in batches:
        if not batch.num_rows:
            continue
        nth, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero((np.diff(nth) != 0) | (np.diff(part) != 0)) + 1, [len(part)]]).tolist()
        for a, b in zip(starts, starts[1:]):
            if (nth[a], part[a]) != key:
                yield from ready()
                if file:
                    file.close()
                key, held, file, ends = (nth[a], part[a]), [], tempfile.SpooledTemporaryFile(PASS_HELD) if sets else None, []
            rows = batch.slice(a, b - a)
            if sets:
                data, offsets = buffer(rows.column(rows.num_columns - 1))
                file.write(data.tobytes())
                ends.append(np.diff(offsets))
                rows = rows.select(list(range(rows.num_columns - 1)))
            held.append(rows)
    yield from ready()


def _bins(rows: pa.Table) -> np.ndarray:
    return buffer(rows.column("bins"))[0].reshape(-1, BINS)


def _wide(rows: pa.Table) -> list[int]:
    return [int.from_bytes(x, "little") for x in rows.column("fp").to_pylist()]


FOUND = "a long, b long, nth int, part long, sum_a long, size long, fp binary, bins binary"


def _sketched(radius: int, similarity: float):
    """Edges (a, b) that sketches are sure of; and, with b null, the shard's rows a that are of a pair left open and not also together in an earlier shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (nth, part), rows, _ in shards(batches):
            rep, sums, sizes = (rows.column(c).to_numpy() for c in ("rep", "sum_a", "size"))
            bins, bands = _bins(rows), rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)[:, :nth]
            unsure = np.zeros(len(rep), bool)

            def doubt(i, others, parts, join):
                others = np.array(others)
                new = others[~(bands[others] == bands[i]).any(axis=1)]
                unsure[new] = True
                unsure[i] |= len(new) > 0

            edges = np.array(compared(_wide(rows), bins, sizes, similarity, radius, doubt), np.int64).reshape(-1, 2)
            n, kept = len(edges), np.flatnonzero(unsure)
            a, none = np.concatenate([rep[edges[:, 0]], rep[kept]]), [None] * n
            rest = [pa.array(none + [x] * len(kept), t) for x, t in ((int(nth), pa.int32()), (int(part), pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(rep[edges[:, 1]].tolist() + [None] * len(kept), pa.int64()), *rest, pa.array(none + sums[kept].tolist(), pa.int64()), pa.array(none + sizes[kept].tolist(), pa.int64()), pa.array(none + rows.column("fp").take(kept).to_pylist(), pa.binary()), pa.array(none + [x.tobytes() for x in bins[kept]], pa.binary())],
                names=["a", "b", "nth", "part", "sum_a", "size", "fp", "bins"],
            )

    return run


def _exact(radius: int, similarity: float):
    """Edges (a, b) among the rows that sketches left open: pairs near the threshold by their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, (file, at) in shards(batches, sets=True):
            rep, sizes = rows.column("a").to_numpy(), rows.column("size").to_numpy()

            def held(i):
                file.seek(int(at[i]))
                return np.frombuffer(file.read(int(at[i + 1] - at[i])), np.uint64)

            def doubt(i, others, parts, join):
                own = held(i)
                for j in others:
                    if parts.find(j) != parts.find(i) and alike(own, held(j), similarity):
                        join(i, j)

            edges = np.array(compared(_wide(rows), _bins(rows), sizes, similarity, radius, doubt, at_once=True), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rep[edges[:, 0]]), pa.array(rep[edges[:, 1]])], names=["a", "b"])

    return run


def similar_components(docs: DataFrame, similarity: float = SIMILARITY, radius: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) of the documents that belong to a component of two or more.

    Documents link if their five-word shingles are at least `similarity` alike.
    Their SimHash fingerprints (WIDE words over distinct shingles) are dealt to
    shards, one for each of BANDS least shingle hashes, and each shard's are
    searched by BK-trees. The radius is such that two documents of the similarity
    lie beyond it with odds of at most LOST; `radius` sets another one, in bits of
    every 64. Only what the trees find is checked: sketches decide far from the
    threshold; documents of a pair near it fetch their shingle hashes and are
    compared exactly. Documents without words are alike. Rows that repeat an id
    are one node, rows without an id none.
    """
    reach = wide_radius(similarity) if radius is None else int(radius * WIDE)
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = ["size", "sum_a", "sum_b"]
    found = written(rows.mapInArrow(_sketch_batches, SKETCH), "sketches")
    nodes = written(found.groupBy(*named).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("bins").alias("bins")), "sketch-sets")
    filed = nodes.select(F.posexplode("bands").alias("nth", "part"), "rep", "fp", "sum_a", "size", "bands", "bins")
    dealt = filed.repartition(wide_shuffle(docs.sparkSession), "nth", "part").sortWithinPartitions("nth", "part")
    judged = written(dealt.mapInArrow(_sketched(reach, similarity), FOUND), "similar")
    sure, unsure = judged.where("b IS NOT NULL").select("a", "b"), judged.where("b IS NULL").drop("b")
    asked = unsure.select(F.col("a").alias("doc_id")).distinct()
    sets = rows.join(asked, "doc_id", "left_semi").mapInArrow(_set_batches, "doc_id long, sum_a long, hashes binary").dropDuplicates(["doc_id", "sum_a"])
    fetched = unsure.join(sets.withColumnsRenamed({"doc_id": "a"}), ["a", "sum_a"]).select("nth", "part", "a", "size", "fp", "bins", "hashes")
    near = fetched.repartition(wide_shuffle(docs.sparkSession), "nth", "part").sortWithinPartitions("nth", "part").mapInArrow(_exact(reach, similarity), "a long, b long")
    joined = components(sure.unionByName(near).distinct())
    # what all documents of one set of shingles share; alone of its set and not joined means no component
    several = nodes.join(joined, nodes.rep == joined.node, "left").where("rep < last OR label IS NOT NULL").select(*named, F.coalesce("label", "rep").alias("component_id"))
    return found.select("doc_id", *named).join(written(several, "similar-sets"), named).select("doc_id", "component_id").distinct()


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
