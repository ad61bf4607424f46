"""Packing (6): cutting-stock column generation.

A document's ids (its text's, then the end id) are cut at multiples of the
sequence length; what is left over at its end is the only short piece. Pieces
are grouped by length into classes of `CLASS_WIDTH` ids, each as long as its
longest member may be. The histogram over classes is a cutting-stock problem:
a linear program over patterns (how many pieces of each class fill a sequence),
whose columns a knapsack by dynamic programming prices, until no pattern would
lower the number of sequences by more than `GAP`. Pattern counts are rounded
down; the few pieces that rounding leaves (at most a pattern's pieces for each
class) are packed best-fit decreasing. Pieces are ranked within their class, and
a rank's pattern, sequence and place follow by arithmetic.

The driver sees one number for each class, whatever the input's size. Ranks are
counted in salted groups: of n pieces of a class, the square root of n groups of
as many pieces on average, so that neither the pieces of a group nor the groups
of a class are many, however many pieces are of one length.

A sequence whose pieces add up to a power of two needs no padding; all others are
padded to the full length. Null text counts as empty: its piece is the end id
alone. Rows that repeat an id are packed each on its own. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, texts, written

SEQUENCE = 2048
END_ID = 1
CLASS_WIDTH = 8
GAP = 1e-3
#: Weight of the best prices so far.
SMOOTH = 0.8
#: Runs between white space whose ids a worker keeps.
CACHE = 400_000

#: White space to str.split but not to the tokenizer.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 bytes for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def only_letters(word: str) -> bool:
    """Whether the tokenizer sees letters alone, which it encodes apart from a mark behind them: its normal form and lower case may part a letter (İ) into a letter and a combining mark, which joins the next mark."""
    return word.isalpha() and (word.isascii() or normalize("NFC", word).lower().isalpha())


class WordIds:
    """Ids of whole texts by a tokenizer that never joins what white space parts.

    Each run between white space is encoded once, many at a time, and then looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, fresh: list[str]) -> None:
        marked = [x for x in fresh if x[-1] in ",." and only_letters(x[:-1])]
        plain = set(fresh).difference(marked)
        plain.update(x[:-1] for x in marked if x[:-1] not in self.ids)
        # Latin-1 letters are one lower-case word to the tokenizer, which its model takes as it stands
        tokenize, hard = self.tokenizer.model.tokenize, []
        for x in plain:
            if x.isalpha() and (x.isascii() or max(x) < "\u0100"):
                low = x.lower()
                ids = self.ids.get(low)
                if ids is None:
                    letters = low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_LETTERS)
                    ids = array("I", [t.id for t in tokenize(letters)]).tobytes()
                self.ids[x] = ids
            else:
                hard.append(x)
        for at in range(0, len(hard), 4096):
            part = hard[at : at + 4096]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            begins = np.cumsum([0] + [len(x) + 1 for x in part])
            starts = np.array([a for a, _ in found.offsets], np.int64)
            cut = (4 * np.searchsorted(starts, begins)).tolist()
            for x, a, b in zip(part, cut, cut[1:]):
                self.ids[x] = ids[a:b]
        for mark in ",.":
            tail = self.encode(mark)
            for x in marked:
                if x[-1] == mark:
                    self.ids[x] = self.ids[x[:-1]] + tail

    def batch(self, batch_texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.ids) > CACHE:
            self.ids.clear()
        cut = [None if any(map(t.__contains__, SEPARATORS)) else t.split() for t in batch_texts]
        fresh = {x for ps in cut for x in ps or ()}.difference(self.ids)
        if fresh:
            self.learn(list(fresh))
        return [self.encode(t) if ps is None else b"".join(map(self.ids.__getitem__, ps)) for t, ps in zip(batch_texts, cut)]


@lru_cache(maxsize=2)
def _words(path: str) -> WordIds:
    return WordIds(path)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, size: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for whole in batches:
            for batch in slices(whole, 1):
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0).to_pylist(), words.batch(texts(batch.column(1)))):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc, a, min(size, n - a), zlib.crc32(ids[4 * a : 4 * (a + size)]), n) for a in range(0, n, size)]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows)], names=[x.split()[0] for x in PIECES.split(", ")])
        words.ids.clear()  # the worker lives on and serves other stages

    return run


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_pieces(path, size, end_id), PIECES)


def best_pattern(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of most value that fits: unbounded knapsack, items of sizes 1 .. len(values)."""
    n = len(values)
    best, took = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for w in range(1, room + 1):
        k = min(w, n)
        options = values[:k] + best[w - k : w][::-1]
        at = int(options.argmax())
        best[w], took[w] = (options[at], at + 1) if options[at] > best[w - 1] else (best[w - 1], 0)
    pattern, w = np.zeros(n, np.int64), room
    while w > 0:
        if took[w]:
            pattern[took[w] - 1] += 1
            w -= int(took[w])
        else:
            w -= 1
    return float(best[room]), pattern


def inverted(a: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan elimination in one thread; a library's threads would compete with the tasks of a busy machine."""
    n = len(a)
    both = np.hstack([a, np.eye(n)])
    for k in range(n):
        best = k + int(np.abs(both[k:, k]).argmax())
        both[[k, best]] = both[[best, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= np.outer(factor, both[k])
    return both[:, n:]


def column_generation(demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used (not whole numbers) to meet demand for sizes 1 .. len(demand)."""
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return np.zeros((0, len(demand)), np.int64), np.zeros(0)
    m = len(sizes)
    basis = np.diag(room // sizes).astype(float)  # columns are patterns over the sizes in use
    inverse = np.diag(1.0 / (room // sizes))
    use = inverse @ demand[sizes - 1]
    needed = demand[sizes - 1].astype(float)
    center, bound = None, 0.0
    for step in range(200 * m):
        prices = inverse.sum(axis=0)
        # prices are pulled towards the best seen, which keeps them from swinging; where that finds no column, they are used as they are
        for tried in ([SMOOTH * center + (1 - SMOOTH) * prices] if center is not None else []) + [prices]:
            values = np.zeros(len(demand))
            tried = np.maximum(tried, 0)
            values[sizes - 1] = tried
            worth, pattern = best_pattern(values, room)
            column = pattern[sizes - 1].astype(float)
            # tried / worth prices no pattern above 1, so no solution needs fewer sequences than it gives
            if (found := float(tried @ needed) / worth) > bound:
                bound, center = found, tried
            if prices @ column > 1 + 1e-9:
                break
        if use.sum() <= bound * (1 + gap) or prices @ column <= 1 + 1e-9:
            break
        move = np.einsum("ij,j->i", inverse, column)
        ok = move > 1e-9
        ratio = np.full(m, np.inf)
        ratio[ok] = use[ok] / move[ok]
        leave = int(ratio.argmin())
        basis[:, leave] = column
        pivot = inverse[leave] / move[leave]
        inverse -= np.outer(move, pivot)
        inverse[leave] = pivot
        use = np.maximum(use - ratio[leave] * move, 0)
        use[leave] = ratio[leave]
        if step % 200 == 199:
            inverse = inverted(basis)
            use = np.maximum(inverse @ needed, 0)
    out = np.zeros((m, len(demand)), np.int64)
    out[:, sizes - 1] = np.rint(basis.T).astype(np.int64)
    return out, use


def plan(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns over sizes 1 .. room and whole numbers of them that meet demand exactly."""
    demand = np.asarray(demand, np.int64)
    patterns, use = column_generation(demand, room)
    left, out = demand.copy(), []
    for pattern, times in sorted(zip(patterns, use), key=lambda x: -x[1]):
        whole = int(times + 1e-6)
        if whole:
            whole = min([whole, *(left[pattern > 0] // pattern[pattern > 0]).tolist()])
        if whole > 0:
            out.append((pattern, whole))
            left = left - whole * pattern
    bins: list[list[int]] = []
    rooms: list[int] = []
    for size in range(room, 0, -1):
        for _ in range(int(left[size - 1])):
            fits = [(r, k) for k, r in enumerate(rooms) if r >= size]
            if fits:
                k = min(fits)[1]
                bins[k].append(size)
                rooms[k] -= size
            else:
                bins.append([size])
                rooms.append(room - size)
    for held in bins:
        out.append((np.bincount(np.array(held) - 1, minlength=len(demand)), 1))
    return out


def slots(packed: list[tuple[np.ndarray, int]], n_classes: int) -> list[tuple[np.ndarray, ...]]:
    """For each class: where its ranks change pattern, that pattern's pieces of the class, its first sequence, and the place before them."""
    ranks = np.zeros(n_classes, np.int64)
    rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n_classes)]
    sequence = 0
    for pattern, times in packed:
        place = 0
        for c in np.flatnonzero(pattern)[::-1].tolist():
            each = int(pattern[c])
            rows[c].append((int(ranks[c]), each, sequence, place))
            ranks[c] += each * times
            place += each
        sequence += times
    return [tuple(np.array(r, np.int64).reshape(-1, 4).T) for r in rows]


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sequence, place = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for c in np.unique(kind).tolist():
                own = kind == c
                starts, each, first, before = found[c - 1]
                k = np.searchsorted(starts, rank[own], "right") - 1
                nth = rank[own] - starts[k]
                sequence[own], place[own] = first[k] + nth // each[k], before[k] + nth % each[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sequence), pa.array(place)], names=[*PACKED_FROM, "sequence_id", "place"])

    return run


PACKED_FROM = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def pack(found: DataFrame, size: int = SEQUENCE, width: int = CLASS_WIDTH) -> DataFrame:
    """pieces (a table: it is read several times) with sequence_id and offset."""
    spark = found.sparkSession
    room = size // width
    classed = found.withColumn("kind", F.ceil(F.col("length") / width).cast("int"))
    counts = np.zeros(room, np.int64)
    for r in classed.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a class
        counts[r["kind"] - 1] = r["n"]
    shared = spark.sparkContext.broadcast(slots(plan(counts, room), room))
    groups = F.element_at(F.array(*[F.lit(math.isqrt(int(n)) + 1) for n in counts]), F.col("kind"))
    salted = classed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), groups).cast("int"))
    # one row for each class and group of ranks
    sums = salted.groupBy("kind", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("kind").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).select("kind", "salt", "before")
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "salt").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")) - 1)
    placed = ranked.join(before, ["kind", "salt"]).select("kind", (F.col("before") + F.col("nth")).cast("long").alias("rank"), *PACKED_FROM)
    put = placed.mapInArrow(_assign(shared), PIECES + ", sequence_id long, place long")
    in_sequence = Window.partitionBy("sequence_id").orderBy("place")
    offset = F.sum("length").over(in_sequence.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    return put.withColumn("offset", offset).select(*PACKED_FROM, "sequence_id", "offset")


def packed_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(written(pieces(docs, path, doc_id=doc_id, text=text), "pieces"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), vocabulary())
