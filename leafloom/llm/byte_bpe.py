"""Byte-level BPE encoding and decoding (3), on padded numpy matrices.

Text is cut by the vocabulary's pattern; each match is encoded on its own. A
match that is itself a token is that token. The others of a batch, each distinct
one once, are put into matrices by length, one token (a byte at first) a column.
Each round looks up the ranks of all neighbours in a hash table, merges in every
row the leftmost pair of least rank, closes the gaps, and drops the rows that
have nothing left to merge. Matches longer than `LONG` bytes would cost the
square of their length there; they go through a heap of pairs, which merges in
the same order.

The text between two single spaces is encoded independently of its neighbours,
so what a worker has seen before is looked up (`CACHE` entries, then forgotten).

Null text counts as empty and has no tokens. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, texts

#: Widths of the matrices; longer matches go to the heap.
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128)
LONG = WIDTHS[-1]
CACHE = 800_000
#: Bytes of text encoded in one go; what several texts share is then encoded once.
PASS_TEXT = 4 << 20
NONE = np.int32(2**31 - 1)
#: Rows of a matrix; small enough for a core's own cache.
ROWS = 2048

SPACE = r"\p{White_Space}"
BETWEEN = regex.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
EDGE = regex.compile(rf"^$|^{SPACE}|{SPACE}$")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        bits = max(4, (2 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + (~free | ~first)[~put].astype(np.int64)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where there is no such token or a side is padding (-1)."""
        out = np.full(left.shape, NONE, np.int32)
        ask = np.nonzero((left >= 0) & (right >= 0))
        keys = (left[ask].astype(np.int64) << 32) | right[ask]
        slot, found, open_ = self._slot(keys), np.full(len(keys), NONE, np.int32), np.arange(len(keys))
        while len(open_):
            at = self.keys[slot[open_]]
            hit = at == keys[open_]
            found[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
            slot[open_] = (slot[open_] + 1) & self.mask
        out[ask] = found
        return out

    def one(self, a: int, b: int) -> int | None:
        key = (a << 32) | b
        slot = int(self._slot(np.array([key], np.int64))[0])
        while (at := int(self.keys[slot])) != -1:
            if at == key:
                return int(self.values[slot])
            slot = (slot + 1) & self.mask
        return None


class BPE:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(len(self.tokens))]
        self.by_name = dict(zip(self.names, self.tokens))
        self.table = PairTable(self.ranks)
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.pattern = regex.compile(pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))

    def decode(self, ids) -> bytes:
        if min(ids, default=0) < 0:
            raise ValueError("a negative id")
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        groups: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = [whole]
            elif len(p) > LONG:
                out[k] = self._by_heap(p)
            else:
                groups.setdefault(next(w for w in WIDTHS if w >= len(p)), []).append(k)
        for width, members in groups.items():
            for at in range(0, len(members), ROWS):
                part = members[at : at + ROWS]
                for k, ids in zip(part, self._by_matrix([pieces[k] for k in part], width)):
                    out[k] = ids
        return out

    def _by_matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.table.find(ids[:, :-1], ids[:, 1:])
        ended: list[list[int]] = [[]] * len(pieces)
        alive, columns = np.arange(len(pieces)), np.arange(width)
        while len(alive):
            at = ranks.argmin(axis=1)
            row = np.arange(len(alive))
            best = ranks[row, at]
            going = best != NONE
            if not going.all():
                done = ~going
                for k, r, size in zip(alive[done].tolist(), ids[done].tolist(), (ids[done] >= 0).sum(axis=1).tolist()):
                    ended[k] = r[:size]
                alive, ids, ranks, at, best = alive[going], ids[going], ranks[going], at[going], best[going]
                row = np.arange(len(alive))
                if not len(alive):
                    break
            # close the gap behind each merge
            behind = columns[:-1] > at[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[row, at] = best
            behind = columns[:-2] > at[:, None]
            ranks[:, :-1] = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            right = np.minimum(at, width - 2)
            ranks[row, right] = self.table.find(ids[row, right], ids[row, right + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.table.find(ids[left, at[left] - 1], ids[left, at[left]])
        return ended

    def _by_heap(self, piece: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(self.table.find(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()) if r != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], live[j], after[i] = rank, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := self.table.one(rank, ids[after[j]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[j]]))
            if before[i] >= 0:
                h = before[i]
                if (r := self.table.one(ids[h], rank)) is not None:
                    heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x, alive in zip(ids, live) if alive]


class Encoder:
    """Encodes whole texts, remembering what stands between spaces."""

    def __init__(self, bpe: BPE):
        self.bpe = bpe
        self.pieces: dict[str, list[int]] = {}
        self.ids: dict[str, str] = {}  # decimal ids, joined by commas

    def parts(self, text: str) -> list[str]:
        """Runs that encode independently; all but the first have a space before them."""
        if not text:
            return []
        found = text.split(" ")
        if any(map(EDGE.search, {found[0], *found}.difference(self.ids))):
            return BETWEEN.split(text)
        return found

    def learn(self, fresh: set[str]) -> None:
        """fresh: runs that have a space before them."""
        letters = {x for x in fresh if x.isalpha()}
        marked = [x for x in fresh if x[-1] in ",." and x[:-1].isalpha()]  # letters are one match, what follows them another
        letters.update(x[:-1] for x in marked if x[:-1] not in self.ids)
        cut = {x: self.bpe.pattern.findall(f" {x}") for x in fresh.difference(letters, marked)}
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        new = list({p for ps in cut.values() for p in ps}.difference(self.pieces))
        plain = list(letters)
        found = self.bpe.encode_pieces([p.encode() for p in new] + [f" {x}".encode() for x in plain])
        self.pieces.update(zip(new, found))
        names = self.bpe.names.__getitem__
        for x, ids in zip(plain, found[len(new) :]):
            self.ids[x] = ",".join(map(names, ids))
        for x, ps in cut.items():
            ids = [i for p in ps for i in self.pieces[p]]
            self.ids[x] = ",".join(map(names, ids))
        for mark in ",.":
            [ids] = self.bpe.encode_pieces([mark.encode()])
            after = "," + ",".join(map(names, ids))
            for x in marked:
                if x[-1] == mark:
                    self.ids[x] = self.ids[x[:-1]] + after

    def alone(self, text: str) -> list[int]:
        return [i for ids in self.bpe.encode_pieces([p.encode() for p in self.bpe.pattern.findall(text)]) for i in ids]

    def batch(self, batch_texts: list[str]) -> list[tuple[int, str, bytes]]:
        """For each text: number of ids, the ids as decimal text, and what they decode to."""
        if len(self.ids) > CACHE:
            self.ids.clear()
        cut = [self.parts(t) for t in batch_texts]
        fresh = {x for ps in cut for x in ps[1:]}.difference(self.ids)
        if fresh:
            self.learn(fresh)
        out = []
        for ps in cut:
            if not ps:
                out.append((0, "", b""))
                continue
            head = self.alone(ps[0])
            joined = ",".join([*map(str, head), *map(self.ids.__getitem__, ps[1:])])
            ids = joined.split(",")
            out.append((len(ids), joined, b"".join(map(self.bpe.by_name.__getitem__, ids))))
        return out


@lru_cache(maxsize=2)
def _bpe(path: str, pattern: str) -> BPE:
    return BPE(path, pattern)


def _encode(path: str, pattern: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_bpe(path, pattern))
        for whole in batches:
            for batch in slices(whole, 1, PASS_TEXT):
                found = encoder.batch(texts(batch.column(1)))
                out = [batch.column(0), pa.array([n for n, _, _ in found], pa.int64())]
                if keep:
                    out += [pa.array([[int(i) for i in ids.split(",")] if ids else [] for _, ids, _ in found], pa.list_(pa.int32())), pa.array([raw for _, _, raw in found], pa.binary())]
                else:
                    out += [pa.array([hashlib.sha256(ids.encode()).hexdigest() for _, ids, _ in found]), pa.array([hashlib.sha256(raw).hexdigest() for _, _, raw in found])]
                yield pa.RecordBatch.from_arrays(out, names=["key", "n_tokens", "a", "b"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded (what the ids decode to, binary)."""
    out = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(_encode(path, pattern, True), "key long, n_tokens long, a array<int>, b binary")
    return out.toDF(doc_id, "n_tokens", "ids", "decoded")


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in batches:
            raw = [None if ids is None else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["key", "decoded"])

    return run


def decode(encoded: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, decoded (binary) of a column of ids, wherever they come from. Null stays null; an id that is no token is an error."""
    out = encoded.select(F.col(doc_id).cast("long").alias("key"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(_decode(path, pattern), "key long, decoded binary")
    return out.toDF(doc_id, "decoded")


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same, with SHA-256 digests in place of the ids and the decoded bytes."""
    out = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(_encode(path, pattern, False), "key long, n_tokens long, a string, b string")
    return out.toDF(doc_id, "n_tokens", "ids_sha256", "decoded_sha256")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
