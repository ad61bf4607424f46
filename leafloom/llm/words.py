"""Words `[^\\x20\\x09-\\x0D]+` of whole text batches, and XXH64 of byte spans, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Spans beyond this go to the library one by one: a column of its own length each would be slow.
LONG_SPAN = 4096


@dataclass
class Words:
    """The words of a batch. `data` has each document's words joined by one space."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n + 1: document d has the words first[d] .. first[d + 1]

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    n = len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    if lower:
        data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << np.uint8(5))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~space
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    opens = word & (~before | edge[:n])
    # a word is followed by one separator in the compact buffer, even where its document just ends
    at = np.flatnonzero(opens)
    doc = np.searchsorted(offsets, at, "right") - 1
    kept = np.flatnonzero(word)
    nth = np.cumsum(opens)[kept]  # 1-based number of each kept byte's word
    place = np.arange(len(kept)) + nth - 1
    out = np.full(len(kept) + len(at), 32, np.uint8)
    out[place] = data[kept]
    heads = np.flatnonzero(opens[kept])
    start = place[heads]
    end = np.append(start[1:], len(out)) - 1
    first = np.searchsorted(doc, np.arange(len(offsets)), "left")
    return Words(out, start, end, first)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:end] for each span, those of one length together."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    four = np.ndarray((len(padded) - 3,), "<u4", padded, 0, (1,))
    length = end - start
    order = np.argsort(length.astype(np.uint16) if length.max() < 65536 else length, kind="stable")
    bounds = np.flatnonzero(np.diff(length[order])) + 1
    with np.errstate(over="ignore"):
        for group in np.split(order, bounds):
            size, at = int(length[group[0]]), start[group]
            if size > LONG_SPAN:
                raw = data.tobytes()
                out[group] = [xxhash.xxh64_intdigest(raw[a : a + size], seed) for a in at.tolist()]
            else:
                out[group] = _one_length(eight, four, padded, at, size, np.uint64(seed))
    return out


def _one_length(eight, four, data, at, size, seed):
    done = 0
    if size >= 32:
        a = [np.full(len(at), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        while done + 32 <= size:
            for k in range(4):
                a[k] = _round(a[k], eight[at + (done + 8 * k)])
            done += 32
        h = _rotl(a[0], 1) + _rotl(a[1], 7) + _rotl(a[2], 12) + _rotl(a[3], 18)
        for x in a:
            h = (h ^ _round(np.zeros_like(x), x)) * P1 + P4
    else:
        h = np.full(len(at), seed + P5, np.uint64)
    h = h + np.uint64(size)
    while done + 8 <= size:
        h = _rotl(h ^ _round(np.zeros_like(h), eight[at + done]), 27) * P1 + P4
        done += 8
    if done + 4 <= size:
        h = _rotl(h ^ (four[at + done].astype(np.uint64) * P1), 23) * P2 + P3
        done += 4
    while done < size:
        h = _rotl(h ^ (data[at + done].astype(np.uint64) * P5), 11) * P1
        done += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))
