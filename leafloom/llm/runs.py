"""Periodic run detection (12): Main-Lorentz divide and conquer on interned word ids.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and a length of at least max(24, 3 * q) words that no neighbouring word
extends with period q. A text is halved again and again; at each midpoint
Z-functions say, for every period, how far the words match to the right and to the
left, which gives the repetitions that cross it. A repetition that goes on beyond
its part is left to the part above, whose midpoint it crosses; of equal intervals
the smallest period stays.

Midpoints that no run can cross are passed over: within a run every 8 words come
again within a third of the run's length, so where the nearest equal 8 words are
further away than a third of the part (equality by hash, which lets through at
least the equal ones) there is none. Runs themselves are decided on interned ids.

Defined cases. A null text has no words; a text of fewer than 24 words has no run.
Rows that repeat an id are rows of their own; a null id has no checksum, so its
text isn't rebuilt. Texts of any length are taken whole, one at a time in memory
where they are longer than a pass. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC32_SQL, buffer, slices, table
from .words import Words, words, xxh64

#: A run has at least so many words and so many periods.
LEAST, TIMES = 24, 3
#: Words of the stretches whose nearest equal is looked up: the largest size of which every run has one at a distance of its period.
GRAM = 8

FAR = np.iinfo(np.int64).max

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def z_function(s: np.ndarray) -> np.ndarray:
    """z[i]: how many symbols from i on equal those from 0 on; z[0] is the length."""
    n = len(s)
    z = np.zeros(n, np.int64)
    if not n:
        return z
    z[0] = n
    left = right = 0
    for i in (np.flatnonzero(s[1:] == s[0]) + 1).tolist():  # elsewhere z is 0
        k = min(right - i, int(z[i - left])) if i < right else 0
        if i + k >= right:
            k = max(k, 0)
            block = 16
            while i + k < n:
                size = min(block, n - i - k)
                apart = np.flatnonzero(s[k : k + size] != s[i + k : i + k + size])
                if len(apart):
                    k += int(apart[0])
                    break
                k += size
                block *= 2
            left, right = i, i + k
        z[i] = k
    return z


def crossing(x: np.ndarray, l: int, m: int, r: int) -> list[tuple[int, int, int]]:  # noqa: E741
    """(start, end, period) of repetitions of x[l:r] over m, of LEAST words and TIMES periods at least."""
    u, v = x[l:m], x[m:r]
    gap = np.array([-1], x.dtype)
    ahead = z_function(np.concatenate([v, gap, u, v]))  # matches with what follows m
    back = z_function(np.concatenate([u[::-1], gap, v[::-1], u[::-1]]))  # matches with what ends before m
    most = (r - l) // TIMES
    found = []
    # the pair (m, m + p): forwards from both, backwards from the words before both
    p = np.arange(1, min(len(v) - 1, most) + 1)
    to, by = ahead[p], back[len(u) + 1 + len(v) - p]
    found.append((m - by, m + p + to, p))
    # the pair (m - p, m)
    p = np.arange(1, min(len(u), most) + 1)
    to, by = ahead[len(v) + 1 + len(u) - p], np.append(back, 0)[np.where(p < len(u), p, len(back))]
    found.append((m - p - by, m + to, p))
    start, end, p = (np.concatenate([f[k] for f in found]) for k in range(3))
    long = end - start >= np.maximum(LEAST, TIMES * p)
    return list(zip(start[long].tolist(), end[long].tolist(), p[long].tolist()))


def runs_of(x: np.ndarray, near: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the word ids x, by start, then period. near: at each word, the distance to the nearest equal GRAM words of those that hold it or the word before, or less."""
    least: dict[tuple[int, int], int] = {}
    parts = [(0, len(x))]
    while parts:
        l, r = parts.pop()  # noqa: E741
        if r - l < LEAST:
            continue
        m = (l + r) // 2
        parts += [(l, m), (m, r)]
        if near is not None and near[m] > (r - l) // TIMES:
            continue
        for start, end, p in crossing(x, l, m, r):
            if (start == l and l and x[l - 1] == x[l - 1 + p]) or (end == r and r < len(x) and x[r] == x[r - p]):
                continue
            least[start, end] = min(p, least.get((start, end), p))
    return sorted((start, end - start, p) for (start, end), p in least.items())


def nearest_equal(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For runs_of, of the word hashes of a whole batch; first: where documents begin, and the end."""
    n = len(h)
    out = np.full(n + 1, FAR, np.int64)
    if n < GRAM:
        return out
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    with np.errstate(over="ignore"):
        g, size = h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
        while size < GRAM:
            g = g[:-size] * np.uint64(0xBF58476D1CE4E5B9) ^ (g[size:] + (g[size:] >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            size *= 2
    whole = np.flatnonzero(doc[: len(g)] == doc[GRAM - 1 :])
    at = whole[np.argsort(g[whole], kind="stable")]
    same = (g[at[1:]] == g[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])
    apart = np.where(same, at[1:] - at[:-1], FAR)
    own = np.full(n, FAR, np.int64)
    own[at[:-1]] = apart
    own[at[1:]] = np.minimum(own[at[1:]], apart)
    out[:n] = own
    for k in range(1, GRAM + 1):
        out[k:n] = np.minimum(out[k:n], own[: n - k])
    return out


def rebuilt(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place, in a tenth of the documents a repeated one; None: each its own."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    k = np.arange(n)
    return np.where(k >= a, a + (k - a) % p, k)


def described(found: list[tuple[int, int, int]]) -> tuple:
    """n_runs, the run of the greatest exponent, and the digest of all."""
    digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
    if not found:
        return 0, None, None, None, None, digest
    s, n, p = min(found, key=lambda f: (-Fraction(f[1], f[2]), f[0], f[2]))
    return len(found), s, n, p, 1000 * n // p, digest


def collapsed(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """The words that stay: all but those that any run contains after its first period."""
    gone = np.zeros(n + 1, np.int64)
    for s, size, p in found:
        gone[s + p] += 1
        gone[s + size] -= 1
    return np.flatnonzero(np.cumsum(gone)[:n] == 0)


def _interned(w: Words, at: np.ndarray) -> np.ndarray:
    """Numbers for the words at these places, equal for equal words."""
    raw = w.data.tobytes()
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(w.start[at].tolist(), w.end[at].tolist())], np.int64)


def batch_runs(ids: list[int | None], data: np.ndarray, offsets: np.ndarray, rebuild) -> list[tuple]:
    w = words(data, offsets)
    n_words = len(w.start)
    place = np.arange(n_words)
    changed = {}
    for d, i in enumerate(ids):
        a, b = int(w.first[d]), int(w.first[d + 1])
        to = rebuild(i, b - a)
        if to is not None:
            place[a:b] = a + to
            changed[d] = True
    near = nearest_equal(xxh64(w.data, w.start, w.end)[place], w.first)
    out = []
    for d, i in enumerate(ids):
        a, b = int(w.first[d]), int(w.first[d + 1])
        close = near[a : b + 1]
        found = runs_of(_interned(w, place[a:b]), close) if b - a >= LEAST and close[: b - a].min() < (b - a) else []
        if found or d in changed:
            at = place[a:b][collapsed(b - a, found)]
            text = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[at].tolist(), w.end[at].tolist()))
        else:
            text = w.data[w.start[a] : w.end[b - 1]].tobytes() if b > a else b""
        out.append((i, *described(found), hashlib.sha256(text).hexdigest()))
    return out


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rebuild=None) -> DataFrame:
    """Per document its runs and the digest of its text without their repeats. rebuild: from id and number of words, which word stands at each place; None for the text as it is."""
    rebuild = rebuild or (lambda i, n: None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        for whole in batches:
            for batch in slices(whole, 1):
                found = batch_runs(batch.column(0).to_pylist(), *buffer(batch.column(1)), rebuild)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*found), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of documents, a tenth of them rebuilt by their ids' checksums."""
    return periodic_runs(table(spark, sf_dir, "documents"), rebuild=rebuilt)


OP12_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, {CRC32_SQL.format("CAST(doc_id AS VARCHAR)")} AS h
  FROM documents
), s AS (
  SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM t
), d AS (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE w END AS w
  FROM s
), x AS (
  SELECT rid, n, unnest(w) AS word, unnest(range(n)) AS i FROM d
), m AS (
  SELECT a.rid, a.n, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.rid = b.rid AND a.word = b.word AND b.i > a.i AND 3 * (b.i - a.i) <= a.n
), k AS (
  SELECT rid, n, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m
), e AS (
  SELECT rid, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY rid, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), r AS (
  SELECT rid, start, length, min(q) AS period FROM e GROUP BY rid, start, length
), best AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY rid
), top AS (
  SELECT rid, start, length, period FROM r
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY (length * 1000000 * 1000000) // period DESC, start, period) = 1
), gone AS (
  SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (rid) LEFT JOIN top USING (rid) LEFT JOIN kept USING (rid)
"""
