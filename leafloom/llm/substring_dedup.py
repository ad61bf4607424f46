"""Substring dedup (7): suffix automata of reference shards, streamed for matching statistics.

Words are `[^\\x20\\x09-\\x0D]+`. A word is removed if a window of `WINDOW`
consecutive words covers it whose word sequence also starts in a document with a
smaller id. Windows are judged on the input.

Every window of a document holds `WINDOW - GRAM + 1` runs of `GRAM` words; the run
with the least hash is its seed, so equal windows have equal seeds. Seeds that
only one document has are dropped. Each other seed is a shard: the windows that
have it, as one stretch of text for each occurrence, come in order of ids; an
occurrence is streamed through the suffix automaton of the words before it, all
of smaller ids, and where the matching statistics reach the window's length the
words are covered; then its own words join the automaton. A surrounding that has
been seen word for word is covered whole without being streamed.

A shard's automaton goes to the task that holds the shard's occurrences and to
no other: sending all automata to all tasks would compare all with all. The task
holds the shard's distinct surroundings only, whatever their number of copies.

A run of `GRAM` words that a great many documents have would make a shard that
one task can't hold. Such runs are looked for in a sample of documents (it sets
how rows are dealt, never what is found; at most the mean number of seeds of a
document over `HOT_SHARE` can be that frequent, whatever the input's size).
Windows with such a seed are shards of their own, named by all their words: the
reference is the one window of the smallest id, taken by partial aggregation,
and the others are streamed through its automaton wherever they stand, equal ones
of a task together.

Null text has no words. Rows without an id are neither reference nor cut. Rows
that repeat an id are cut each on its own and are no reference for each other.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PASS_BYTES, buffer, slices, table, wide_shuffle, written
from .words import Words, words, xxh64

WINDOW = 13
GRAM = 6
#: A seed that this share of the sampled documents has, and HOT_LEAST of them, is dealt by its windows.
HOT_SHARE, HOT_LEAST = 0.02, 25
#: Documents of that sample, about.
HOT_SAMPLE = 5_000
#: References of windows (short texts) that are sent to every task; beyond, they are joined by shuffling.
FEW = 300_000


def _slide(a: np.ndarray, n: int, of) -> np.ndarray:
    """of (minimum or maximum) over a[i : i + n], for each i that has n values."""
    done, out = 1, a
    while done < n:
        step = min(done, n - done)
        out = of(out[: len(out) - step], out[step:])
        done += step
    return out


def mixed(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words on end, from the words' own hashes; never 0."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
            out ^= out >> np.uint64(29)
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.maximum(out, np.uint64(1))


def least_grams(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of grams; and by window (its first word), its document and its least gram, 0 where it would run into the next document."""
    h = xxh64(w.data, w.start, w.end)
    grams = mixed(h, gram)
    doc = np.searchsorted(w.first, np.arange(len(h)), "right") - 1
    least = _slide(grams, window - gram + 1, np.minimum)
    return h, grams, doc, np.where(doc[: len(least)] == doc[window - 1 : window - 1 + len(least)], least, np.uint64(0))


def is_hot(least: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """hot: ascending."""
    if not len(hot):
        return np.zeros(len(least), bool)
    return hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least


def seeds(w: Words, window: int = WINDOW, gram: int = GRAM, hot: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, ...]:
    """Of the seeds of a batch that are not hot: hashes, documents, and the first and last word + 1 of the windows that each is the seed of."""
    none = np.zeros(0, np.int64)
    if len(w.start) < window:
        return none, none, none, none
    reach = window - gram + 1
    _, grams, doc, least = least_grams(w, window, gram)
    least[is_hot(least, hot)] = 0
    wide = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)])
    chosen = np.flatnonzero(_slide(wide, reach, np.maximum) == grams)
    # wide[at + k] is the least of the window that begins reach - 1 - k words before the seed
    its = np.stack([wide[chosen + k] == grams[chosen] for k in range(reach)])
    first = chosen - (reach - 1) + its.argmax(axis=0)
    last = chosen - its[::-1].argmax(axis=0) + window
    return grams[chosen].view(np.int64), doc[chosen], first, last


def hot_windows(w: Words, hot: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Windows whose seed is hot: two hashes of all their words, documents, first and last word + 1."""
    none = np.zeros(0, np.int64)
    if len(w.start) < window or not len(hot):
        return none, none, none, none, none
    h, _, doc, least = least_grams(w, window, gram)
    first = np.flatnonzero(is_hot(least, hot))
    return mixed(h, window)[first].view(np.int64), mixed(h[::-1], window)[::-1][first].view(np.int64), doc[first], first, first + window


def _seed_rows(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                h, doc, _, _ = seeds(words(*buffer(batch.column(1))), hot=hot)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                fresh = np.ones(len(h), bool)  # a text that repeats itself has a seed once
                fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc = h[fresh], doc[fresh]
                yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(pa.array(doc))], names=["seed", "doc_id"])

    return run


def _stretches(w: Words, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The text from each first word to each last one."""
    a, b = w.start[first], w.end[last - 1]
    size = b - a
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + np.repeat(a, size)
    return pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(w.data[index].tobytes())]).cast(pa.binary())


HOT = "seed long, words binary, docs array<long>, rids array<long>, starts array<int>"


def _hot_rows(hot: np.ndarray):
    """Each distinct window of a pass whose seed is hot, with where it stands: documents, rows, places of its first word. The seed is the whole window's; windows are told apart by 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                w = words(*buffer(batch.column(1)))
                h, other, doc, first, last = hot_windows(w, hot)
                order = np.lexsort((first, other, h))
                h, other, doc, first, last = (x[order] for x in (h, other, doc, first, last))
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (other[1:] != other[:-1])
                heads, take = np.flatnonzero(fresh), pa.array(doc)
                ends = pa.array(np.append(heads, len(h)).astype(np.int32))
                places = [pa.ListArray.from_arrays(ends, x) for x in (batch.column(0).take(take), batch.column(2).take(take), pa.array((first - w.first[doc]).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([pa.array(h[heads]), _stretches(w, first[heads], last[heads]), *places], names=["seed", "words", "docs", "rids", "starts"])

    return run


def _surroundings(hot: np.ndarray):
    """(seed, doc_id, rid, start, words): what stands around each shared seed of a document, `start` its first word's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index(TEXT)):
                w = words(*buffer(batch.column(TEXT)))
                h, doc, first, last = seeds(w, hot=hot)
                shared = batch.column(SEEDS)
                values = shared.flatten().to_numpy(zero_copy_only=False)
                counts = np.diff(shared.offsets.to_numpy()) if len(shared) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(batch.num_rows), counts)
                # pairs (document, seed) as one number each: a collision only looks at a seed in vain
                key = lambda d, s: s ^ (d * np.int64(0x5851F42D4C957F2D))
                with np.errstate(over="ignore"):
                    own = np.isin(key(doc, h), key(owner.astype(np.int64), values.astype(np.int64)))
                h, doc, first, last = h[own], doc[own], first[own], last[own]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(ID).take(take), batch.column(ROW).take(take), pa.array((first - w.first[doc]).astype(np.int32)), _stretches(w, first, last)], names=["seed", "doc_id", "rid", "start", "words"])

    return run


class SuffixAutomaton:
    """Of several word sequences; states as parallel lists."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word)

    def _extend(self, last: int, word) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(word)
        if q is not None:
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, word, q)
        new = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def matching(self, sequence: list) -> list[int]:
        """For each word, the length of the longest run ending there that some added sequence has."""
        state, size, out = 0, 0, []
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                size += 1
            else:
                size = 0
            out.append(size)
        return out


def covered(statistics: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal spans of words that matches of at least the window's length cover."""
    spans: list[tuple[int, int]] = []
    for end, size in enumerate(statistics, 1):
        if size >= window:
            if spans and spans[-1][1] >= end - size:
                spans[-1] = (min(spans[-1][0], end - size), end)
            else:
                spans.append((end - size, end))
    return spans


class Shard:
    """One seed's surroundings, in order of ids."""

    def __init__(self):
        self.seen: set[bytes] = set()
        self.waiting: list[bytes] = []  # seen, but not in the automaton yet
        self.automaton: SuffixAutomaton | None = None
        self.doc, self.fresh = None, []

    def spans(self, doc: int, text: bytes, window: int = WINDOW) -> list[tuple[int, int]]:
        if doc != self.doc:  # what the last document had is now of a smaller id
            for x in self.fresh:
                if x not in self.seen:
                    self.seen.add(x)
                    self.waiting.append(x)
            self.doc, self.fresh = doc, []
        if text in self.seen:
            n = text.count(b" ") + 1
            return [(0, n)] if n >= window else []
        self.fresh.append(text)
        if not self.seen:
            return []
        if self.automaton is None:
            self.automaton = SuffixAutomaton()
        for x in self.waiting:
            self.automaton.add(x.split(b" "))
        self.waiting = []
        return covered(self.automaton.matching(text.split(b" ")), window)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by seed, then id; out come the covered words of each occurrence."""
    at, shard = None, Shard()
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for seed, doc, rid, start, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if seed != at:
                at, shard = seed, Shard()
            for a, b in shard.spans(doc, text):
                out.append((doc, rid, start + a, start + b))
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["doc_id", "rid", "a", "b"])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows have a window, where it stands, and the first window of that seed with its document; out come the covered words of later documents, runs of them as one."""
    at, automaton = None, SuffixAutomaton()
    for batch in batches:
        found: list[np.ndarray] = []
        docs, rids, starts, texts, references, los = (batch.column(k) for k in range(6))
        for k, (text, reference, lo) in enumerate(zip(texts.to_pylist(), references.to_pylist(), los.to_pylist())):
            if reference != at:
                at, automaton = reference, SuffixAutomaton()
                automaton.add(reference.split(b" "))
            doc, rid, start = (x[k].values.to_numpy() for x in (docs, rids, starts))
            later = doc > lo
            for a, b in covered(automaton.matching(text.split(b" "))) if later.any() else ():
                found.append(np.stack([doc[later], rid[later], start[later] + a, start[later] + b]))
        doc, rid, a, b = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        order = np.lexsort((b, a, rid, doc))
        doc, rid, a, b = doc[order], rid[order], a[order], b[order]
        fresh = np.ones(len(doc), bool)  # spans of one length, by their beginning: the last one ends last
        fresh[1:] = (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1]) | (a[1:] > b[:-1])
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:], len(doc))[: len(heads)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(doc[heads]), pa.array(rid[heads]), pa.array(a[heads].astype(np.int32)), pa.array(b[tails].astype(np.int32))], names=["doc_id", "rid", "a", "b"])


def _cut(text: str, names: list[str] | None):
    """names: the input's columns, to be given back with the text cut; None for digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index(TEXT)):
                w = words(*buffer(batch.column(TEXT)))
                rids, spans = batch.column(ROW).to_pylist(), batch.column(SPANS)
                gone = np.zeros(len(w.start) + 1, np.int64)
                for d, found in enumerate(spans.to_pylist()):
                    base = int(w.first[d])
                    for s in found or ():
                        if s["rid"] == rids[d]:
                            gone[base + s["a"]] += 1
                            gone[base + s["b"]] -= 1
                removed = np.cumsum(gone[:-1]) > 0
                cut = np.concatenate([[0], np.cumsum(removed)])
                n_removed = cut[w.first[1:]] - cut[w.first[:-1]]
                stays = ~np.repeat(removed, w.end - w.start + 1)  # each word with the space behind it
                kept, ends = w.data[stays], np.concatenate([[0], np.cumsum(stays)])
                places = np.append(w.start, len(w.data))
                out = []
                for d in range(batch.num_rows):
                    a, b = ends[places[w.first[d]]], ends[places[w.first[d + 1]]]
                    out.append(kept[a : b - 1].tobytes() if b > a else b"")
                counts = [pa.array(w.count.astype(np.int64)), pa.array(n_removed.astype(np.int64))]
                if names is None:
                    yield pa.RecordBatch.from_arrays([batch.column(ID), *counts, pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
                else:
                    new = pa.array([x.decode() if n else y for x, y, n in zip(out, batch.column(TEXT).to_pylist(), n_removed.tolist())], pa.string())
                    rest = iter(batch.column(REST).flatten()) if REST in batch.schema.names else iter(())
                    yield pa.RecordBatch.from_arrays([new if x == text else next(rest) for x in names] + counts, names=[*names, "n_words", "n_removed"])

    return run


#: Columns of this operator's own; the input's travel in a struct, whatever their names.
ID, TEXT, ROW, SEEDS, SPANS, REST = "_doc_id", "_text", "_row", "_seeds", "_spans", "_rest"


def hot_seeds(docs: DataFrame, share: float = HOT_SHARE, least: int = HOT_LEAST, sample: int = HOT_SAMPLE) -> np.ndarray:
    """Seeds that at least `share` of the sampled documents have, ascending; docs: (doc_id, text). Their number is bounded by the mean number of seeds of a document over `share`."""
    every = max(1, docs.count() // sample)
    some = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(every)) == 0))
    by_seed = some.mapInArrow(_seed_rows(np.zeros(0, np.uint64)), "seed long, doc_id long").distinct().groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    n = some.agg(F.count_distinct("doc_id")).first()[0]
    found = [r["seed"] for r in by_seed.where(F.col("n") >= share * n).select("seed").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def hot_spans(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """Covered words of windows whose seed is hot; no task needs to see all occurrences of any of them."""
    held = written(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("rid")).mapInArrow(_hot_rows(hot), HOT), "hot-windows")
    ends = held.groupBy("seed", "words").agg(F.min(F.array_min("docs")).alias("lo"), F.max(F.array_max("docs")).alias("hi")).where("lo < hi")
    # a plain table: Spark can then split a window that many documents have
    reference = written(ends.select("seed", F.col("words").alias("reference"), "lo"), "hot-references")
    if reference.count() <= FEW:
        reference = F.broadcast(reference)
    return held.join(reference, "seed").select("docs", "rids", "starts", "words", "reference", "lo").mapInArrow(_match, "doc_id long, rid long, a int, b int")


def repeated_spans(docs: DataFrame, rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """(_doc_id, _spans): word spans [a, b) to remove from the rows of that id, each with the row (hash of the text) it belongs to.

    docs: (doc_id, text). rows: all columns, dealt by _doc_id; the caller joins the
    result to the same rows, so that Spark shuffles them once.
    """
    n = wide_shuffle(docs.sparkSession)
    found = docs.where(F.col("doc_id").isNotNull()).mapInArrow(_seed_rows(hot), "seed long, doc_id long")
    by_seed = Window.partitionBy("seed")
    shared = found.withColumns({"lo": F.min("doc_id").over(by_seed), "hi": F.max("doc_id").over(by_seed)}).where("lo < hi")
    mine = shared.groupBy(F.col("doc_id").alias(ID)).agg(F.collect_set("seed").alias(SEEDS))
    around = rows.join(mine, ID, "left").mapInArrow(_surroundings(hot), "seed long, doc_id long, rid long, start int, words binary")
    spans = around.repartition(n, "seed").sortWithinPartitions("seed", "doc_id").mapInArrow(_search, "doc_id long, rid long, a int, b int")
    if len(hot):
        spans = spans.unionByName(hot_spans(docs, hot))
    return spans.groupBy(F.col("doc_id").alias(ID)).agg(F.collect_set(F.struct("rid", "a", "b")).alias(SPANS))


def _joined(docs: DataFrame, keep: list[str], doc_id: str, text: str, **hot_bounds) -> DataFrame:
    rest = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias(REST)] if keep else []
    rows = docs.select(*rest, F.col(doc_id).cast("long").alias(ID), F.col(text).alias(TEXT), F.xxhash64(F.col(text)).alias(ROW)).repartition(wide_shuffle(docs.sparkSession), ID)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.join(repeated_spans(plain, rows, hot_seeds(plain, **hot_bounds)), ID, "left")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **hot_bounds) -> DataFrame:
    """docs with repeated words taken out of its text, and n_words, n_removed beside (they replace columns of these names, in any case). Words that stay in a changed text are joined by single spaces."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("n_words", "n_removed")]
    own = next(f.name for f in kept if f.name.lower() == text.lower())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return _joined(docs, [f.name for f in kept if f.name != own], doc_id, text, **hot_bounds).mapInArrow(_cut(own, [f.name for f in kept]), f"{schema}, n_words long, n_removed long")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **hot_bounds) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by single spaces)."""
    return _joined(docs, [], doc_id, text, **hot_bounds).mapInArrow(_cut(text, None), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


OP7_SQL = f"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i FROM w WHERE len(ws) >= {WINDOW}
), g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + {WINDOW - 1}], ' ')) AS h FROM s
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM g
), c AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM m WHERE least < doc_id
), r AS (
  SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, len(coalesce(gone, [])) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda x, k: NOT list_contains(coalesce(gone, []), k)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
