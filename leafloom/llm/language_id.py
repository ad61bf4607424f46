"""Language ID (4): word-first backoff.

A word is a run of letters, lower-cased. A word that the model knows scores its
log relative frequency in each language. An unseen word falls back to its
character n-grams (word edges marked): the longest that the model knows at each
place, shorter and shorter, down to single characters and then to a uniform
floor. A text's score for a language is the sum over its words; the best
language is the prediction. `score` is that language's share of the likelihood
of the text's average word, so it does not run to 1 with the text's length.

Learned: word and n-gram counts per language, over a sample of at most
`max_train_docs` rows taken by hash from those that may be learned from. Each
language has an equal share of the sample (what a rare one leaves goes to the
others), so that every language with a row to learn from is learned, however
rare. All words and n-grams of the sample are learned, once seen or often: counts
are added up in tasks and reach every task as sorted arrays of 64-bit hashes with
an entry for each language that has the part. The sample's bound, not the corpus,
sets the model's size.

Letters are the characters of Unicode's category L: digits, number signs (½, Ⅷ)
and marks are none. Null text, or text without letters: `und`, score 0. With nothing to learn from,
every text is `und`. Ties go to the language that sorts first. Input columns
other than id, text and language are ignored by the model.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, learn, slices, table, texts, written

#: Bound of what is learned from.
MAX_TRAIN_DOCS = 8000
LONGEST_GRAM = 4
#: Distinct words whose parts a worker keeps.
CACHE = 100_000
UNKNOWN = "und"
#: Log score of a character that no text learned from has.
FLOOR = -12.0

RUNS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    runs = RUNS.findall(text.lower())
    if "".join(runs).isalpha() or not runs:
        return runs
    # a run may hold number signs, which are no letters
    return [w for run in runs for w in "".join(c if c.isalpha() else " " for c in run).split()]


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """What the sample says of words (size 0) and n-grams (their size), by the hash of the part."""

    langs: list[str]
    keys: np.ndarray  # ascending
    size: np.ndarray  # of each key
    first: np.ndarray  # n + 1: the entries of key k
    lang: np.ndarray  # of each entry
    gain: np.ndarray  # of each entry: log relative frequency above `absent`
    absent: np.ndarray  # by size and language: log relative frequency of what the language hasn't

    def rows(self, parts: list[bytes]) -> np.ndarray:
        """The keys' places, -1 where the model doesn't know the part."""
        h = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64, len(parts))
        at = np.searchsorted(self.keys, h)
        known = np.zeros(len(h), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] == h
        return np.where(known, at, -1)

    def parts(self, words: list[str], grams: dict[str, int]) -> list[list[int]]:
        """For each word the rows that its score is the sum of: its own, or those of the longest n-grams that are known, from place to place. grams: rows of n-grams looked up before."""
        out = []
        for word, own in zip(words, self.rows([w.encode() for w in words]).tolist()):
            if own >= 0:
                out.append([own])
                continue
            marked, rows, at = f"<{word}>", [], 0
            while at < len(marked):
                for n in range(min(LONGEST_GRAM, len(marked) - at), 0, -1):
                    gram = marked[at : at + n]
                    row = grams.get(gram)
                    if row is None:
                        if len(grams) > CACHE:
                            grams.clear()
                        row = grams[gram] = int(self.rows([b"\0" + gram.encode()])[0])
                    if row >= 0:
                        break
                rows.append(row)
                at += n
            out.append(rows)
        return out

    def sums(self, of: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Log scores (n x languages) of rows, of[i] being whose score row i belongs to."""
        width = len(self.langs)
        floor = rows < 0
        out = np.repeat((FLOOR * np.bincount(of[floor], minlength=n))[:, None], width, axis=1)
        of, rows = of[~floor], rows[~floor]
        sizes = len(self.absent)
        out += np.bincount(of * sizes + self.size[rows], minlength=n * sizes).reshape(n, sizes) @ self.absent
        many = self.first[rows + 1] - self.first[rows]
        entry = np.arange(many.sum()) + np.repeat(self.first[rows] - np.r_[0, np.cumsum(many)[:-1]], many)
        return out + np.bincount(np.repeat(of, many) * width + self.lang[entry], weights=self.gain[entry], minlength=n * width).reshape(n, width)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (size 0) and n-grams (their size) with their counts per language, added up within a task."""
    held: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, Counter()).update(letter_runs(text or ""))
    for lang, c in held.items():
        yield _counted(lang, 0, c)
        for size in range(1, LONGEST_GRAM + 1):
            parts: Counter = Counter()
            for w, n in c.items():
                for g in set(grams(w, size)):
                    parts[g] += n
            yield _counted(lang, size, parts)


COUNTS = "lang string, size int, part string, n long"


def _counted(lang: str, size: int, c: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([size] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "size", "part", "n"])


def shares(held: dict[str, int], most: int) -> dict[str, int]:
    """Equal shares of `most` to each key; what one can't fill goes to the others. Each has 1 at least."""
    out, left = {}, most
    for k, (name, n) in enumerate(sorted(held.items(), key=lambda x: (x[1], x[0]))):
        out[name] = max(1, min(n, left // (len(held) - k)))
        left -= out[name]
    return out


def sampled(usable: DataFrame, max_train_docs: int) -> DataFrame:
    """(t, l): of each language (l) its share of rows, those of least hash of their id (i)."""
    counts = {r["l"]: r["n"] for r in usable.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    most = shares(counts, max_train_docs)
    # about that many rows have a hash below the bound, with room for chance; ranking then sees those alone
    bounds = [x for name, k in most.items() for x in (F.lit(name), F.lit(min(2**63 - 1, int((k + 8 * k**0.5 + 8) / counts[name] * 2**63))))]
    order = F.xxhash64("i").bitwiseAND(F.lit(2**63 - 1))
    few = usable.withColumn("o", order).where(F.col("o") <= F.create_map(*bounds)[F.col("l")]) if most else usable.withColumn("o", order)
    rank = F.row_number().over(Window.partitionBy("l").orderBy("o", "i", F.xxhash64("t")))
    limit = F.create_map(*[x for name, k in most.items() for x in (F.lit(name), F.lit(k))])[F.col("l")] if most else F.lit(0)
    return few.withColumn("k", rank).where(F.col("k") <= limit).select("t", "l")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_train_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Learn from at most max_train_docs rows of docs with a language and text (a row for each language at least)."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    counted = written(sampled(usable, max_train_docs).mapInArrow(_counts, COUNTS).groupBy("lang", "size", "part").agg(F.sum("n").alias("n")), "language-counts")
    totals = {(r["lang"], r["size"]): float(r["n"]) for r in counted.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({name for name, _ in totals})
    if not langs:
        none = np.zeros(0, np.int64)
        return Model([], none.view(np.uint64), none, np.zeros(1, np.int64), none, np.zeros(0), np.zeros((LONGEST_GRAM + 1, 0)))
    at = F.create_map(*[x for k, name in enumerate(langs) for x in (F.lit(name), F.lit(k))])
    part = F.when(F.col("size") == 0, F.col("part")).otherwise(F.concat(F.lit("\0"), "part"))
    held = counted.select(F.xxhash64(part).alias("key"), at[F.col("lang")].alias("lang"), "size", "n").toArrow()  # bounded by the sample
    key, lang_, size, n = (held.column(c).to_numpy() for c in ("key", "lang", "size", "n"))
    key = key.view(np.uint64)
    order = np.lexsort([lang_, key])
    key, lang_, size, n = key[order], lang_[order], size[order], n[order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    all_of = np.array([[totals.get((name, k), 0.0) for name in langs] for k in range(LONGEST_GRAM + 1)])
    absent = np.log(0.1 / (all_of + 1))
    gain = np.log((n + 0.1) / (all_of[size, lang_] + 1)) - absent[size, lang_]
    return Model(langs, key[heads], size[heads], np.r_[heads, len(key)], lang_.astype(np.int32), gain, absent)


def _predict(shared, text: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        parts: dict[str, list[int]] = {}
        grams: dict[str, int] = {}
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index(text)):
                n, column = batch.num_rows, texts(batch.column(text))
                sums, counts = np.zeros((n, max(1, len(model.langs)))), np.zeros(n, np.int64)
                for d, body in enumerate(column):
                    ws = letter_runs(body) if model.langs else []
                    counts[d] = len(ws)
                    for some in (ws[a : a + CACHE] for a in range(0, len(ws), CACHE)):
                        often = Counter(some)
                        if len(parts) > CACHE:
                            parts.clear()
                        new = [w for w in often if w not in parts]
                        parts.update(zip(new, model.parts(new, grams)))
                        held = [parts[w] for w in often]
                        which = np.repeat(np.arange(len(held)), np.fromiter(map(len, held), np.int64, len(held)))
                        by_word = model.sums(which, np.array([r for h in held for r in h], np.int64), len(held))
                        sums[d] += np.fromiter(often.values(), np.float64, len(often)) @ by_word
                none = counts == 0
                best = sums.argmax(axis=1)
                share = 1 / np.exp((sums - sums.max(axis=1, keepdims=True)) / np.maximum(1, counts)[:, None]).sum(axis=1)
                langs = [UNKNOWN if e else model.langs[b] for e, b in zip(none.tolist(), best.tolist())]
                rest = [x for x in batch.schema.names if keep_text or x != text]
                yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array(langs, pa.string()), pa.array(np.where(none, 0.0, share))], names=[*rest, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs (without text, if not wanted) with lang_pred and score beside; columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop("lang_pred", "score")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields if keep_text or f.name != text)
    return plain.mapInArrow(_predict(shared, text, keep_text), schema + "lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(docs.where(learn())), keep_text=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
