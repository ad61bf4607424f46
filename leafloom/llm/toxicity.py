"""Toxicity (10): class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary texts, read each word
(edges marked) up to `ORDER` characters at a time. The longest n-grams and the
next shorter ones have counts of their own in each class, discounted by
absolute discounting; below that both classes share one set of Kneser-Ney
continuation counts, so an expression too rare for its class is judged by what
both classes have and the classes differ only where there is evidence.

For each word, and each text, the two log-likelihoods are compared, normalised
by length. A text is marked by its most toxic words as well as by its average,
so `score` is a logistic function, fitted on rows the n-gram counts have not
seen, of the average over its distinct words and of its largest word ratios.

Learned from at most `max_train_docs` labelled rows of each class, chosen by
hash. That bound sets the model's size, so it can go to every task. Null or
empty text scores the share of toxic rows among those learned from. Without
rows of both classes every text scores that share (0 with no labels).
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, learn, slices, table, texts

MAX_TRAIN_DOCS = 2500
ORDER = 6
#: From this length down, counts are shared by the classes.
SHARED = 3
DISCOUNT = 0.75
THRESHOLD = 0.3
#: The largest word ratios of a text that count.
TOP = 4
FEATURES = 3
CACHE = 400_000
GRAM_CACHE = 1_000_000

WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@dataclass
class KneserNey:
    """Log-likelihood ratios of words from counts per class."""

    tables: list[dict]  # [0], [1]: n-gram counts of each class, longest orders; [2]: shared continuation counts
    contexts: list[dict]  # context -> (total, distinct followers), for each of the three
    alphabet: int

    @classmethod
    def fit(cls, counts: list[dict[str, int]]) -> "KneserNey":
        """counts: of each class's words."""
        tables: list[dict] = [defaultdict(float), defaultdict(float), defaultdict(float)]
        before: dict[str, set] = defaultdict(set)
        letters = set()
        for k, words in enumerate(counts):
            for w, n in words.items():
                marked = f"<{w}>"
                letters.update(marked)
                for i in range(1, len(marked)):
                    for size in range(SHARED + 1, ORDER + 1):
                        if i - size + 1 >= 0:
                            tables[k][marked[i - size + 1 : i + 1]] += n
                    for size in range(1, SHARED + 1):
                        if i - size + 1 >= 0:
                            before[marked[i - size + 1 : i + 1]].add(marked[i - size] if i >= size else "")
        for g, left in before.items():
            tables[2][g] = float(len(left))
        contexts = []
        for t in tables:
            c: dict[str, list[float]] = {}
            for g, n in t.items():
                x = c.setdefault(g[:-1], [0.0, 0.0])
                x[0] += n
                x[1] += 1
            contexts.append({g: (a, b) for g, (a, b) in c.items()})
        return cls([dict(t) for t in tables], contexts, len(letters) + 1)

    def gram(self, gram: str) -> float:
        """Log ratio of toxic to ordinary probability of an n-gram's last character after the others."""
        near = gram[-SHARED - 1 : -1]
        if len(gram) <= SHARED or near not in self.contexts[0] and near not in self.contexts[1]:
            return 0.0  # both classes have the shared counts alone
        p = 1 / self.alphabet
        table, context = self.tables[2], self.contexts[2]
        for size in range(1, min(SHARED, len(gram)) + 1):
            g = gram[-size:]
            total = context.get(g[:-1])
            if total:
                p = (max(table.get(g, 0.0) - DISCOUNT, 0.0) + DISCOUNT * total[1] * p) / total[0]
        own = [p, p]
        for k in (0, 1):
            table, context = self.tables[k], self.contexts[k]
            for size in range(SHARED + 1, len(gram) + 1):
                g = gram[-size:]
                total = context.get(g[:-1])
                if not total:
                    break  # a longer context can't be known either
                own[k] = (max(table.get(g, 0.0) - DISCOUNT, 0.0) + DISCOUNT * total[1] * own[k]) / total[0]
        return math.log(own[1] / own[0])

    def word(self, word: str, known: dict[str, float]) -> tuple[float, int]:
        """Toxic over ordinary log-likelihood, and the number of characters it is of. known: n-grams' ratios so far."""
        marked, ratio = f"<{word}>", 0.0
        n = len(marked)
        for gram in [marked[: i + 1] for i in range(SHARED, min(n, ORDER))] + [marked[i : i + ORDER] for i in range(1, n - ORDER + 1)]:
            value = known.get(gram)
            if value is None:
                if len(known) > GRAM_CACHE:
                    known.clear()
                value = known[gram] = self.gram(gram)
            ratio += value
        return ratio, n - 1


class Scratch:
    """What a worker remembers of words and n-grams, bounded by CACHE."""

    def __init__(self):
        self.grams: dict[str, float] = {}
        self.row: dict[str, int] = {}
        self.values = np.zeros((CACHE + 1, 2))


@dataclass
class Model:
    ratios: KneserNey | None
    weights: np.ndarray
    prior: float

    def features(self, words: set[str], scratch: Scratch) -> np.ndarray:
        """Length-normalised ratio of a text's distinct words together, and the largest ratios of single words."""
        out = np.zeros(FEATURES)
        if not words:
            return out
        row, values, total, length, top, every = scratch.row, scratch.values, 0.0, 0.0, np.zeros(0), list(words)
        for part in (every[a : a + CACHE // 2] for a in range(0, len(every), CACHE // 2)):
            if len(row) > CACHE // 2:
                row.clear()
            for w in set(part).difference(row):
                values[len(row)] = self.ratios.word(w, scratch.grams)
                row[w] = len(row)
            found = values[np.fromiter(map(row.__getitem__, part), np.int64, len(part))]
            total += found[:, 0].sum()
            length += found[:, 1].sum()
            top = np.sort(np.concatenate([top, found[:, 0] / np.sqrt(found[:, 1])]))[-TOP:]
        out[0] = total / length
        out[1] = top[-1]
        out[2] = top.sum() / TOP
        return out

    def scores(self, features: np.ndarray, empty: np.ndarray) -> np.ndarray:
        if self.ratios is None:
            return np.full(len(features), self.prior)
        z = features @ self.weights[1:] + self.weights[0]
        return np.where(empty, self.prior, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (intercept first) by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: list[tuple[str, int]], prior: float) -> Model:
    """rows: text and label, in a fixed order. Halves take turns to count and to calibrate."""
    if not {0, 1} <= {y for _, y in rows}:
        return Model(None, np.zeros(1 + FEATURES), prior)
    parsed = [(words_of(t), y) for t, y in rows]
    halves = [[], []]
    for k in (0, 1):
        for n, x in enumerate([x for x in parsed if x[1] == k]):
            halves[n % 2].append(x)

    def counted(part):
        counts: list[dict[str, int]] = [defaultdict(int), defaultdict(int)]
        for ws, y in part:
            for w in ws:
                counts[y][w] += 1
        return counts

    xs, ys = [], []
    for a, b in ((0, 1), (1, 0)):
        if not {0, 1} <= {y for _, y in halves[a]}:
            continue
        m = Model(KneserNey.fit(counted(halves[a])), np.zeros(1 + FEATURES), prior)
        scratch = Scratch()
        for ws, y in halves[b]:
            xs.append(m.features(ws, scratch))
            ys.append(y)
    if not {0, 1} <= set(ys):
        return Model(None, np.zeros(1 + FEATURES), prior)
    y = np.array(ys, float)
    w = logistic(np.array(xs), y)
    share = y.mean()
    w[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model(KneserNey.fit(counted(parsed)), w, prior)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_train_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Learn from at most max_train_docs labelled rows of each class."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).distinct()
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.0
    if len(shares) < 2:
        return Model(None, np.zeros(1 + FEATURES), prior)
    parts = [known.where(F.col("y") == k).orderBy(F.xxhash64("i"), "i").limit(max_train_docs) for k in (0, 1)]
    picked = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * max_train_docs rows at most
    chosen = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(picked, "i").select("i", "t", "y")
    # words only, once each, so that long texts stay small on their way
    rows = chosen.mapInArrow(_distinct_words, "i long, t string, y int").collect()
    return train([(r["t"], r["y"]) for r in sorted(rows, key=lambda r: (r["i"], r["y"], r["t"]))], prior)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            t = [" ".join(sorted(words_of(x or ""))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(t, pa.string()), batch.column(2).cast(pa.int32())], names=["i", "t", "y"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        scratch = Scratch()
        for whole in batches:
            for batch in slices(whole, 1):
                found = [words_of(x) for x in texts(batch.column(1))]
                x = np.array([model.features(ws, scratch) if model.ratios else np.zeros(FEATURES) for ws in found])
                score = model.scores(x, np.array([not ws for ws in found], bool))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["key", "score"])

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(_score(shared), "key long, score double")
    return out.withColumnRenamed("key", doc_id)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(learn())
    found = score(docs, fit(docs.where(learn()), labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
