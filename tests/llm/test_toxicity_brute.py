"""The whole toxicity query against class-conditional Kneser-Ney written out over plain counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from leafloom.llm import queries, toxicity

from .data import DOCUMENTS


def learnable(i):
    return zlib.crc32(str(i).encode()) % 4 != 2


def words(text):
    return set(re.findall(r"[^\W_]+", (text or "").lower()))


class Written:
    """Probabilities by the book: orders 1 to 3 from continuation counts of both classes, 4 to 6 from each class's own, absolute discounting of 0.75 throughout."""

    def __init__(self, texts):
        marked = [[f"<{w}>" for w in ws] for ws in ([x for t in texts[k] for x in t] for k in (0, 1))]
        every = marked[0] + marked[1]
        self.letters = len(set("".join(every))) + 1
        grams = lambda held, n: [m[i - n + 1 : i + 1] for m in held for i in range(1, len(m)) if i >= n - 1]
        self.own = [{n: Counter(grams(held, n)) for n in (4, 5, 6)} for held in marked]
        left = {(m[i - n + 1 : i + 1], m[i - n] if i >= n else "") for m in every for n in (1, 2, 3) for i in range(1, len(m)) if i >= n - 1}
        self.shared = Counter(g for g, _ in left)

    def p(self, k, gram):
        """Of the gram's last character after the others, in class k."""
        out = 1 / self.letters
        for n in range(1, len(gram) + 1):
            g = gram[-n:]
            counts = self.shared if n <= 3 else self.own[k][n]
            row = [c for x, c in counts.items() if len(x) == n and x[:-1] == g[:-1]]
            if not row:
                if n > 3:
                    break
                continue
            out = (max(counts.get(g, 0) - 0.75, 0) + 0.75 * len(row) * out) / sum(row)
        return out

    def ratio(self, word, memo):
        m, out = f"<{word}>", 0.0
        for i in range(1, len(m)):
            g = m[max(0, i - 5) : i + 1]
            if len(g) > 3:  # shorter ones are the same in both classes
                if g not in memo:
                    memo[g] = math.log(self.p(1, g) / self.p(0, g))
                out += memo[g]
        return out, len(m) - 1

    def features(self, ws, memo):
        if not ws:
            return [0.0, 0.0, 0.0]
        found = [self.ratio(w, memo) for w in ws]
        top = sorted((r / math.sqrt(n) for r, n in found), reverse=True)[:4]
        return [sum(r for r, _ in found) / sum(n for _, n in found), top[0], sum(top) / 4]


def test_query_against_written_out_model(spark, tmp_path):
    rnd = random.Random(21)
    calm, rude = "river house stone garden paper winter letter morning".split(), "zargle brond vexling krud".split()
    rows, labels = [], []
    for i in range(70):
        toxic = i % 3 == 0
        rows.append((i, " ".join(rnd.choices(calm, k=6) + (rnd.choices(rude, k=2) if toxic else [])), "en", "a", 0))
        if i < 50:
            labels.append((i, 1, int(toxic)))
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, "12 ½ — _", "en", "a", 0), (103, "Zargle BROND river", None, None, 0), (3, rows[3][1], "en", "b", 0)]
    labels += [(103, 0, None), (49, 1, labels[49][2])]
    where = str(tmp_path / "sf")
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{where}/labels.parquet")

    known = {i: y for i, _, y in labels if y is not None and learnable(i)}
    prior = sum(known.values()) / len(known)
    chosen = sorted((i, known[i], " ".join(sorted(words(t)))) for i, t, *_ in rows if i in known)
    parsed = [(words(t), y) for _, y, t in chosen]
    halves = [[], []]
    for k in (0, 1):
        for n, x in enumerate(x for x in parsed if x[1] == k):
            halves[n % 2].append(x)
    by_class = lambda part: [[ws for ws, y in part if y == k] for k in (0, 1)]
    x, y = [], []
    for a, b in ((0, 1), (1, 0)):
        m, memo = Written(by_class(halves[a])), {}
        for ws, label in halves[b]:
            x.append([1, *m.features(ws, memo)])
            y.append(label)
    x, y = np.array(x), np.array(y, float)

    model = toxicity.fit(*(spark.read.parquet(f"{where}/{t}.parquet").where(toxicity.learn()) for t in ("documents", "labels")))
    shift = math.log(prior / (1 - prior)) - math.log(y.mean() / (1 - y.mean()))
    w = model.weights - np.array([shift, 0, 0, 0])
    slope = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + np.array([1e-3, 1, 1, 1]) * w
    assert np.abs(slope).max() < 1e-6  # the weights are those of least penalised loss over features of rows not counted

    whole, memo = Written(by_class(parsed)), {}
    got = sorted((r.doc_id, r.held_out, r.score, r.predicted) for r in queries.QUERIES["op10_toxicity"](spark, where).collect())
    assert [g[0] for g in got] == sorted(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    for i, held, score, predicted in got:
        ws = words(text[i])
        want = 1 / (1 + math.exp(-float(np.dot(model.weights, [1, *whole.features(ws, memo)])))) if ws else prior
        assert held == (not learnable(i)) and abs(score - want) < 1e-9 and predicted == int(score >= 0.3)
