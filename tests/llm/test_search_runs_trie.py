"""Top-k search, periodic runs and the prefix trie against brute force, SQL and defined cases."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from leafloom.llm import prefix_trie, queries, runs, topk_search

from .data import clashing, documents

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_topk_search", "op12_periodic_runs", "op13_prefix_trie"])
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("embeddings", "documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = c.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


# -- top-k search

VECTORS = "vec_id long, embedding array<double>"


def brute_search(rows, k=5):
    def whole(x):
        return int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x)

    usable = [(n, i, [whole(x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, v in usable:
        if i is None or i % 50:
            continue
        scores = []
        for m, j, w in usable:
            if m != n and len(w) == len(v):
                s = max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w))))
                scores.append((-s, j is None, j or 0, j))
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, VECTORS) if isinstance(rows, list) else rows
    return sorted(map(tuple, topk_search.nearest(df, **options).collect()), key=repr)


def test_search_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)] + [(50, rows[50][1]), (50, rows[7][1]), (None, rows[50][1]), (None, rows[3][1])]  # ties, repeats, no id
    rows += [(100, None), (2000, [None, 1.0]), (2050, [float("nan")] * 6), (2100, [float("inf")] + [0.0] * 5), (2150, [0.1, 0.2]), (2200, [0.3, -0.2]), (2250, []), (2300, [])]
    rnd.shuffle(rows)
    want = brute_search(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, lane=3) == want  # several lanes
    assert found(spark, clashing(spark.createDataFrame(rows, VECTORS)).withColumns({"v": topk_search.F.lit(1), "rid": topk_search.F.lit(2)})) == want


def test_search_is_exact_at_any_size(spark):
    rnd = random.Random(6)
    for scale in (2.0**8, 2.0**16, 2.0**30, 1e200):
        rows = [(i, [rnd.uniform(-scale, scale) for _ in range(4)]) for i in range(0, 500, 10)] + [(k, [rnd.uniform(-1, 1)] * 4) for k in range(1, 30)]
        assert found(spark, rows) == brute_search(rows)


def test_search_few_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0])]) == []
    assert found(spark, [(50, [1.0]), (1, [2.0])]) == [(50, 1, 1, 131072)]
    assert found(spark, [(1, [1.0]), (2, [2.0])]) == []


# -- periodic runs


def brute_runs(x):
    least = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                least.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in least.items())


def test_runs_against_brute_force():
    rnd = random.Random(1)
    for _ in range(400):
        x = []
        while len(x) < rnd.randint(0, 150):
            p = [rnd.randint(0, rnd.choice([0, 1, 2, 9])) for _ in range(rnd.randint(1, 12))]
            x += (p * rnd.randint(1, 8))[: rnd.randint(1, 60)]
        a = np.array(x, np.int64)
        near = runs.nearest_equal((a.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), np.array([0, len(x)]))
        assert runs.runs_of(a) == runs.runs_of(a, near) == brute_runs(x)


def brute_row(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
    found = brute_runs(w)
    best = min(found, key=lambda f: (-Fraction(f[1], f[2]), f[0], f[2])) if found else None
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(found), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_of_documents(spark):
    from .data import ROWS

    rnd = random.Random(2)
    made = [(100 + k, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 120))) + " " + " ".join([f"u{x}" for x in range(k % 9 + 1)] * 9), "en", "a", 0) for k in range(60)]
    rows = ROWS + made + made[:2] + [(None, "a b c " * 20, None, None, None)]
    want = sorted((brute_row(r[0], r[1]) for r in rows), key=repr)
    for df in (documents(spark, rows), clashing(documents(spark, rows))):
        assert sorted(map(tuple, runs.periodic_runs(df, rebuild=runs.rebuilt).collect()), key=repr) == want
    assert runs.periodic_runs(documents(spark, [])).count() == 0


# -- prefix trie

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    own = {c: [y[2:] for y in sorted(v)] for c, v in by.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = lambda q: sum(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(made[c]) == len(p)))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids(p), sum(kids(q) == 0 for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie_against_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for c in [*range(-12, 60), 2**62]:
        rows += [(c, rnd.choice([t, t, None, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "hällo", "", None, "x" * 50])) for t in range(rnd.randint(1, 6))]
    rows += [(7, k, "user", f"t{k % 3}") for k in range(90)] + [(8, k, "user", f"t{k % 3}") for k in range(80)]  # deep chains
    rows += [(100 + k, t, "user", "same") for k in range(30) for t in range(12)] + rows[:5] + [(None, 1, "user", "lost"), (20, None, None, None)]
    want = brute_trie(rows)
    df = spark.createDataFrame(rows, CONVERSATIONS)
    for got in (prefix_trie.trie(df), prefix_trie.trie(df, block=4), prefix_trie.trie(clashing(df).withColumns({"depth": prefix_trie.F.lit(1), "digest": prefix_trie.F.lit("x")}))):
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], CONVERSATIONS)).count() == 0


def test_long_lists_of_ids_are_hashed_in_order(spark, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(3000)]
    got = {r.depth: r for r in prefix_trie.trie(spark.createDataFrame(rows, CONVERSATIONS), rebuild=lambda said: said.selectExpr("conv_id", "1 AS own", "place", "digest", "bytes")).collect()}
    assert got[1].ends_sha256 == hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()
    assert got[0].n_leaves == 1 and got[0].saved_tokens == 2999 * 4
