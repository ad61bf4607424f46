"""Near-dedup by similarity of five-word shingles against brute force."""

import random

from leafloom.llm import simhash

from .data import documents
from .test_pipeline import shingles


def components(spark, rows, **options):
    return {(r.doc_id, r.component_id) for r in simhash.similar_components(documents(spark, rows), **options).collect()}


def brute(rows):
    sets, up = {i: shingles(t) for i, t, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    named = {i: find(i) for i in up}
    return {(i, c) for i, c in named.items() if list(named.values()).count(c) > 1}


def pairs(rnd, n, size, least, most):
    """Pairs of texts with `size` shingles in common and similarities from least to most, the threshold itself among them."""
    rows = []
    for g in range(n):
        words = [f"g{g}w{k}" for k in range(size + 4)]
        extra = round(size / (0.8 if g % 5 == 0 else rnd.uniform(least, most))) - size
        rows += [(10 * g, " ".join(words), "en", "a", 0), (10 * g + 1, " ".join(words + [f"g{g}x{k}" for k in range(extra)]), "en", "a", 0)]
    return rows


def test_pairs_near_the_threshold_are_decided_exactly(spark):
    rnd = random.Random(3)
    rows = pairs(rnd, 60, 400, 0.78, 0.82) + [(10_000 + i, *r) for i, *r in pairs(rnd, 60, 8, 0.6, 1.0)]
    assert components(spark, rows, radius=64) == brute(rows)


def test_fingerprints_far_apart_do_not_part_what_is_alike(spark):
    rnd = random.Random(4)
    rows = pairs(rnd, 60, 400, 0.78, 0.82) + [(10_000 + i, *r) for i, *r in pairs(rnd, 60, 8, 0.6, 1.0)]
    for g in range(20):
        words = [f"r{g}w{k}" for k in range(404)]
        rows += [(20_000 + 10 * g, " ".join(words), "en", "a", 0), (20_001 + 10 * g, " ".join(words + words[:34] * 40), "en", "a", 0)]
    want = brute(rows)
    assert components(spark, rows) == want and sum(i >= 20_000 for i, _ in want) == 40


def test_rows_of_one_set_are_one_node(spark):
    rows = [(1, "a b c d e a b c d e", "en", "a", 0), (2, "a b c d e a b c d e a b c d e", "en", "a", 0), (3, "", "en", "a", 0), (4, None, "en", "a", 0), (5, "a b", "en", "a", 0)]
    assert components(spark, rows) == {(1, 1), (2, 1), (3, 3), (4, 3)}
