"""The near-dedup stage's candidates: BK-trees over wide SimHash fingerprints."""

import random

import numpy as np

from leafloom.llm import simhash

from .test_similar import brute, components


def pair(at, size, extra):
    words = [f"p{at}w{k}" for k in range(size + 4)]
    return [(at, " ".join(words), "en", "a", 0), (at + 1, " ".join(words + [f"p{at}x{k}" for k in range(extra)]), "en", "a", 0)]


def test_only_what_the_trees_find_is_compared(spark):
    rows = [r for g in range(40) for r in pair(10 * g, 100, 1 + g % 20)]
    rows += [(1001, "a b c d e a b c d e", "en", "a", 0), (1002, "a b c d e a b c d e a b c d e", "en", "a", 0)]
    assert components(spark, rows, radius=0) == {(1001, 1001), (1002, 1001)}  # every other pair differs in some bit
    assert components(spark, rows) == brute(rows) and len(brute(rows)) == 82


def test_the_radius_holds_what_is_alike(spark):
    rows = [r for g in range(300) for r in pair(10 * g, 4, 1)]  # fingerprints differ most at four shingles against five
    rows += [r for g in range(60) for r in pair(10_000 + 10 * g, 4 * (g + 2), g + 2)]
    want = brute(rows)
    assert components(spark, rows) == want and len(want) == len(rows)


def test_radius_is_that_of_the_similarity():
    assert simhash.flip_odds(0.8) == 0.1875  # sets of 4 and 5: four bits tie and the fifth is set
    rnd = np.random.default_rng(5)
    for common, one, other in ((4, 1, 0), (12, 3, 0), (20, 2, 3), (400, 50, 50)):
        flips = []
        for _ in range(200):
            h = rnd.integers(0, 2**64, common + one + other, np.uint64)
            a, b = h[: common + one], np.concatenate([h[:common], h[common + one :]])
            fp = [np.stack([simhash.majority(x, np.array([len(x)])) for x in (y, *(simhash.mixed(y, m) for m in simhash.WIDE_MIX))]) for y in (a, b)]
            flips.append(int(np.bitwise_count(fp[0] ^ fp[1]).sum()))
        assert max(flips) <= simhash.wide_radius() and np.mean(flips) <= 64 * simhash.WIDE * 0.19
    assert simhash.wide_radius(0.9) < simhash.wide_radius() < simhash.wide_radius(0.5)


def test_trees_hold_several_items_of_one_fingerprint():
    rnd = random.Random(8)
    base = [rnd.getrandbits(256) for _ in range(20)]
    values = []
    for _ in range(400):
        x = rnd.choice(base)
        for _ in range(rnd.choice([0, 0, 5, 60, 120])):
            x ^= 1 << rnd.randrange(256)
        values.append(x)
    tree = simhash.BKTree(lambda i: i)
    for i, x in enumerate(values):
        for radius in (0, 3, 89, 256):
            assert sorted(tree.within(x, radius, i)) == [j for j in range(i) if (values[j] ^ x).bit_count() <= radius]
        tree.add(x, i)


def test_a_search_passes_over_its_own_component():
    parts = simhash.Components()
    tree = simhash.BKTree(parts.find)
    for i in range(50):
        asked = 0
        for j in tree.within(1 << (i % 7), 8, i):
            asked += 1
            parts.join(i, j)
        assert asked <= 1
        tree.add(1 << (i % 7), i)
