import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from leafloom.llm import exact_dedup, line_dedup, simhash, substring_dedup

from .data import DOCUMENTS, ROWS, clashing, documents

SPACE = r"[\x20\x09-\x0D]"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact_against_brute_force(spark):
    for df in (documents(spark), clashing(documents(spark))):
        got = sorted(map(tuple, exact_dedup.exact_groups(df).collect()), key=repr)
        groups = {}
        for i, t, *_ in ROWS:
            groups.setdefault(re.sub(SPACE, "", t or ""), []).append((i, len(t or "")))
        want = []
        for norm, rows in groups.items():
            keep = min(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
            for i, n in rows:
                want.append((i, keep[0], len(rows), (i, n) == keep, hashlib.sha256(norm.encode()).hexdigest()))
        assert got == sorted(want, key=repr)


def test_exact_compares_bytes_where_hashes_collide(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "aa"), (4, "b")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, hash_of=lambda c: F.unhex(F.md5(F.substring(c, 1, 1)))).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 1), 4: (4, 1)}


def test_exact_compares_bytes_of_rows_without_ids(spark):
    first = lambda c: F.unhex(F.md5(F.substring(c, 1, 1)))
    sizes = lambda rows: sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), hash_of=first).collect())
    assert sizes([(1, "aa"), (None, "ab"), (None, "ac")]) == [("1", "1", 1, True), ("None", "None", 1, True), ("None", "None", 1, True)]
    assert sizes([(None, "aa"), (None, "ab"), (None, "ab")]) == [("None", "None", 1, True), ("None", "None", 2, True), ("None", "None", 2, True)]
    assert sizes([(2, "ab"), (None, "aa"), (None, "ab"), (3, "aa")]) == [("2", "2", 2, True), ("3", "3", 2, True), ("None", "2", 2, False), ("None", "3", 2, False)]


def test_exact_empty_table(spark):
    out = exact_dedup.exact_groups(documents(spark, []))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0


def test_lines_against_brute_force(spark):
    rows = [(i, t, None, s, 0) for i, t, s in [(1, "Home\nAbout us\nreal text one", "a"), (2, " Home\t\nunique", "b"), (3, "Home\n\n\nother", "c"), (4, "About us\nabc", "a"), (5, None, "d"), (6, "", None), (7, "Home\nX", None), (8, "About us", "b"), (8, "About us\nmine", "b")]]
    for least in (2, 3, 4, 5):
        for df in (documents(spark, rows), clashing(documents(spark, rows))):
            out = line_dedup.without_boilerplate(df, min_sites=least)
            assert out.columns == [c for c in df.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
            sites = {}
            for _, t, _, s, _ in rows:
                for line in (t or "").split("\n"):
                    if line.strip(" \t\x0b\x0c\r"):
                        sites.setdefault(line.strip(" \t\x0b\x0c\r"), set()).add(s)
            want = []
            for i, t, _, _, _ in rows:
                kept = None if t is None else [x for x in t.split("\n") if len(sites.get(x.strip(" \t\x0b\x0c\r"), ())) < least]
                want.append((i, None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")), 0 if t is None else len(t.split("\n")) - len(kept)))
            assert sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr) == sorted(want, key=repr)


def test_lines_with_more_sites_than_a_sketch_lists(spark):
    rows = [(k, "shared by all\nshared by some" if k < 700 else "shared by all", None, f"s{k}", 0) for k in range(800)]
    found = line_dedup.boilerplate(documents(spark, rows), min_sites=700)
    assert found.count() == 2
    assert line_dedup.boilerplate(documents(spark, rows), min_sites=701).count() == 1


def test_lines_empty_table(spark):
    assert line_dedup.without_boilerplate(documents(spark, [])).count() == 0


def brute_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    near = [(100 + k, " ".join(f"t{j}" for j in range(60)) + f" end{k % 7}", "en", "a", 0) for k in range(40)]
    rows = ROWS + near
    for df in (documents(spark, rows), clashing(documents(spark, rows))):
        got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_components(df).collect()), key=repr)
        nodes = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
        parent = list(range(len(nodes)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(nodes)):
            for b in range(a):
                if (nodes[a][1] ^ nodes[b][1]).bit_count() <= 3:
                    parent[find(a)] = find(b)
        least = {}
        for k, (i, _) in enumerate(nodes):
            if i is not None:
                least[find(k)] = min(i, least.get(find(k), i))
        assert got == sorted(((i, f, least.get(find(k))) for k, (i, f) in enumerate(nodes)), key=repr)


def test_every_choice_of_blocks_finds_all_links():
    import random

    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(3):
            x = f
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)

    def parts(edges):
        up = {f: f for f in fps}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            up[find(a)] = find(b)
        return {frozenset(y for y in fps if find(y) == find(x)) for x in fps}

    want = parts([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    for n in (10, 10**9, 10**12):
        edges = []
        for mask in simhash.block_choices(n):
            shards = {}
            for f in fps:
                shards.setdefault(f & mask, []).append(f)
            for s in shards.values():
                edges += simhash.shard_edges(s)
        assert parts(edges) == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}


def test_simhash_empty_table(spark):
    assert simhash.near_components(documents(spark, [])).count() == 0


def brute_cut(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            if i is not None:
                first.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and min(first[tuple(w[k : k + 13])]) < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    rows = [(i, t) for i, t, *_ in ROWS]
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(30)) for _ in range(6)]
    for i in range(200, 260):
        rows.append((i, " ".join(rnd.choice([rnd.choice("abc"), rnd.choice(pool), rnd.choice(pool)[:40]]) for _ in range(8))))
    rows += [(230, "again " + pool[0]), (None, pool[1])]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENTS)
    assert sorted(map(tuple, substring_dedup.digests(df).collect()), key=repr) == brute_cut(rows)
    for share, least in ((0.0, 2), (0.1, 2), (0.2, 10)):  # with all shared seeds dealt by windows, with some of them
        assert sorted(map(tuple, substring_dedup.digests(df, share=share, least=least).collect()), key=repr) == brute_cut(rows)
    full = substring_dedup.deduplicated(clashing(df))
    assert full.columns[:5] == df.columns and full.count() == len(rows)
    by = {(r.doc_id, r.text): r for r in full.collect()}
    assert by[(1, ROWS[0][1])].n_removed == 0


def test_own_columns_replace_the_input_s_in_any_case(spark):
    df = documents(spark).select("*", F.lit(7).alias("N_WORDS"), F.lit(8).alias("N_Removed"), F.lit("x").alias("_TEXT"))
    out = substring_dedup.deduplicated(df)
    assert out.columns == [*df.columns[:5], "_TEXT", "n_words", "n_removed"]
    assert sorted((r.n_words, r._TEXT) for r in out.collect()) == sorted((len(words(t)), "x") for _, t, *_ in ROWS)
    df = documents(spark).select("*", F.lit(7).alias("N_LINES"), F.lit(8).alias("N_Removed"))
    out = line_dedup.without_boilerplate(df)
    assert out.columns == [*df.columns[:5], "n_lines", "n_removed"] and out.agg(F.sum("n_lines")).first()[0] == sum(len(t.split("\n")) for _, t, *_ in ROWS if t is not None)


def test_suffix_automaton_matching_statistics():
    import random

    rnd = random.Random(1)
    for _ in range(50):
        refs = [[rnd.choice("ab") for _ in range(rnd.randint(1, 12))] for _ in range(3)]
        text = [rnd.choice("abc") for _ in range(15)]
        automaton = substring_dedup.SuffixAutomaton()
        for r in refs:
            automaton.add(r)
        held = {tuple(r[a:b]) for r in refs for a in range(len(r)) for b in range(a + 1, len(r) + 1)}
        want = [max([0] + [n for n in range(1, e + 1) if tuple(text[e - n : e]) in held]) for e in range(1, 16)]
        assert automaton.matching(text) == want


def test_substrings_empty_table(spark):
    assert substring_dedup.digests(documents(spark, [])).count() == 0
