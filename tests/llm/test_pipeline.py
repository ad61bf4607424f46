import random
import re

import pytest

import corpus_pipeline as p
from leafloom.llm import packing

from .data import ROWS, clashing, documents


def stage(name):
    return dict(p.STAGES)[name]


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES[:-1]])
def test_stages_keep_the_columns_and_stand_every_row(spark, name):
    for docs in (documents(spark), documents(spark, [])):
        out = stage(name)(spark, docs, "")
        assert out.dtypes == docs.dtypes
        n = out.count()
        assert n <= docs.count()
        for r in out.collect():
            assert r.n_chars == (None if r.text is None else len(r.text)) or name in ("language ID", "SimHash near-dedup")


def test_language_stage_rejects_what_has_no_letters(spark):
    kept = {r.doc_id for r in stage("language ID")(spark, documents(spark), "").collect()}
    assert not {3, 4, 5} & kept and {1, 2, 6, 7, 9} <= kept


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_keeps_one_of_each_component(spark):
    rnd = random.Random(6)
    rows = list(ROWS)
    for g in range(30):
        base = [f"g{g}x{rnd.randrange(500)}" for _ in range(rnd.randint(30, 300))]
        for k in range(4):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, len(w) // 3])):
                w[rnd.randrange(len(w))] = f"edit{rnd.random()}"
            rows.append((1000 + 10 * g + k, " ".join(w), "en", "a", 0))
    kept = sorted((r.doc_id for r in stage("SimHash near-dedup")(spark, documents(spark, rows), "").collect()), key=repr)
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, shingles(t))
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            union = len(sets[a] | sets[b])
            if b < a and (not union or len(sets[a] & sets[b]) / union >= 0.8):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    want = sorted([i for i, *_ in rows if i is None or find(i) == i], key=repr)
    assert len(set(kept) ^ set(want)) <= 2  # the sketch may err near the threshold
    assert len(want) < len(rows) - 40


def test_substring_stage_cuts_the_later_copy_only(spark):
    out = {r.doc_id: r.text for r in stage("substring dedup")(spark, documents(spark), "").collect()}
    by = {r[0]: r[1] for r in ROWS}
    assert out[6] == by[6] and out[1] == by[1]
    assert out[7] == "other start here end" and out[2] == ""


def test_packing_stage_covers_all_tokens(spark):
    docs = clashing(documents(spark))
    rows = stage("packing")(spark, docs, "").collect()
    words = packing.WordIds(packing.vocabulary())
    assert sum(r.length for r in rows) == sum(len(words.encode(r[1] or "")) // 4 + 1 for r in ROWS)


def test_whole_run_against_the_stages_one_by_one(spark, tmp_path):
    path = str(tmp_path)
    rows = [(k, re.sub("again", f"again {k % 9} " + " ".join(f"z{k % 9}{j}" for j in range(k % 5)), r[1]) if r[1] else r[1], *r[2:]) for k, r in enumerate(ROWS * 3)]
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for n, (_, f) in enumerate(p.STAGES[:-1]):
        f(spark, docs, path).write.parquet(f"{path}/{n}")
        docs = spark.read.parquet(f"{path}/{n}")
    want = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in p.STAGES[-1][1](spark, docs, path).collect())
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in p.run(spark, path).collect()) == want and want
