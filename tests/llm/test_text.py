import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from leafloom.llm import byte_bpe, fingerprint, language_id, packing, toxicity

from .data import ROWS, clashing, documents

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "\n\n  x  \n", "it's we'll  I'D", "x\x1cy \x1d z", "　a b c", "á é ²³ ½", "日本語 テキスト 12345", "😀 😀😀", "a" * 1000, " " * 300 + "b" + " " * 200, "ab" * 400 + " cd" * 10, "x \x85y", "<|endoftext|> hi", "ẞ ΣΑΣ. ς", "foo, bar. baz,."]


def odd_texts():
    rnd = random.Random(2)
    bits = ["a", "the", " ", "  ", "\n", " \n", "'s", "12", "é", "ß", ".", " ,", "\t", "\x1f", " ", "日", "😀", "ing", "Q"]
    return ODD + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))) for _ in range(200)]


def test_bpe_as_tiktoken(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts() + [t for _, t, *_ in ROWS]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], documents(spark).schema)
    for out in (byte_bpe.encode(clashing(df), BPE, public_tokenizers.PATTERN), byte_bpe.encode(df, BPE, public_tokenizers.PATTERN)):
        for r in out.collect():
            want = library.encode_ordinary(texts[r.doc_id] or "")
            assert list(r.ids) == want and r.n_tokens == len(want) and bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    digest = byte_bpe.digests(df, BPE, public_tokenizers.PATTERN).where("doc_id = 3").first()
    assert digest.ids_sha256 == hashlib.sha256(",".join(map(str, library.encode_ordinary("a"))).encode()).hexdigest()


def test_bpe_decodes_any_column_of_ids(spark):
    ids = byte_bpe.encode(documents(spark), BPE, public_tokenizers.PATTERN).select("doc_id", "ids").union(spark.createDataFrame([(99, None), (98, [])], "doc_id long, ids array<int>"))
    got = sorted((r.doc_id or 0, bytes(r.decoded)) for r in byte_bpe.decode(ids, BPE, public_tokenizers.PATTERN).where("decoded IS NOT NULL").collect())
    assert got == sorted([(i or 0, (t or "").encode()) for i, t, *_ in ROWS] + [(98, b"")])
    assert byte_bpe.decode(ids.where("doc_id = 99"), BPE, public_tokenizers.PATTERN).first().decoded is None


def test_bpe_heap_and_matrix_agree():
    bpe = byte_bpe.BPE(BPE, public_tokenizers.PATTERN)
    rnd = random.Random(4)
    pieces = ["".join(rnd.choice("abcdetion ñé") for _ in range(rnd.randint(2, 100))).encode() for _ in range(200)]
    pieces = [p for p in pieces if p not in bpe.ranks]
    assert [bpe._by_heap(p) for p in pieces] == bpe.encode_pieces(pieces)


def test_word_ids_as_tokenizers():
    words = packing.WordIds(packing.vocabulary())
    texts = odd_texts()
    for _ in range(2):
        for t, ids in zip(texts, words.batch(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


def test_word_ids_of_random_letters_and_marks():
    """Capitals that lower case parts into a letter and a mark, combining marks, and punctuation behind them."""
    words, rnd = packing.WordIds(packing.vocabulary()), random.Random(8)
    bits = ["İ", "I", "ı", "ŞİRKETİ", "BELEDİYESİ", "a", "É", "é", "e\u0301", "\u0307", "\u0958", "क", "़", "ñ", "n\u0303", "Σ", "ς", "ß", "ẞ", "ﬁ", "가", "한", "Ⅳ", "ª", "µ", "1", "²", ",", ".", ",.", "'s", "'", "’s", " ", " ", " ", "\n", "\u00a0", "<|endoftext|>", "-"]
    texts = ["ANKARA BELEDİYESİ, 2020", "ŞİRKETİ.", " İLİ. x"] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30))) for _ in range(6000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for t, ids in zip(part, words.batch(part)):
            assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing_places_every_id_once(spark):
    df = documents(spark)
    words = packing.WordIds(packing.vocabulary())
    for docs in (df, clashing(df)):
        rows = packing.packed_documents(docs, packing.vocabulary()).collect()
        want = {}
        for i, t, *_ in ROWS:
            want.setdefault(i, []).append(words.encode(t or "") + b"\x01\0\0\0")
        got = {}
        for r in rows:
            got.setdefault(r.doc_id, []).append(r)
        assert got.keys() == want.keys()
        for i, texts in want.items():
            assert sum(r.length for r in got[i]) == sum(len(x) // 4 for x in texts)
            for r in got[i]:
                assert any(r.doc_tokens == len(x) // 4 and r.ids_crc32 == zlib.crc32(x[4 * r.start : 4 * (r.start + r.length)]) for x in texts)
        sequences = {}
        for r in rows:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= packing.SEQUENCE


def test_packing_plan_meets_demand():
    rnd = np.random.default_rng(0)
    for demand in (np.zeros(64, int), np.eye(64, dtype=int)[5] * 1000, rnd.integers(0, 50, 64), rnd.integers(0, 3, 64)):
        found = packing.plan(demand, 64)
        assert (sum((p * n for p, n in found), np.zeros(64, int)) == demand).all()
        assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in found)
        assert sum(n for _, n in found) <= 1.3 * (demand * np.arange(1, 65)).sum() / 64 + 3 or demand[32:].sum()


def test_packing_empty_table(spark):
    assert packing.packed_documents(documents(spark, []), packing.vocabulary()).count() == 0


def test_fingerprints_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in ROWS]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        e = t[: len(t) - cut] + u[:cut]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.fingerprint(t), fingerprint.fingerprint(e)))
    for df in (documents(spark), clashing(documents(spark)), documents(spark).repartition(3)):
        got = [tuple(r)[:5] for r in fingerprint.edited_likeness(df).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_followers_of_ids_beyond_doubles(spark):
    rows = [(2**60 + k, f"text {k}", "en", "a", 0) for k in range(50)] + [(None, "none", "en", "a", 0)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprint.edited_likeness(documents(spark, rows).repartition(5)).collect()}
    order = [rows[-1], *rows[:-1]]
    for k, (i, t, *_) in enumerate(order):
        cut = len(t) // 4
        assert got[i] == hashlib.sha256((t[: len(t) - cut] + order[(k + 1) % len(order)][1][:cut]).encode()).hexdigest()


def test_fingerprint_likeness_bounds(spark):
    rows = fingerprint.edited_likeness(documents(spark)).collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    one = fingerprint.edited_likeness(documents(spark, ROWS[:1])).first()
    assert one.near_next == 1 and fingerprint.edited_likeness(documents(spark, [])).count() == 0


def test_language_id(spark):
    rnd = random.Random(7)
    vocab = {"en": "the of and to in that house water".split(), "fr": "le la de et les maison eau été".split(), "de": "der die und das nicht haus wasser über".split()}
    rows = [(k, " ".join(rnd.choices(vocab[lang], k=30)), lang, "a", 0) for k in range(300) for lang in [rnd.choice(sorted(vocab))]]
    train, test = documents(spark, rows[:200]), clashing(documents(spark, rows[200:] + [(900, None, None, None, 0), (901, "12 -- ", "en", "a", 0), (902, "", "en", "a", 0), (903, "house" * 3000, "en", "a", 0)]))
    model = language_id.fit(train)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(test, model).collect()}
    assert sum(got[i][0] == lang for i, _, lang, _, _ in rows[200:]) >= 95
    assert [got[k] for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = language_id.fit(documents(spark, []))
    assert {r.lang_pred for r in language_id.predict(documents(spark), nothing).collect()} == {"und"}
    assert language_id.predict(documents(spark, []), model).count() == 0


def test_letters_are_category_l(spark):
    rows = [(k, "the house of water a b x y", "en", "a", 0) for k in range(9)]
    model = language_id.fit(documents(spark, rows))
    texts = ["½ ² ③", "Ⅷ 12", "\u0301\u0308", "٣٤ 12", "_", "x²y"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(documents(spark, [(k, t, None, None, 0) for k, t in enumerate(texts)]), model).collect()}
    assert [got[k] for k in range(5)] == [("und", 0.0)] * 5 and got[5] == ("en", 1.0)
    assert language_id.letter_runs("x²y ½ Ⅷa 一二 Ünd") == ["x", "y", "a", "一二", "ünd"]


def test_what_was_seen_once_is_learned(spark):
    model = language_id.fit(documents(spark, [(1, "alpha beta", "en", "a", 0), (2, "gamma", "fr", "a", 0)]))
    assert (model.rows([b"alpha", b"gamma", b"\0gam"]) >= 0).all() and model.rows([b"delta"])[0] < 0


def test_a_rare_language_is_learned_whole(spark):
    rows = [(k, f"word{k % 700} other{k % 300} the of and", "en", "a", 0) for k in range(20_000)] + [(50_000 + k, "quelques mots rares seulement ici", "fr", "a", 0) for k in range(5)]
    model = language_id.fit(documents(spark, rows), max_train_docs=400)
    assert model.langs == ["en", "fr"] and model.rows([b"seulement"])[0] >= 0
    got = language_id.predict(documents(spark, [(1, "quelques mots rares", None, None, 0), (2, "the word7", None, None, 0)]), model).collect()
    assert [r.lang_pred for r in sorted(got)] == ["fr", "en"]
    assert language_id.shares({"a": 5, "b": 1000, "c": 3}, 100) == {"c": 3, "a": 5, "b": 92}


def test_language_scores_against_brute_force(spark):
    """The same scores from counts and backoff written out over plain dictionaries."""
    import math
    import re
    from collections import Counter

    rnd = random.Random(3)
    vocab = {"en": "the of house water river".split(), "fr": "le la maison eau rive".split()}
    rows = [(k, " ".join(rnd.choices(vocab[lang], k=8)), lang, "a", 0) for k in range(60) for lang in [rnd.choice(sorted(vocab))]]
    model = language_id.fit(documents(spark, rows))
    runs = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counts = {lang: [Counter() for _ in range(5)] for lang in vocab}
    for _, t, lang, *_ in rows:
        for w in runs(t):
            counts[lang][0][w] += 1
            for n in range(1, 5):
                m = f"<{w}>" if n > 1 else w
                for g in {m[i : i + n] for i in range(len(m) - n + 1)}:
                    counts[lang][n][g] += 1
    known = {(n, g) for lang in vocab for n in range(5) for g in counts[lang][n]}

    def log(lang, n, g):
        return math.log((counts[lang][n][g] + 0.1) / (sum(counts[lang][n].values()) + 1))

    def word(lang, w):
        if (0, w) in known:
            return log(lang, 0, w)
        m, at, out = f"<{w}>", 0, 0.0
        while at < len(m):
            n = next((n for n in range(min(4, len(m) - at), 0, -1) if (n, m[at : at + n]) in known), 0)
            out += log(lang, n, m[at : at + n]) if n else language_id.FLOOR
            at += n or 1
        return out

    tests = [(k, t, None, None, 0) for k, t in enumerate(["the house", "la rive du fleuve", "riverside maisonette", "xyz", "Watery HOUSES 12 le"])]
    for r in language_id.predict(documents(spark, tests), model).collect():
        ws = runs(tests[r.doc_id][1])
        sums = {lang: sum(word(lang, w) for w in ws) / len(ws) for lang in vocab}
        best = max(sorted(sums), key=lambda x: sums[x])
        assert r.lang_pred == best and abs(r.score - 1 / sum(math.exp(v - sums[best]) for v in sums.values())) < 1e-9


def test_toxicity_held_out(spark):
    rnd = random.Random(8)
    plain = ["".join(rnd.choices("aeioutnrs", k=rnd.randint(2, 7))) for _ in range(400)]
    rude = ["zlurk", "vqox", "zlurker", "vqoxing"]
    rows = []
    for k in range(600):
        toxic = k % 6 == 0
        w = rnd.choices(plain, k=40)
        if toxic:
            w[rnd.randrange(40)] = rnd.choice(rude)
        rows.append((k, " ".join(w), int(toxic)))
    docs = documents(spark, [(k, t, None, None, 0) for k, t, _ in rows])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k < 400], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id < 400"), labels)
    got = {r.doc_id: r.score for r in toxicity.score(clashing(docs), model).collect()}
    hits = [got[k] >= toxicity.THRESHOLD for k, _, y in rows[400:] if y]
    wrong = [got[k] >= toxicity.THRESHOLD for k, _, y in rows[400:] if not y]
    assert sum(hits) >= 0.9 * len(hits) and sum(wrong) <= 0.05 * len(wrong)


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, None)]])
def test_toxicity_without_both_classes(spark, labels):
    model = toxicity.fit(documents(spark), spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {r.score for r in toxicity.score(documents(spark), model).collect()}
    assert scores == {1.0 if labels and labels[0][1] else 0.0}
    assert toxicity.score(documents(spark, []), model).count() == 0
