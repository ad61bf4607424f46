"""Node trees, outlines, markers, gold texts and workspaces on small cases: nulls, ties, empty tables, depth."""

import datetime
import difflib
import json
import random

from pyspark.sql import functions as F

from leafloom import sources
from leafloom.operators import gold, markers, match, outline, platform


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def trees(spark, rows):
    df = spark.createDataFrame(rows, "d string, j string")
    found, errors = sources.nodes(df, F.col("d"), F.col("j"))
    return found.orderBy("doc", "ord").collect(), {r.doc: r.error for r in errors.collect()}


def test_nodes_of_a_deep_tree_and_bad_trees(spark):
    deep = {"type": "p", "text": "end"}
    for k in range(150):
        deep = {"type": "box", "nid": f"n{k}", "children": [deep]}
    flat = {"body": [{"nid": "a", "type": "heading", "text": "é", "level": 2, "page": 3, "x": {"b": 1, "a": None}}, {"type": "list", "children": [{"text": "one"}, 7, {"text": ""}]}]}
    rows = [("deep", json.dumps({"body": [deep]})), ("flat", json.dumps(flat)), ("none", None), ("bad", "{"), ("list", "[1]"), ("empty", '{"body": null}'), ("odd", '{"body": 3}')]
    found, errors = trees(spark, rows)
    deep_rows = [r for r in found if r.doc == "deep"]
    assert [r.depth for r in deep_rows] == list(range(151)) and deep_rows[-1].text == "end" and deep_rows[1].parent == "n149"
    held = [(r.nid, r.parent, r.ord, r.place, r.kind, r.level, r.page, r.text) for r in found if r.doc == "flat"]
    assert held == [("a", None, 0, 0, "heading", 2, 3, "é"), ("@1", None, 1, 1, "list", None, None, None), ("@1.0", "@1", 2, 0, None, None, None, "one"), ("@1.2", "@1", 4, 2, None, None, None, "")]
    assert found[-4].attrs == {"x": '{"a": null, "b": 1}'}
    assert set(errors) == {"flat", "none", "bad", "list", "odd"}
    assert trees(spark, []) == ([], {})


def test_shared_ids_are_told(spark):
    found, _ = sources.nodes(spark.createDataFrame([("d", '{"body": [{"nid": "a"}, {"nid": "a"}, {"nid": "b"}]}')], "d string, j string"), F.col("d"), F.col("j"))
    assert [tuple(r) for r in sources.node_errors(found).collect()] == [("d", "a", 2)]


def test_sidecars_and_names(spark):
    docs = spark.createDataFrame([("a", "Report", "in/x/Report.pdf"), ("b", "Report", "in/y/other.pdf"), ("c", None, None)], "slug string, name string, path string")
    side = spark.createDataFrame([("a", '{"batch_excluded": true}'), ("b", "{broken"), ("c", None), ("c", '{"batch_excluded": 0}'), ("c", '{"batch_excluded": [1]}')], "slug string, value string")
    assert {r.slug for r in sources.included(docs, side).collect()} == {"b", "c"}
    asked = spark.createDataFrame([("a",), ("Report",), ("other.pdf",), ("y/other.pdf",), ("ther.pdf",), ("c",), ("",), (None,)], "argument string")
    got = {r.argument: r.slug for r in sources.resolved(asked, docs).collect()}
    assert got == {"a": "a", "Report": "a", "other.pdf": "b", "y/other.pdf": "b", "ther.pdf": "ther.pdf", "c": "c", "": "", None: None}


def test_markers(spark):
    value = lambda s: markers.marker_value(F.lit(s))
    assert one(spark, *[value(s) for s in ("12.", " xx) ", "XIV", "a", "i", "1234", "", "xxi", None)]) == (12, 20, 14, 1001, 1, None, None, None, None)
    assert one(spark, *[markers.marker_label(F.lit(n)) for n in (7, 1003)], *[markers.roman(F.lit(n)) for n in (1, 29, 30)]) == ("7", "c", "i", "xxix", None)
    got = one(spark, *[markers.ordinal_marker(F.lit(s)) for s in ("3. x", "B) x", "c . x", "100. x", "3.x", None)])
    assert [g and tuple(g) for g in got] == [("decimal", 3, 3), ("upper-alpha", 2, 3), ("lower-alpha", 3, 4), None, None, None]
    assert one(spark, *[markers.may_repeat(F.lit(s)) for s in ("Annual Report of Works 12", "Annual Report", "annual report of works", "Is This It?", "", None)]) == (True, False, False, False, False, False)
    assert one(spark, *[markers.all_caps(F.lit(s)) for s in ("ABC 1", "AbC", "12", "")]) == (True, False, False, False)
    assert tuple(one(spark, markers.section_number(F.lit("12Results of")))[0]) == (12, "Results of")
    assert one(spark, *[markers.usable_colour(F.lit(c)) for c in ("#ffffff", "#e2e2e2", "#e1ffff")]) == (None, None, "#e1ffff")
    assert one(spark, markers.escaped(F.lit("a<b>&amp;")), markers.escaped(F.lit(None).cast("string"))) == ("a&lt;b&gt;&amp;amp;", "")
    assert one(spark, *[markers.context(F.lit(t), F.lit("Term"), 10) for t in ("the  term", "0123456789 term 0123456789", "none", "")]) == ("the term", "...6789 term 0123...", None, None)


def test_number_runs(spark):
    rows = spark.createDataFrame([("a", n) for n in (5, 3, 4, 4, 9, None)] + [("b", None)], "k string, n int")
    assert [tuple(r) for r in markers.number_runs(rows, ["k"], "n").collect()] == [("a", "3-5, 9")]


NODES = "doc_id long, ord long, page int, kind string, level int, text string"


def test_outline(spark):
    rows = [
        (1, 0, 1, "heading", 1, "The Whole Report"), (1, 1, 1, "heading", 2, "First"), (1, 2, 1, "paragraph", None, "x" * 90), (1, 3, 2, "heading", 2, "Executive Summary"),
        (1, 4, 2, "paragraph", None, "short"), (1, 5, 2, "paragraph", None, "s" * 81), (1, 6, None, "heading", 2, "First"), (1, 7, 3, "heading", 1, "References"), (1, 8, 3, "figure", None, None),
        (2, 0, 1, "heading", 3, "One"), (2, 1, 1, "heading", 1, "Two"), (2, 2, 1, "paragraph", None, None), (3, 0, None, "paragraph", None, "only"),
    ]
    df = spark.createDataFrame(rows, NODES)
    titles = spark.createDataFrame([(1, " the whole  report ")], "doc_id long, title string")
    assert {tuple(r[:3]) + (tuple(r.entries),) for r in outline.contents(df, titles).collect()} == {(1, 2, 3, ("First", "Executive Summary", "First")), (2, 3, 1, ("One",))}
    assert {r.doc_id: tuple(r.highlights) for r in outline.highlights(df).collect()} == {1: ("First", "Executive Summary"), 2: ("One",)}
    assert {r.doc_id: r.summary for r in outline.summary(df).collect()} == {1: "s" * 81, 3: "only"}
    assert {r.doc_id: (r.words, r.headings, r.pages, r.kinds) for r in outline.profile(df).collect()}[2] == (2, 2, 1, {"heading": 2, "paragraph": 1})
    got = {r.doc_id: (r.text, r.whole) for r in outline.text_of(df, 20).collect()}
    assert got == {1: ("[page 1]\nThe Whole Report", False), 2: ("[page 1]\nOne\nTwo", True), 3: ("only", True)}
    none = spark.createDataFrame([], NODES)
    assert not any(f(none).collect() for f in (outline.contents, outline.highlights, outline.summary, outline.profile))


def test_running_heads_brute(spark):
    pick = random.Random(5)
    heads = ["Annual Report Of Works", "Annual Report Of", "Some Other Head Line"]
    rows = []
    for doc in (1, 2, None):
        for o in range(60):
            head = pick.choice([*heads, ""])
            rows.append((doc, o, pick.choice([head, f"{head} {pick.randrange(99)}", f"{head} {pick.randrange(99)} and text.", f"{head}s and text.", "Plain text here.", ""])))
    rows.append((1, 60, None))

    def key(t):
        t = " ".join(t.split())
        cut = t.rsplit(" ", 1)
        return cut[0] if len(cut) == 2 and cut[1].isdigit() and len(cut[1]) <= 4 else t

    want = set()
    for doc in (1, 2):
        texts = [t for d, _, t in rows if d == doc and t]
        keys = [key(t) for t in texts if not set(key(t)) & set(".!?")]
        common = {k for k in keys if keys.count(k) >= 3 and k in heads}
        for d, o, t in rows:
            if d != doc or not t:
                continue
            hit = max((h for h in common if t == h or t.startswith(h + " ")), key=len, default=None)
            if hit:
                t = t[len(hit) :].strip()
                first = t.split(" ", 1)[0]
                t = t[len(first) :].strip() if first.isdigit() else t
            if t:
                want.add((d, o, t))
    df = spark.createDataFrame(rows, "doc_id long, ord long, text string")
    got = {tuple(r) for r in outline.without_running_heads(df.where("doc_id IS NOT NULL")).collect()}
    assert got == want and any(t == "and text." for *_, t in got)


def test_ids_tell_equal_nodes_apart(spark):
    df = spark.createDataFrame([(1, 0, "p", 1, "Same, text"), (1, 1, "p", 1, "same TEXT"), (1, 2, "p", 2, "same text"), (1, 3, "p", None, None)], "doc_id long, ord long, kind string, page int, text string")
    ids = [r.node_id for r in outline.with_ids(df, outline.content_id(F.col("kind"), F.col("page"), F.col("text")), ["ord"], ["doc_id"]).orderBy("ord").collect()]
    assert ids[1] == ids[0] + "-2" and len(set(ids)) == 4 and all(i.startswith("n") for i in ids)
    assert one(spark, *[outline.heading_slug(F.lit(t)) for t in ("A b!", "—", "x" * 70)]) == ("a-b", "section", "x" * 60)


def test_gold(spark):
    g = spark.createDataFrame([(1, 1, "a", 1, "Some  TEXT", True), (1, 2, "a", None, "other", True), (1, 3, "b", 1, "", False), (1, 4, "c", 1, "some text", True), (1, 5, "a", 9, "some text", False), (2, 6, "a", 1, None, True)], "doc_id long, gold_id long, kind string, page int, text string, expected boolean")
    c = spark.createDataFrame([(1, 10, 1, "a", 1, "this is some text here"), (1, 11, 0, "a", None, "some text"), (1, 12, 2, "b", 5, "x"), (1, 13, 3, "b", 1, None)], "doc_id long, candidate_id long, ord long, kind string, page int, text string")
    m = gold.gold_match(g, c)
    assert {r.gold_id: r.candidate_id for r in m.collect()} == {1: 11, 2: None, 3: 13, 4: None, 5: 11, 6: None}
    assert {r.doc_id: (r.type_recall, r.hit_rate, r.negative_hits, r.gold_count) for r in gold.gold_rates(m, c).collect()} == {1: (0.5, 0.333, 2, 3), 2: (0.0, 0.0, 0, 1)}


def test_claimed(spark):
    before = spark.createDataFrame([(1, "ring label and  axis"), (1, "flow text"), (2, None)], "doc_id long, text string")
    after = spark.createDataFrame([(1, "flow text")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, 1, ["ring label", "and axis"]), (2, 1, ["ring label", "flow"]), (3, 1, ["nowhere", "flow"]), (4, 2, ["x"]), (5, 1, [])], "check_id long, doc_id long, args array<string>")
    assert {r.check_id: (r.passed, r.place) for r in gold.claimed(asked, before, after).collect()} == {1: (True, "claimed"), 2: (False, "kept"), 3: (False, "lost"), 4: (False, "lost"), 5: (True, "claimed")}


def test_workspaces(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    grants = spark.createDataFrame(
        [("w", None, "free", None, day(1), None), ("w", "max", None, 10, day(1), None), ("w", "old", None, 5, day(1), day(10)), ("w", "late", None, 5, day(11), None), ("v", "max", "free", 1, day(1), day(11)), ("u", None, "none", None, day(1), None)],
        "workspace string, feature string, plan string, allowed long, valid_from timestamp, valid_until timestamp",
    )
    plans = spark.createDataFrame([("free", "access", None), ("free", "max", 3)], "plan string, feature string, allowed long")
    held = platform.workspace_features(grants, plans, F.lit(day(10)))
    assert {(r.workspace, r.feature): r.limit for r in held.collect()} == {("w", "access"): None, ("w", "max"): 10, ("v", "access"): None, ("v", "max"): 3}
    asked = spark.createDataFrame([("w", "max", 9), ("w", "max", 10), ("w", "access", 99), ("w", "old", 0), (None, "max", 0)], "workspace string, feature string, used long")
    assert [r.state for r in platform.within_quota(asked, held).orderBy(F.col("workspace").isNull(), "feature", "used").collect()] == ["allowed", "allowed", "limit_reached", "no_entitlement", "no_entitlement"]


def test_versions(spark):
    held = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 1, "z")], "k string, v long, b string")
    puts = spark.createDataFrame([("a", 1, "new", 2), ("a", 1, "later", 3), ("b", 1, "stale", 1), ("d", 1, "unknown", 1), ("c", None, "none", 1)], "k string, v long, b string, line long")
    after, refused = platform.put_if_current(held, puts, "k", "v", "b")
    assert {tuple(r) for r in after.collect()} == {("a", 2, "new"), ("b", 2, "y"), ("c", 1, "z")}
    assert {r.b for r in refused.collect()} == {"later", "stale", "unknown", "none"}


def test_fuzzy_remap_brute(spark):
    pick = random.Random(3)
    words = lambda: " ".join(pick.choice(["alpha", "beta", "gamma", "delta", "alphas", "betta"]) for _ in range(pick.randrange(4)))
    old = [(k, pick.randrange(3), words()) for k in range(60)] + [(60, 1, None)]
    new = [(k, pick.randrange(3), words()) for k in range(100, 160)] + [(160, 1, None)]
    want = {}
    for i, b, t in old:
        best = [(1.0 if t == u else difflib.SequenceMatcher(None, t, u, autojunk=False).ratio(), -j) for j, c, u in new if b == c and t is not None and u is not None]
        best = [x for x in best if x[0] >= 0.6]
        if best:
            want[i] = (-max(best)[1], round(max(best)[0], 6))
    got = match.fuzzy_remap(spark.createDataFrame(old, "o long, b long, t string"), spark.createDataFrame(new, "n long, b long, t string"), ["b"], "o", "n", "t")
    assert {r.o: (r.n, r.ratio) for r in got.collect()} == want and len(want) > 20


def test_outline_rules(spark):
    rows = [
        (1, 0, 1, "heading", 2, "Contents"), (1, 1, 1, "heading", 2, "Figure 3 shows"), (1, 2, 1, "heading", 2, "Acknowledgments"), (1, 3, 1, "heading", 2, "Noteworthy"), (1, 4, 1, "heading", 2, "Notes on method"), (1, 5, 1, "heading", 2, "About the authors"), (1, 6, 1, "heading", 2, " "),
        (1, 7, 2, "heading", 2, "Introduction"), (1, 8, 2, "paragraph", None, "one two-three  four five"), (1, 9, 2, "heading", 3, "Deeper in"), (1, 10, 7, "paragraph", None, "six"), (1, 11, 7, "heading", 2, "Next"), (1, 12, 7, "paragraph", None, "seven"),
        (2, 0, None, "heading", 1, "Foreword"), (2, 1, None, "paragraph", None, "f" * 90), (2, 2, None, "heading", 1, "Abstract"), (2, 3, None, "paragraph", None, ("Word. " * 30 + "x" * 300).strip()),
        (3, 0, 0, "heading", None, "Overview"), (3, 1, 0, "paragraph", None, "w" * 30 + " " + "y" * 500),
    ]
    df = spark.createDataFrame(rows, NODES)
    assert {r.doc_id: tuple(r.entries) for r in outline.contents(df).collect()}[1] == ("Contents", "Noteworthy", "About the authors", "Introduction", "Next")
    assert {r.doc_id: r.summary for r in outline.summary(df).where("doc_id > 1").collect()} == {2: ("Word. " * 30).strip(), 3: "w" * 30 + "…"}
    assert {r.doc_id: (r.words, r.headings, r.pages, r.intro_words) for r in outline.profile(df).collect()} == {1: (22, 9, 7, 7), 2: (34, 2, 1, 31), 3: (3, 1, 1, 2)}
    images = spark.createDataFrame([(1, p, 0.5, 1.5, 2.4, 3.0) for p in (1, 1, 1, 2)] + [(1, 1, 9.0, 9.0, 9.0, 9.0)] * 3 + [(2, 1, None, 1.0, 1.0, 1.0)] * 2, "doc_id long, page int, l double, b double, r double, t double")
    pages = spark.createDataFrame([(1, 11), (2, 1)], "doc_id long, n_pages int")
    assert [tuple(r) for r in outline.repeated_images(images, pages).collect()] == [(1, 0.0, 2.0, 2.0, 3.0, 4)]
