"""Runs, contents lists, layout groups, lists, graphs and validity on small fixtures."""

from pyspark.sql import functions as F

from leafloom.operators import checks, geometry, graph, logs, platform, runs, sequence, text, toc, tree, validate


def test_runs(spark):
    held = F.expr("array(named_struct('s', 0, 'e', 4, 'v', 'b'), named_struct('s', 5, 'e', 9, 'v', 'b'), named_struct('s', 12, 'e', 14, 'v', 'i'))")
    row = spark.range(1).select(
        runs.sliced(held, F.lit(3), F.lit(13)).alias("cut"),
        runs.merged(held).alias("one"),
        runs.joined(F.lit("abc"), held, F.lit("de"), held).alias("both"),
        runs.overlaps(F.lit(9), F.lit(12), held).alias("no"),
        runs.overlaps(F.lit(8), F.lit(10), held).alias("yes"),
        runs.merged(F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")).alias("none"),
    ).first()
    assert [tuple(r) for r in row.cut] == [(0, 1, "b"), (2, 6, "b"), (9, 10, "i")]
    assert [tuple(r) for r in row.one] == [(0, 9, "b"), (12, 14, "i")]
    assert row.both.text == "abc de" and tuple(row.both.runs[3]) == (4, 8, "b")
    assert (row.no, row.yes, row.none) == (False, True, [])


def test_contents_lists():
    entries = [(0, "intro", 1, 1), (1, "method", 4, 1), (2, "results", 9, 2), (3, "gone", 9, 1), (4, "notes", 20, 1)]
    headings = [(0, "intro", 3, 1), (1, "method", 6, 1), (2, "results", 11, 1), (3, "notes", 2, 1), (4, "notes", 22, 1), (5, "more", 30, 1)]
    assert toc.paired(entries, headings) == [("match", 0, 0), ("match", 1, 1), ("level", 2, 2), ("missed", 3, None), ("match", 4, 4), ("extra", None, 3), ("extra", None, 5)]
    assert toc.paired([], []) == []


def test_titles(spark):
    row = spark.range(1).select(toc.title_key(F.lit("2.1 The Results ..... 14")).alias("k"), toc.dot_depth(F.lit("2.1.3 X")).alias("d"), toc.dot_depth(F.lit("X")).alias("z")).first()
    assert tuple(row) == ("the results", 3, 0)


def test_near_groups():
    boxes = [(0, 0, 10, 10), (15, 0, 25, 10), (100, 0, 110, 10), (0, 17, 10, 20), (30, 5, 40, 9)]
    assert geometry.near_groups(boxes, 8) == [0, 0, 2, 0, 0]
    assert geometry.near_groups([], 8) == []


def test_box_predicates(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 20.0, 20.0), (0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 2.0, 2.0)], "l double, b double, r double, t double, r_l double, r_b double, r_r double, r_t double")
    got = df.select(geometry.overlap_share("", "r_").alias("s"), geometry.centre_inside("", "r_").alias("c"), geometry.near("", "r_", 2).alias("n")).collect()
    assert [tuple(r) for r in got] == [(0.25, True, True), (0.0, False, True)]


def test_lists(spark):
    rows = spark.createDataFrame([("d", k, n) for k, n in enumerate([1, 2, 3, None, 4, 1, 2])], "k string, o int, n int")
    assert sorted(map(tuple, sequence.ordinal_lists(rows, "k", "o", F.col("n")).collect())) == [("d", 0, 1, 3), ("d", 5, 1, 2)]
    assert [tuple(r) for r in sequence.marked_lists(rows, "k", "o", F.col("n").isNotNull()).collect()] in ([("d", 0, 3), ("d", 4, 3)], [("d", 4, 3), ("d", 0, 3)])


def test_graph(spark):
    leaves = spark.createDataFrame([(1, ["b", "a", "a"]), (1, ["a", "b"]), (2, ["a"]), (3, [])], "doc int, names array<string>")
    assert [tuple(r) for r in graph.comentions(leaves, F.col("names"), "doc").collect()] == [("a", "b", 2, 1)]
    found = graph.nodes(leaves.select("doc", F.explode("names").alias("label")).withColumn("kind", F.lit("x")), "kind", "label", "doc")
    assert {(r.label, r.mentions, r.n_documents) for r in found.collect()} == {("a", 4, 2), ("b", 2, 1)}


def test_validity(spark):
    registry = spark.createDataFrame([("a", "A"), ("a", "B"), (None, "C"), ("d", "")], "id string, name string")
    assert sorted(map(tuple, validate.registry_errors(registry, "id", ["name"]).collect())) == [("?", "no id"), ("a", "repeated id"), ("d", "no name")]
    nodes = spark.createDataFrame([("r", None), ("x", "r"), ("y", "nowhere")], "nid string, parent string")
    assert [tuple(r) for r in validate.tree_errors(nodes).collect()] == [("y", "parent not there")]


def test_tree_walk(spark):
    nodes = spark.createDataFrame([("r", None, "doc"), ("t", "r", "table"), ("c", "t", "cell"), ("a", "r", "aside"), ("p", "a", "paragraph")], "nid string, parent string, kind string")
    paths = tree.with_paths(nodes)
    assert {r.nid for r in tree.walked(paths, "kind", skip=("aside",), prune=("table",)).collect()} == {"r", "t"}
    assert {r.nid for r in tree.walked(paths, "kind").collect()} == {"r", "t", "c", "a", "p"}


def test_jobs_and_stages(spark):
    row = spark.range(1).select(*[platform.finished(F.lit(s), F.lit(f), F.lit(a), F.lit(3)).alias(n) for n, s, f, a in (("w", "running", False, 1), ("x", "running", True, 2), ("y", "running", True, 3), ("z", "cancelled", True, 1))]).first()
    assert tuple(row) == ("succeeded", "queued", "failed", "cancelled")
    want = spark.createDataFrame([("s1", "f1"), ("s2", "f2"), ("s3", "f3")], "stage string, print string")
    have = spark.createDataFrame([("s1", "f1"), ("s2", "old")], "stage string, print string")
    assert {r.stage for r in platform.stale_stages(want, have, ["stage"], "print").collect()} == {"s2", "s3"}


def test_more_text(spark):
    row = spark.range(1).select(
        text.word_salad(F.lit("One. Two. Go on. Yes. No.")).alias("a"),
        text.word_salad(F.lit("This is a whole sentence. And here is one more of them.")).alias("b"),
        F.round(text.luminance(F.lit("#ffffff"))).alias("c"),
        text.sentence_case(F.lit("THE Annual NASA report")).alias("d"),
    ).first()
    assert tuple(row) == (True, False, 255.0, "THE annual NASA report")


def test_container_checks(spark):
    leaves = spark.createDataFrame(
        [
            ("d", 0, "Alpha", ["r", "f", "x0"], ["doc", "figure", "paragraph"]),
            ("d", 1, "Beta", ["r", "f", "x1"], ["doc", "figure", "caption"]),
            ("d", 2, "Gamma", ["r", "x2"], ["doc", "paragraph"]),
            ("d", 3, "One", ["r", "l", "i1", "x3"], ["doc", "list", "item", "paragraph"]),
            ("d", 4, "Inner", ["r", "l", "i1", "m", "j1", "x4"], ["doc", "list", "item", "list", "item", "paragraph"]),
            ("d", 5, "Two", ["r", "l", "i2", "x5"], ["doc", "list", "item", "paragraph"]),
        ],
        "doc_id string, ord int, text string, path array<string>, kinds array<string>",
    )
    asked = [
        ("in_figure", ["alpha", "beta"], True), ("in_figure", ["alpha", "gamma"], False), ("not_in_figure", ["gamma"], True), ("not_in_figure", ["beta"], False), ("not_in_figure", ["nowhere"], False),
        ("list", ["One", "Inner", "Two"], True), ("list", ["Two", "One"], False), ("list", ["One"], True), ("not_list", ["Gamma"], True), ("not_list", ["Two"], False),
        ("nested", ["One", "Inner"], True), ("nested", ["Two", "Inner"], False),
    ]
    df = spark.createDataFrame([(k, "d", kind, args) for k, (kind, args, _) in enumerate(asked)], "check_id int, doc_id string, kind string, args array<string>")
    assert {r.check_id: r.passed for r in checks.container_results(df, leaves).collect()} == {k: ok for k, (_, _, ok) in enumerate(asked)}


def test_terms_and_usage(spark):
    terms = spark.createDataFrame([("NASA", 1, "b"), ("NASA", 2, "a"), ("Nasa", 2, "c"), ("nasa", 3, "d")], "term string, page int, example string")
    assert tuple(logs.term_stats(terms, "term", "page", "example").first()) == ("nasa", 4, "NASA", 3, ["a", "b", "c"])
    calls = spark.createDataFrame([("x", 5, 0.5), ("x", 7, None), ("y", 1, 0.25)], "kind string, tokens int, cost double")
    assert sorted(map(tuple, logs.usage_summary(calls, "kind", "tokens", "cost").collect())) == [("x", 2, 12, 0.5, False), ("y", 1, 1, 0.25, True)]


def test_attribute_and_cell_checks(spark):
    nodes = spark.createDataFrame([("d", "n1", "Figure one", {"float": "left", "cols": "3"}), ("d", "n2", None, {"float": "right"})], "doc_id string, nid string, text string, attrs map<string,string>")
    asked = spark.createDataFrame([(1, "d", "n2", {"float": "right"}), (2, "d", "Figure", {"float": "left", "cols": "3"}), (3, "d", "Figure", {"float": "right"}), (4, "e", "n1", {"float": "left"})], "check_id int, doc_id string, anchor string, wanted map<string,string>")
    assert {r.check_id: r.passed for r in checks.attribute_results(asked, nodes).collect()} == {1: True, 2: True, 3: False, 4: False}
    rows = spark.createDataFrame([("d", ["Year 2020", "10", None]), ("d", [])], "doc_id string, cells array<string>")
    asked = spark.createDataFrame([(1, "d", ["Year", "10"]), (2, "d", ["10"]), (3, "d", ["Year", "10", "x"])], "check_id int, doc_id string, args array<string>")
    assert {r.check_id: r.passed for r in checks.cell_results(asked, rows).collect()} == {1: True, 2: False, 3: False}


def test_paths_of_any_depth_and_without_a_root(spark):
    rows = [(str(k), str(k - 1) if k else None) for k in range(101)] + [("lost", "nowhere"), ("x", "y"), ("y", "x"), ("z", "y")]
    nodes = spark.createDataFrame(rows, "nid string, parent string")
    paths = tree.with_paths(nodes)
    got = {r.nid: (r.depth, list(r.path)) for r in paths.collect()}
    assert got == {str(k): (k, [str(i) for i in range(k + 1)]) for k in range(101)}
    assert sorted(r.nid for r in tree.unreached(nodes, paths).collect()) == ["lost", "x", "y", "z"]
    assert tree.with_paths(nodes.limit(0)).count() == 0
