"""Operators on small fixtures, ties and empty inputs included."""

import json

from pyspark.sql import functions as F

from leafloom import functions, sources
from leafloom.operators import checks, detectors, geometry, logs, match, platform, sequence, text, tree, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_latest_takes_the_later_line_of_equal_times(spark):
    log = spark.createDataFrame([("d", "p", "accept", "t1", 1), ("d", "p", "reject", "t1", 2), ("d", "q", "accept", "t2", 3), ("d", None, "accept", "t9", 4)], "doc string, id string, decision string, at string, line int")
    assert sorted(map(tuple, logs.latest(log, ["doc", "id"], "at", "line").select("id", "decision").collect())) == [("p", "reject"), ("q", "accept")]
    assert [(r.id, r.decisions, r.latest) for r in logs.conflicts(log.where("id IS NOT NULL"), ["id"], "decision", "at", "line").collect()] == [("p", ["accept", "reject"], "reject")]
    assert logs.latest(log.limit(0), ["doc", "id"], "at", "line").count() == 0


def test_text_expressions(spark):
    assert one(spark, text.clean_quote(F.lit("  a \n b  "))) == "a b"
    assert one(spark, text.clean_quote(F.lit("x" * 300), 20)) == "x" * 19 + "..."
    assert one(spark, text.tokens(F.lit("The cat, the CAT is on 123"))) == ["the", "cat", "123"]
    assert sorted(["p10", "p9", "p1"], key=lambda x: one(spark, text.natural_key(F.lit(x)))) == ["p1", "p9", "p10"]


def test_matching(spark):
    left = spark.createDataFrame([(1, "red fox runs"), (2, "zzz")], "a long, text string")
    right = spark.createDataFrame([(7, "red fox runs far"), (5, "red fox runs far"), (6, "blue sea")], "b long, text string")
    assert [tuple(r) for r in match.best_overlap(left, right, "a", "b").collect()] == [(1, 5, 0.75)]
    found = match.fuzzy_remap(left.withColumn("k", F.lit(1)), right.withColumn("k", F.lit(1)), ["k"], "a", "b", "text")
    assert [(r.a, r.b) for r in found.collect()] == [(1, 5)]
    state = match.reconcile(left.select(F.col("a").alias("k")), right.select((F.col("b") - 5).alias("k")), "k")
    assert sorted(map(tuple, state.collect())) == [(0, "right_only"), (1, "both"), (2, "both")]


def test_windows(spark):
    spans = spark.createDataFrame([("d", 0, 5), ("d", 3, 8), ("d", 8, 9), ("d", 20, 21)], "k string, lo int, hi int")
    assert sorted(map(tuple, windows.merged_intervals(spans, "k", "lo", "hi").collect())) == [("d", 0, 9, 3), ("d", 20, 21, 1)]
    assert [tuple(r) for r in windows.interior_gaps(spans, "k", "lo", "hi").collect()] == [("d", 9, 20)]
    numbers = spark.createDataFrame([("d", x) for x in (8, 9, 10, 12, 12)], "k string, x int")
    assert windows.compressed_runs(numbers, "k", "x").first().runs == "8-10,12"
    sizes = spark.createDataFrame([("d", 10.0, 5), ("d", 12.0, 5), ("d", 30.0, 1)], "k string, s double, w int")
    assert tuple(windows.weighted_mode(sizes, "k", "s", "w").first()) == ("d", 10.0, 5)
    assert windows.least_of_share(sizes, "k", "s", "w", 0.99).first().s == 10.0


def test_tree(spark):
    nodes = spark.createDataFrame([("r", None, "R"), ("a", "r", "A"), ("b", "r", "B"), ("c", "a", None)], "nid string, parent string, label string")
    paths = tree.with_paths(nodes)
    assert {r.nid: r.depth for r in paths.collect()} == {"r": 0, "a": 1, "b": 1, "c": 2}
    assert {r.nid: r.text for r in tree.subtree(paths, "label").collect()} == {"r": "R A B", "a": "A", "b": "B"}


def test_layout():
    columns = [(0, 0, 40, 10), (60, 0, 100, 10), (0, 20, 40, 30), (60, 20, 100, 30)]
    assert geometry.cut(columns, 5) == [2, 0, 3, 1]
    header = [(0, 80, 100, 90), *columns]
    assert geometry.cut(header, 5) == [0, 3, 1, 4, 2]
    assert geometry.cut([(0, 0, 1, 1)], 5) == [0]


def test_notes():
    assert sequence.sequenced([1, 2, 3, 4]) == [1, 2, 3, 4]
    assert sequence.sequenced([1, 2, 9, 4]) == [1, 2, 3, 4]
    assert sequence.sequenced([1, 2, 1, 2]) == [1, 2, 1, 2]
    assert sequence.sequenced([1, None, 3]) == [1, None, 3]
    assert sequence.sequenced([7, 8, 9]) == [7, 8, 9]


def test_checks(spark):
    leaves = spark.createDataFrame([("d", 0, "Alpha heading", "heading"), ("d", 1, "Beta and gamma", "paragraph"), ("d", 2, "Delta", "paragraph")], "doc string, ord int, line string, leaf string")
    asked = [
        ("in_flow", ["beta"], True), ("in_flow", ["omega"], False), ("absent", ["omega"], True), ("absent", ["delta"], False),
        ("order", ["Alpha", "Delta"], True), ("order", ["Delta", "Alpha"], False), ("merge", ["beta", "gamma"], True), ("merge", ["alpha", "gamma"], False),
        ("split", ["alpha", "gamma"], True), ("split", ["beta", "gamma"], False), ("role", ["alpha", "heading"], True), ("role", ["beta", "heading"], False),
        ("freeze", ["Delta!"], True), ("freeze", ["Delt"], False),
    ]
    df = spark.createDataFrame([(k, "d", kind, args) for k, (kind, args, _) in enumerate(asked)], "check_id int, doc_id string, kind string, args array<string>")
    got = {r.check_id: r.passed for r in checks.results(df, leaves, "doc", "ord", "line", "leaf").collect()}
    assert got == {k: ok for k, (_, _, ok) in enumerate(asked)}


def test_detectors_keep_the_first_find(spark):
    lines = spark.createDataFrame([("d", 0, "See Section 5(a) and Section 5(a)."), ("d", 1, "Again Section 5(a)?"), ("d", 2, "Total budget: 40%"), ("d", 3, None)], "doc string, ord int, line string")
    found = {(r.pattern_type, r.value): r.ord for r in detectors.candidates(lines, "doc", "ord", "line").collect()}
    assert found[("legal_reference", "Section 5(a)")] == 0
    assert found[("statistic", "40%")] == 2 and found[("label_value", "40%")] == 2
    assert found[("question", "Again Section 5(a)?")] == 1


def test_platform(spark):
    grants = spark.createDataFrame([("w", "f", 1), ("w", "f", 9), ("w", "g", None), ("w", "g", 5)], "w string, f string, n int")
    assert sorted(map(tuple, platform.entitlements(grants, "w", "f", "n").collect())) == [("w", "f", 9), ("w", "g", None)]
    assert [one(spark, platform.retry_after(F.lit(n))) for n in (1, 2, 3)] == [30, 60, 120]
    rates = spark.createDataFrame([("m", 2.0, 10.0)], "model string, input_rate double, output_rate double")
    usage = spark.createDataFrame([("m", 1_000_000, 500_000), ("x", 1, 1)], "model string, input_tokens long, output_tokens long")
    assert {r.model: r.cost for r in platform.usage_cost(usage, rates, "model").collect()} == {"m": 7.0, "x": None}


def test_log_source_reports_bad_lines(spark, tmp_path):
    (tmp_path / "doc-1.jsonl").write_text(json.dumps({"document_id": "x", "decision": "accept"}) + "\n\nnot json\n" + json.dumps({"decision": "reject"}) + "\n")
    rows, errors = sources.read_log(spark, str(tmp_path), "document_id string, decision string")
    assert sorted((r.document_id, r.decision) for r in rows.collect()) == [("doc-1", "reject"), ("x", "accept")]
    assert [r.text for r in errors.collect()] == ["not json"]
    sources.append_log(spark.createDataFrame([("y", "accept")], "document_id string, decision string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    assert {r.slug for r in sources.list_documents(spark, str(tmp_path), "*.jsonl").collect()} == {"doc-1"}


def test_html_blocks_and_spans(spark):
    page = "<html><head><title>x</title></head><body><nav>menu</nav><h1>Title</h1><p>One<br>two<p>Three<script>no</script></body></html>"
    got = spark.createDataFrame([(page,), (None,)], "h string").select(functions.html_blocks("h").alias("b")).collect()
    assert [(x.tag, x.text) for x in got[0].b] == [("h1", "Title"), ("p", "One two"), ("p", "Three")] and got[1].b == []
    functions.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT start, end, value FROM find_spans('a1 b22', '[0-9]+')").collect()] == [(1, 2, "1"), (4, 6, "22")]
