"""Layout, notes and references against brute force; nulls, ties, repeats, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from leafloom import catalogue, catalogue_layout
from leafloom.operators import layout, notes

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- reading order


def naive_order(boxes):
    def crosses(w, i, j):
        return boxes[w][0] < boxes[i][2] and boxes[w][2] > boxes[j][0] and boxes[w][1] < max(boxes[i][3], boxes[j][3]) and boxes[w][3] > min(boxes[i][1], boxes[j][1])

    n = len(boxes)
    first = set()
    for i in range(n):
        for j in range(n):
            a, b = boxes[i], boxes[j]
            if i == j:
                continue
            if a[0] < b[2] and a[2] > b[0]:
                if a[3] > b[3]:
                    first.add((i, j))
            elif a[2] <= b[0] and not any(crosses(w, i, j) for w in range(n) if w not in (i, j)):
                first.add((i, j))
    left, out = set(range(n)), []
    while left:
        free = [k for k in left if not any((i, k) in first for i in left)]
        k = min(free or left, key=lambda k: (-boxes[k][3], boxes[k][0], k))
        out.append((k, not free))
        left.discard(k)
    return out


def test_topological_order_against_brute_force(spark):
    rnd = random.Random(4)
    pages = []
    for p in range(40):
        spread = rnd.choice([12, 60, 400])
        pages.append([(float(l := rnd.randint(0, spread)), float(b := rnd.randint(0, spread)), float(l + rnd.randint(1, spread)), float(b + rnd.randint(1, 40))) for _ in range(rnd.randint(1, 14))])
    for boxes in pages:
        assert layout.topological(boxes) == naive_order(boxes)
    rows = [(p, k, *box) for p, boxes in enumerate(pages) for k, box in enumerate(boxes)]
    df = spark.createDataFrame(rows + [(None, 1, 0.0, 0.0, 1.0, 1.0), (3, 99, None, 0.0, 1.0, 1.0)], "page int, block int, l double, b double, r double, t double")
    want = [(p, k, place, forced) for p, boxes in enumerate(pages) for place, (k, forced) in enumerate(naive_order(boxes))]
    assert rows_of(layout.topological_order(df, ["page"], "block")) == sorted(want, key=repr)


def test_topological_order_query(spark):
    lines, _ = catalogue_layout.placed(spark, DATA)
    pages = {}
    for r in lines.collect():
        pages.setdefault((r.doc_id, r.page), []).append((r.ord, r.l, r.b, r.r, r.t))
    want = []
    for key, held in pages.items():
        held.sort()
        want += [(*key, held[k][0], place, forced) for place, (k, forced) in enumerate(naive_order([h[1:] for h in held]))]
    assert rows_of(catalogue.QUERIES["topological_order"](spark, DATA)) == sorted(want, key=repr)


def test_modelled_order_reads_columns_and_splitters(spark):
    # a heading over two columns, and a figure over both in their middle
    blocks = [(1, "head", 0.0, 700.0, 500.0, 720.0), (1, "a", 0.0, 400.0, 220.0, 680.0), (1, "b", 0.0, 100.0, 220.0, 280.0), (1, "c", 280.0, 400.0, 500.0, 680.0), (1, "d", 280.0, 100.0, 500.0, 280.0), (1, "fig", 120.0, 300.0, 390.0, 380.0)]
    lines = [(1, name, l, b + 10 * k, r, b + 10 * k + 8) for name, l, b, r, _ in ((x[1], *x[2:]) for x in blocks if x[1] in "abcd") for k in range(6)]
    df = spark.createDataFrame(blocks, "page int, block string, l double, b double, r double, t double")
    ls = spark.createDataFrame(lines, df.schema)
    model = layout.column_model(df, ls, ["page"], "block")
    assert [([tuple(c) for c in r.cols], r.gutters, r.bridged, r.n_cols, r.conf) for r in model.collect() if r.n_lines] == [([(0.0, 220.0), (280.0, 500.0)], [60.0], 0, 2, 1.0)]
    order = [r.block for r in layout.modelled_order(df, model, ["page"], "block").orderBy("place").collect()]
    assert order == ["head", "a", "c", "fig", "b", "d"]


def test_column_model_edges(spark):
    schema = "page int, block int, l double, b double, r double, t double"
    lone = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (2, 1, None, 0.0, 1.0, 1.0), (2, 2, 0.0, 0.0, 1.0, 1.0), (None, 1, 0.0, 0.0, 1.0, 1.0)], schema)
    assert layout.column_model(lone, lone, ["page"], "block").count() == 0
    empty = spark.createDataFrame([], schema)
    model = layout.column_model(empty, empty, ["page"], "block")
    assert model.count() == 0 and layout.modelled_order(empty, model, ["page"], "block").count() == 0
    twins = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0)] * 3, schema)
    assert layout.column_model(twins, twins, ["page"], "block").count() == 1


# -- tables


def naive_tables(regions, marks, blocks):
    cells, told = [], []
    for page, region, l0, b0, r0, t0, strict in regions:
        own = sorted((b for b in blocks if b[:2] == (page, region)), key=lambda b: (-b[6], b[2]))
        near = [m for m in marks if m[0] == page and m[1] >= l0 - 5 and m[3] <= r0 + 5 and m[2] >= b0 - 5 and m[4] <= t0 + 5]
        rules = [m for m in near if m[4] - m[2] < 3 and m[3] - m[1] > 30]
        posts = [m for m in near if m not in rules and m[3] - m[1] < 3 and m[4] - m[2] > 10]
        fills = [m for m in near if m not in rules and m not in posts and m[5] and m[3] - m[1] > 10 and m[4] - m[2] > 8]
        say = lambda why, c=0, r=0: told.append((page, region, len(own), len(rules), len(posts), c, r, why))  # noqa: E731, B023
        if len(own) < 4:
            say("too-few-blocks")
            continue
        if len(rules) < 3 or len(posts) < 2:
            say("no-grid")
            continue
        groups = []
        for x in sorted([(m[1] + m[3]) / 2 for m in posts] + [x for m in fills for x in (m[1], m[3])]):
            if l0 + 8 <= x <= r0 - 8:
                if groups and x - groups[-1][-1] < 6:
                    groups[-1].append(x)
                else:
                    groups.append([x])
        inner = [sum(g) / len(g) for g in groups]
        if not inner:
            mids = sorted((b[3] + b[5]) / 2 for b in own)
            inner = [(a + b) / 2 for a, b in zip(mids, mids[1:]) if b - a > 50]
        edges = [l0, *inner, r0]
        cols = list(zip(edges, edges[1:]))
        if len(cols) < 2:
            say("no-columns", 1)
            continue
        grid, row, low = {}, -1, None
        for _, _, _, l, b, r, t, text, parts in own:
            over = [c for c, (x0, x1) in enumerate(cols) if min(r, x1) - max(l, x0) > 4]
            away = lambda c: (abs(sum(cols[c]) / 2 - (l + r) / 2), c)  # noqa: E731, B023
            if not over:
                over = [min(range(len(cols)), key=away)]
            elif len(over) > 1 and r - l < 0.5 * (cols[over[-1]][1] - cols[over[0]][0]):
                over = [min(over, key=away)]
            if low is None or t <= low:
                row += 1
            low = b if low is None else min(low, b)
            pieces = [(c, 1, p) for c, p in zip(over, parts)] if len(over) > 1 and len(parts) == len(over) else [(over[0], len(over), text)]
            for c, span, p in pieces:
                grid.setdefault((row, c), []).append((span, p))
        n_rows = row + 1
        filled = sum(any(p.strip() for _, p in v) for v in grid.values())
        if n_rows < 2:
            say("too-few-rows", len(cols), n_rows)
        elif strict and (n_rows < 3 or filled < 0.6 * n_rows * len(cols)):
            say("strict-sparse", len(cols), n_rows)
        else:
            say("table", len(cols), n_rows)
            cells += [(page, region, r, c, max(s for s, _ in v), " ".join(p for _, p in v if p)) for (r, c), v in grid.items()]
    return sorted(cells, key=repr), sorted(told, key=repr)


def test_tables_query_against_brute_force(spark):
    parts = catalogue_layout.drawn_tables(spark, DATA)
    order = (["page", "region", "l", "b", "r", "t", "strict"], ["page", "l", "b", "r", "t", "filled"], ["page", "region", "block", "l", "b", "r", "t", "text", "parts"])
    cells, told = naive_tables(*[list(map(tuple, df.select(*c).collect())) for df, c in zip(parts, order)])
    got, why = layout.table_grids(*parts, "page", "region", "block")
    assert rows_of(why) == told and len({t[-1] for t in told}) >= 4
    assert rows_of(got) == cells
    refused = [(p, r, -1, -1, 0, w) for p, r, *_, w in told if w != "table"]
    assert rows_of(catalogue.QUERIES["table_cells"](spark, DATA)) == sorted(cells + refused, key=repr)


def test_tables_of_nothing(spark):
    box = "l double, b double, r double, t double"
    regions = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0, None), (1, 2, None, 0.0, 1.0, 1.0, True)], f"page int, region int, {box}, strict boolean")
    marks = spark.createDataFrame([], f"page int, {box}, filled boolean")
    blocks = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 1.0, 1.0, None, None)] * 5, f"page int, region int, block int, {box}, text string, parts array<string>")
    cells, told = layout.table_grids(regions, marks, blocks, "page", "region", "block")
    assert cells.count() == 0 and rows_of(told) == [(1, 1, 5, 0, 0, 0, 0, "no-grid")]
    assert layout.table_grids(regions.limit(0), marks, blocks.limit(0), "page", "region", "block")[1].count() == 0


# -- notes


def naive_notes(frags):
    """frags: (page, block, n, raw, text); texts are built as they are read."""
    made, folds, last, last_page, now, wait, block, seen = [], [], None, None, None, [], object(), False

    def fold():
        for _, t in wait:
            if now is not None:
                now["text"].append(t)
        wait.clear()

    for k, (page, of, n, raw, text) in enumerate(frags):
        if of != block:
            fold()
            block, seen = of, False
        if n is None:
            if not seen:
                wait.append((page, text))
            elif now is not None:
                now["text"].append(text)
            continue
        nxt = next((f[2] for f in frags[k + 1 :] if f[2] is not None), None)
        if last is None:
            ok = True
        elif n <= last:
            ok = page != last_page
        else:
            ok = n - last <= 3 or nxt is None or not (0 < nxt - last <= 3)
        seen = True
        if ok:
            if wait and (n == 2 if last is None else last == n - 2):
                now = {"n": n - 1, "m": str(n - 1), "page": wait[0][0], "text": [t for _, t in wait], "how": "inferred"}
                made.append(now)
                wait.clear()
            fold()
            now = {"n": n, "m": raw, "page": page, "text": [text], "how": "read"}
            made.append(now)
            last, last_page = n, page
        else:
            fold()
            if now is not None:
                folds.append((now, len(now["text"]), raw, page))
                now["text"].append(f"{raw} {text}")
    fold()
    for note in list(made):
        mine = [f for f in folds if f[0] is note]
        want = note["n"] + 1
        if len(mine) == 1 and not any(x["n"] == want for x in made):
            _, at, raw, page = mine[0]
            if raw.isdigit() and len(raw) == len(str(want)) and sum(a != b for a, b in zip(raw, str(want))) == 1:
                tail = " ".join(note["text"][at:])[len(raw) :].lstrip(".) ").strip()
                if tail:
                    rest = note["text"][at:]
                    note["text"] = note["text"][:at]
                    made.insert(next(i for i, x in enumerate(made) if x is note) + 1, {"n": want, "m": str(want), "page": page, "text": [rest[0][len(raw) + 1 :], *rest[1:]], "how": "misread"})
    made.sort(key=lambda x: (x["page"], x["n"]))
    clean = lambda x: " ".join(x["text"]).strip() if x["how"] == "inferred" else " ".join(x["text"]).lstrip(".) ").strip()
    return [(k, x["n"], x["m"], x["page"], x["how"], clean(x)) for k, x in enumerate(made)]


def frags_of(spark, lines):
    """The same lines with the marker that line_marker() finds, by document."""
    out = {}
    marked = lines.withColumn("m", notes.line_marker(F.col("text"))).select("doc_id", "ord", "page", "block", "text", "m").collect()
    for r in sorted(marked, key=lambda r: (r.doc_id, r.ord)):
        out.setdefault(r.doc_id, []).append((r.page, r.block, r.m and r.m.n, r.m and r.m.raw, r.m.rest if r.m else r.text))
    return out


def test_notes_query_against_brute_force(spark):
    lines = catalogue_layout.note_lines(spark, DATA)
    want = sorted(((d, *n) for d, f in frags_of(spark, lines).items() for n in naive_notes(f)), key=repr)
    got = rows_of(catalogue.QUERIES["note_records"](spark, DATA).drop("n_lines"))
    assert got == want
    assert {n[5] for n in want} == {"read", "inferred", "misread"}


def test_notes_of_random_streams(spark):
    rnd = random.Random(8)
    lines = []
    for d in range(150):
        n = 1
        for o in range(rnd.randint(0, 25)):
            kind = rnd.random()
            text = rnd.choice(["alpha beta", ".", "", "Ünder way 2019", "tail )"])
            if kind < 0.6:
                shown = n if rnd.random() < 0.75 else rnd.choice([n + 1, n + 2, n + 50, max(1, n - 3), int(str(n)[:-1] + "7")])
                n += 1
                text = f"{shown}{rnd.choice(['. ', ') ', ' '])}x{text}"
            lines.append((d, o, o // rnd.choice([4, 9]), o // 3, text))
    df = spark.createDataFrame(lines, "doc_id int, ord int, page int, block int, text string")
    want = sorted(((d, *x) for d, f in frags_of(spark, df).items() for x in naive_notes(f)), key=repr)
    assert rows_of(notes.note_records(df, "doc_id", "ord", "page", "block", "text").drop("n_lines")) == want


def test_notes_edges(spark):
    schema = "doc_id int, ord int, page int, block int, text string"
    rows = [(1, 1, 1, 1, "1. a"), (1, 1, 1, 1, "1. a"), (1, 2, 1, 1, None), (1, None, 1, 1, "2. lost"), (None, 1, 1, 1, "1. lost"), (2, 1, 1, 1, None)]
    got = rows_of(notes.note_records(spark.createDataFrame(rows, schema), "doc_id", "ord", "page", "block", "text"))
    assert got == [(1, 0, 1, "1", 1, "read", 1, "a"), (1, 1, 2, "2", 1, "misread", 2, "a")]  # the repeat differs in one digit from what is missing
    assert notes.note_records(spark.createDataFrame([], schema), "doc_id", "ord", "page", "block", "text").count() == 0


@pytest.mark.parametrize(
    "text, lead, want",
    [("12. See", None, (12, "12", "See", False)), ("12.5 per", None, None), ("b) See", None, (1002, "b", "See", False)), ("1 234", None, (1, "1", "234", False)), ("1234 x", None, None), ("iv Text", "iv", (4, "iv", " Text", True)), ("i i Text", "i i", (2, "ii", " Text", True)), ("", None, None), (None, None, None)],
)
def test_line_marker(spark, text, lead, want):
    got = spark.createDataFrame([(text, lead)], "t string, s string").select(notes.line_marker(F.col("t"), F.col("s")).alias("m")).first().m
    assert (got and tuple(got)) == want


def test_which_blocks_hold_notes(spark):
    schema = "d int, k int, lines array<string>, text string, size double, body double, foot boolean"
    block = lambda k, lines, size=10.0, foot=False, d=1: (d, k, lines, " ".join(lines), size, 10.0, foot)
    rows = [
        block(0, ["Plain text"]),
        block(1, ["1 Items of a list"]),
        block(2, ["Notes"]),
        block(3, ["1 First note", "more"]),
        block(4, ["and on"]),
        block(5, ["New Text"]),
        block(6, ["3 At the foot"], 8.0, True),
        block(7, ["4 Not at the foot"], 8.0),
        block(8, ["5 Cited 2019"], 8.0),
        *[block(k, [f"{k}. Cited {2000 + k}"], d=2) for k in range(1, 6)],
        *[block(k, [f"{k}. Item"], d=3) for k in range(1, 6)],
        (4, 1, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    assert rows_of(notes.note_blocks(df, "d", "k")) == [(1, 3), (1, 4), (1, 6), (1, 8), *((2, k) for k in range(1, 6))]
    assert notes.note_blocks(df.limit(0), "d", "k").count() == 0


# -- references


def test_references_edges(spark):
    refs = spark.createDataFrame([(1, 1, 5, 3), (1, 2, 5, None), (1, 3, 9, 1), (1, 4, None, 1), (1, 5, 5, 5), (2, 1, 5, 7)], "d int, ref int, n int, page int")
    held = spark.createDataFrame([(1, 2, 5), (1, 8, 5), (1, 2, 5), (2, None, 5), (1, 1, None)], "d int, page int, n int")
    out = notes.resolved_references(refs, held, "d", "ref")
    assert rows_of(out.select("d", "ref", "target", "reason")) == [(1, 1, "2-5", "nearest"), (1, 2, "2-5", "first"), (1, 3, None, "no note"), (1, 4, None, "no note"), (1, 5, "2-5", "nearest"), (2, 1, "5", "only")]
    assert rows_of(notes.back_references(out, held, "d")) == [(1, "2-5", 5, 2, 3, 1), (1, "8-5", 5, 8, 0, None), (2, "5", 5, None, 1, 1)]
    assert notes.resolved_references(refs, held.limit(0), "d", "ref").where("target IS NOT NULL").count() == 0
    assert notes.resolved_references(refs.limit(0), held, "d", "ref").count() == 0


def test_anchors_edges(spark):
    targets = spark.createDataFrame([(1, "a", "Methods and Data"), (1, "b", "Methods"), (1, "c", "Results for 2019"), (1, "d", "Results for 2020"), (1, "e", None), (2, "z", "Methods and Data")], "d int, t string, title string")
    asked = spark.createDataFrame([(1, 1, "Methods and data."), (1, 2, "Methods an"), (1, 3, "Results for"), (1, 4, "short"), (1, 5, "Unknown heading"), (1, 6, None), (3, 7, "Methods and Data"), (1, 8, "Methods and Data")], "d int, k int, text string")
    got = {r.anchor: (r.target, r.reason) for r in notes.resolved_anchors(asked, targets, "d", "k", "text", "t", "title").collect()}
    assert got == {1: ("a", "exact"), 2: (None, "several"), 3: (None, "several"), 4: (None, "short"), 5: (None, "unknown"), 6: (None, "short"), 7: (None, "unknown"), 8: ("a", "exact")}
