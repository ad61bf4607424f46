"""Contents lists, definition lists, continued lists, growing figures and settings against plain folds."""

import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from leafloom import catalogue, catalogue_layout
from leafloom.operators import contents, figures, layout, lists, settings

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- contents

NUMBER, CHAPTER = r"^((?:[0-9]+\.)*[0-9]+)\.?\s+", r"(?i)^(chapter|part|section|appendix)\s+[0-9ivxlc]+\b[:.]?\s*"


def key_of(title):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", re.sub(CHAPTER, "", re.sub(NUMBER, "", title.lower())))).strip()


def naive_contents(lines):
    lines = sorted(((x, y, t.strip()) for x, y, t in lines if t and t.strip()), key=lambda r: (-r[1], r[0], r[2]))
    alone = [{"y": y, "t": t} for _, y, t in lines if re.fullmatch("0?[0-9]{1,3}", t)]
    out = []
    for x, y, t in lines:
        if re.fullmatch("0?[0-9]{1,3}", t):
            continue
        page, body = None, t
        lead, tail = re.match(r"^\s*(0?[0-9]{1,3})\s+(.+)", t), re.search(r"(?i)(?:[\s.·•…\-—_]*\b([0-9]{1,4})|[.·•…]{2,}\s*\b([ivxlcdm]{1,7}))\s*$", t)
        if lead and lead[2][0].isupper():
            page, body = lead[1], lead[2].strip()
        elif tail:
            page, body = tail[1] or tail[2], t[: tail.start()].strip()
        body = re.sub(r"^[\s.·•…\-–—_]+", "", re.sub(r"(\s*[.·•…]){2,}\s*$", "", body)).strip()
        if len(key_of(body)) < 2 or key_of(body) in ("contents", "table of contents"):
            continue
        if page is None:
            near = sorted((abs(a["y"] - y), k) for k, a in enumerate(alone) if "used" not in a and abs(a["y"] - y) < 6)
            if near:
                page = alone[near[0][1]]["t"]
                alone[near[0][1]]["used"] = True
        first = next((c for c in body if c.isalpha()), "")
        if out and (first.islower() or (page is None and out[-1]["page"])):
            out[-1]["title"] = f"{out[-1]['title']} {body}".strip()
            out[-1]["page"] = out[-1]["page"] or page
        else:
            out.append({"title": body, "page": page, "x": x})
    depth = lambda e: (m := re.match(NUMBER, e["title"])) and "." in m[1] and m[1].count(".") + 1
    steps = []
    for x in sorted({round(e["x"], 1) for e in out if not depth(e)}):
        if not steps or x - steps[-1] > 8:
            steps.append(x)
    for e in out:
        e["level"] = None
        if not depth(e):
            if len(steps) >= 2 and steps[-1] - steps[0] >= 8:
                e["level"] = min(max([1] + [k + 1 for k, s in enumerate(steps) if e["x"] >= s - 4]), 6)
            elif re.match(CHAPTER, e["title"]):
                e["level"] = 1
    deepest = max((e["level"] for e in out if e["level"]), default=1)
    for e in out:
        if depth(e):
            e["level"] = min(deepest + depth(e) - 1, 6)
    return [(k, e["title"], e["page"], e["level"], key_of(e["title"])) for k, e in enumerate(out)]


def test_contents_query_against_a_plain_fold(spark):
    docs = {}
    for r in catalogue_layout.contents_lines(spark, DATA).collect():
        docs.setdefault(r.doc_id, []).append((r.x, r.y, r.text))
    want = sorted(((d, *e) for d, held in docs.items() for e in naive_contents(held)), key=repr)
    assert rows_of(catalogue.QUERIES["contents_entries"](spark, DATA)) == want
    assert {e[4] for e in want} >= {None, 1, 2, 3}


def test_contents_edges(spark):
    schema = "d int, x double, y double, t string"
    rows = [(1, 10.0, 100.0, "Contents"), (1, 10.0, 90.0, "Chapter 1: Start ..... 5"), (1, 10.0, 80.0, "1.1 Deeper"), (1, 90.0, 78.0, "7"), (1, 10.0, 70.0, "and more"), (1, 10.0, 60.0, None), (1, None, 50.0, "Lost 9"), (None, 1.0, 1.0, "Lost 9"), (2, 1.0, 1.0, "12")]
    got = rows_of(contents.parsed(spark.createDataFrame(rows, schema), "d", "x", "y", "t"))
    assert got == [(1, 0, "Chapter 1: Start", "5", 1, "start"), (1, 1, "1.1 Deeper and more", "7", 2, "deeper and more")]
    assert contents.parsed(spark.createDataFrame([], schema), "d", "x", "y", "t").count() == 0


# -- lists


def naive_definitions(nodes):
    out, i = [], 0
    while i < len(nodes):
        head, i = nodes[i], i + 1
        if head.kind != "heading" or not re.search(r"(?i)\b(key terms|glossary|definitions)\b", head.text or ""):
            continue
        pairs, j = [], i
        while j + 1 < len(nodes):
            t, d = nodes[j], nodes[j + 1]
            said = (t.text or "").strip()
            if t.kind not in ("heading", "paragraph") or not 0 < len(said) <= 60 or re.fullmatch(r"(?i)(?:end\s*)?notes?|references|sources", said) or d.kind != "paragraph" or (d.text or "").startswith("»") or (pairs and t.style != pairs[0][0].style):
                break
            pairs.append((t, d))
            j += 2
        if len(pairs) >= 3:
            out += [(head.ord, t.ord, d.ord) for t, d in pairs]
            i = j
    return out


def by_doc(df):
    docs = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.ord)):
        docs.setdefault(r.doc_id, []).append(r)
    return docs


def test_definition_lists_query_against_a_plain_fold(spark):
    want = sorted(((d, *p) for d, held in by_doc(catalogue_layout.listed_nodes(spark, DATA)).items() for p in naive_definitions(held)), key=repr)
    assert rows_of(catalogue.QUERIES["definition_lists"](spark, DATA)) == want and want


def test_continuations_query_against_a_plain_fold(spark):
    want = []
    for d, held in by_doc(catalogue_layout.listed_nodes(spark, DATA)).items():
        for a, b in zip(held, held[1:]):
            if a.kind != "list" or b.kind != "paragraph" or not a.items:
                continue
            n, k, marks = a.start + a["items"], 1 + a.subs, []
            for m in re.finditer(r"(?:^|(?<=\s))(\d{1,2}|[a-z])[.)]\s*", b.text):
                if m[1].isdigit() and int(m[1]) == n:
                    marks.append((m, "item", n))
                    n, k = n + 1, 1
                elif not m[1].isdigit() and ord(m[1]) == 96 + k:
                    marks.append((m, "sub", k))
                    k += 1
            if len(marks) > 1 and not b.text[: marks[0][0].start()].strip():
                stops = [m.start() for m, *_ in marks[1:]] + [len(b.text)]
                want += [(d, b.ord, a.ord, i, kind, no, b.text[m.end() : stop].strip()) for i, ((m, kind, no), stop) in enumerate(zip(marks, stops))]
    assert rows_of(catalogue.QUERIES["list_continuations"](spark, DATA)) == sorted(want, key=repr) and want


def test_lists_edges(spark):
    schema = "doc_id int, ord int, kind string, text string, style string, start int, items int, subs int"
    rows = [(1, 0, "heading", "Glossary", None, None, None, None), *[(1, k, "paragraph", "term" if k % 2 else "what it is", None, None, None, None) for k in range(1, 7)], (1, 7, "list", None, None, None, 2, None), (1, 8, "paragraph", "3. c 4. d", None, None, None, None), (1, 9, "list", None, None, 5, 0, 0), (1, 10, "paragraph", None, None, None, None, None), (None, 1, "list", None, None, 1, 1, 0), (2, 1, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert rows_of(lists.definition_lists(df, "doc_id", "ord")) == [(1, 0, 1, 2), (1, 0, 3, 4), (1, 0, 5, 6)]
    assert rows_of(lists.list_continuations(df, "doc_id", "ord")) == [(1, 8, 7, 0, "item", 3, "c"), (1, 8, 7, 1, "item", 4, "d")]
    assert lists.definition_lists(df.limit(0), "doc_id", "ord").count() == 0 and lists.list_continuations(df.limit(0), "doc_id", "ord").count() == 0


def test_lists_over_columns_query_against_a_plain_fold(spark):
    nodes, model = catalogue_layout.gutter_lists(spark, DATA)
    bands = {}
    for r in model.collect():
        bands.setdefault((r.doc_id, r.page), []).append(r)
    pages = {}
    for r in nodes.collect():
        pages.setdefault((r.doc_id, r.page), []).append(r)

    def at(page, n):
        held = sorted(bands.get(page, ()), key=lambda b: b.band)
        best = max(held, key=lambda b: max(0, min(n.t, b.y1) - max(n.b, b.y0)), default=None)
        if best is None or min(n.t, best.y1) - max(n.b, best.y0) <= 0 or len(best.cols) < 2:
            return None
        return best.band, max(range(len(best.cols)), key=lambda c: max(0, min(n.r, best.cols[c].x1) - max(n.l, best.cols[c].x0))), best.y1

    want = []
    for page, held in pages.items():
        before = first = None
        for n in sorted(held, key=lambda n: n.place):
            goes = before is not None and before.kind == n.kind == "list" and before.ordered is None and n.ordered is None and (a := at(page, before)) and (b := at(page, n)) and a[0] == b[0] and b[1] == a[1] + 1 and n.t >= b[2] - 15
            first = first if goes else n.block
            if goes:
                want.append((*page, n.block, first))
            before = n
    assert rows_of(catalogue.QUERIES["lists_over_columns"](spark, DATA)) == sorted(want, key=repr) and want
    assert lists.lists_over_columns(nodes.limit(0), model, ["doc_id", "page"], "block", "place").count() == 0


# -- figures


def naive_growth(regions, blocks):
    regions, taken = [list(r) for r in regions], {}
    for _ in range(8):
        before = len(taken)
        for k, (l, b, r, t) in enumerate(blocks):
            if k in taken:
                continue
            gaps = [max(x[0] - r, l - x[2], x[1] - t, b - x[3], 0) for x in regions]
            best = min(range(len(regions)), key=lambda i: gaps[i])
            if gaps[best] <= 28:
                x = regions[best]
                regions[best], taken[k] = [min(x[0], l), min(x[1], b), max(x[2], r), max(x[3], t)], best
        if len(taken) == before:
            break
    return regions, [taken.get(k) for k in range(len(blocks))]


def test_growth_against_brute_force():
    rnd = random.Random(9)
    box = lambda n: (l := rnd.uniform(0, n), b := rnd.uniform(0, n), l + rnd.uniform(1, 30), b + rnd.uniform(1, 30))
    for _ in range(200):
        regions, blocks = [box(300) for _ in range(rnd.randint(1, 4))], [box(400) for _ in range(rnd.randint(0, 40))]
        assert figures.grow(regions, blocks) == naive_growth(regions, blocks)


def test_growth_query_against_brute_force(spark):
    regions, blocks = catalogue_layout.charted_pages(spark, DATA)
    pages = {}
    for r in regions.where("paths >= 8").collect():
        pages.setdefault((r.doc_id, r.page), ([], []))[0].append(r)
    for r in blocks.where("label").collect():
        if (r.doc_id, r.page) in pages:
            pages[r.doc_id, r.page][1].append(r)
    want = []
    for page, (rs, bs) in pages.items():
        rs.sort(key=lambda r: str(r.region))
        bs.sort(key=lambda r: r.block)
        boxes, taken = naive_growth([(r.l, r.b, r.r, r.t) for r in rs], [(b.l, b.b, b.r, b.t) for b in bs])
        want += [(*page, r.region, *box, taken.count(k)) for k, (r, box) in enumerate(zip(rs, boxes))]
    got = rows_of(catalogue.QUERIES["grown_figures"](spark, DATA))
    assert got == sorted(want, key=repr) and sum(r[-1] for r in got) > 10
    boxes, taken = figures.grown(regions.limit(0), blocks.limit(0), ["doc_id", "page"], "region", "block")
    assert boxes.count() == 0 and taken.count() == 0


def test_label_shapes(spark):
    rows = [("2019", 10.0, False, True), ("A sentence that is long enough.", 10.0, False, False), ("Figure 3 shows", 8.0, False, False), ("Source: us", 8.0, False, False), ("Label", 14.0, False, False), ("Label", 10.0, True, False), ("x" * 50, 10.0, False, False), ("x" * 50, 8.0, False, True), (None, 10.0, None, True), ("Label", None, False, False)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, s double, n boolean, want boolean")
    assert all(r.got == r.want for r in df.select("want", figures.label_shaped(F.col("t"), F.array("t"), F.col("s"), F.lit(10.0), F.col("n")).alias("got")).collect())


# -- settings


def merged(base, over):
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def flat(value, path=()):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in flat(v, (*path, k))]
    return [("/".join(path), json.dumps(value, ensure_ascii=False, sort_keys=True))]


def settled(layers):
    out = {}
    for _, t in sorted(layers):
        try:
            v = json.loads(t)
        except ValueError:
            continue
        out = merged(out, v) if isinstance(v, dict) else out
    return flat(out)


def test_settings_query_against_recursive_merge(spark):
    held = {}
    for r in catalogue_layout.setting_layers(spark, DATA).collect():
        held.setdefault(r.c_custkey, []).append((r.layer, r.text))
    want = sorted((k, *leaf) for k, layers in held.items() for leaf in settled(layers))
    got = catalogue.QUERIES["layered_settings"](spark, DATA)
    assert sorted(tuple(r)[:3] for r in got.where("value IS NOT NULL").collect()) == want
    bad = sorted((k, n) for k, layers in held.items() for n, t in layers if t[0] != "{" or t == "{broken")
    assert sorted((r.c_custkey, r.layer) for r in got.where("value IS NULL").collect()) == bad and bad


def test_settings_of_random_objects(spark):
    rnd = random.Random(12)

    def made(depth=0):
        if depth > 2 or rnd.random() < 0.3:
            return rnd.choice([1, "x", None, [1, {"a": 2}], {}, True])
        return {k: made(depth + 1) for k in rnd.sample("abc", rnd.randint(0, 3))}

    rows = [(k, n, json.dumps(v if isinstance(v := made(), dict) else {"a": v})) for k in range(150) for n in range(rnd.randint(1, 4))]
    held = {}
    for k, n, t in rows:
        held.setdefault(k, []).append((n, t))
    kept, bad = settings.layered(spark.createDataFrame(rows + [(900, 1, None), (None, 1, "{}"), (1, None, '{"z": 1}')], "k int, n int, t string"), "k", "n", "t")
    want = sorted((k, *leaf) for k, layers in held.items() for leaf in settled(layers))
    assert sorted(tuple(r)[:3] for r in kept.collect()) == want
    assert rows_of(bad) == [(900, 1)]
    assert settings.layered(kept.select(F.lit(1).alias("k"), F.lit(1).alias("n"), F.lit("{}").alias("t")).limit(0), "k", "n", "t")[0].count() == 0


def test_settings_are_laid_in_one_pass(spark):
    rows = [(1, 2, '{"a": {}, "b": 1}'), (1, 1, '{"a": {"x": 1}, "b": {"y": 2}}'), (1, 3, "[1]"), (1, 3, "nothing"), (1, 4, '{"b": {}, "c": {}}'), (1, 5, '{"c": {}}'), (2, 1, "{}"), (2, 2, "{}"), (3, 1, None)]
    df = spark.createDataFrame(rows, "k int, n int, t string")
    laid = settings.laid_over(df, "k", "n", "t")
    assert rows_of(laid) == [(1, "", None, 3), (1, "a/x", "1", 1), (1, "b", "{}", 4), (1, "c", "{}", 5), (2, "", "{}", 2), (3, "", None, 1)]
    # every layer is dealt out once: nothing is joined to itself, however many layers there are
    plan = catalogue.QUERIES["layered_settings"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1


@pytest.mark.parametrize("text, values, want", [("a var(--x) b", {"--x": "1"}, ("a 1 b", 1, False)), ("var( --x , var(--y, 2) )", {}, ("2", 2, False)), ("var(--x)", {"--x": "var(--x) "}, ("var(--x)     ", 5, True)), ("var(--x)", {"--x": ""}, ("", 1, False)), (None, {"--x": "1"}, (None, 0, False)), ("none", None, ("none", 0, False)), ("var(--a)var(--b)", {"--a": "var(--b)", "--b": "v"}, ("vv", 2, False))])
def test_named_values(spark, text, values, want):
    df = spark.createDataFrame([(text, values)], "t string, v map<string,string>")
    assert tuple(settings.with_values(df, "t", "v", "out").select("out", "rounds_", "open_").first()) == want


def test_tokens(spark):
    df = spark.createDataFrame([("{a}{b} {c", {"a": "{b}", "b": "1"}), ("{x}", None), (None, {"a": "1"}), ("", {})], "t string, m map<string,string>")
    assert [r.o for r in df.select(settings.interpolated(F.col("t"), F.col("m")).alias("o")).collect()] == ["{b}1 {c", "{x}", None, ""]
