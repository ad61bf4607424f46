"""Replay of edits, inline markup and flowing text against plain folds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafloom import catalogue, catalogue_layout
from leafloom.operators import edits, inline, vocabulary

DATA = "/root/testdata/sf0.001"


def number(raw):
    raw = (raw or "").strip()
    if re.fullmatch("[0-9]+", raw):
        return int(raw)
    return 1000 + ord(raw.lower()) - 96 if len(raw) == 1 and raw.isalpha() else None


def fold(nodes, log):
    """nodes: dicts; log: dicts; one document."""
    by = {n["nid"]: dict(n, refs=list(n["refs"]), edited=None) for n in nodes}
    records, faults = [], []
    cited = {r for n in nodes for r in n["refs"]}
    whole = [e for e in log if e["kind"] and e["seq"] is not None and (e["kind"] == "reorder" or e["nid"] is not None)]
    faults += [(e["seq"], e["kind"], e["nid"], "incomplete") for e in log if e not in whole]
    gone = set()
    for e in sorted(whole, key=lambda e: (e["seq"], e["nid"] or "", e["kind"])):
        kind, n = e["kind"], by.get(e["nid"])
        if kind in ("reorder", "merge"):
            continue
        if kind not in ("set-text", "set-level", "delete", "note", "ref"):
            faults.append((e["seq"], kind, e["nid"], "unknown kind"))
            continue
        if n is None:
            faults.append((e["seq"], kind, e["nid"], "node not found"))
            continue
        value = number(e["value"])
        fresh = kind == "ref" and value is not None and n["text0"] is not None and value not in cited
        if fresh:
            cited.add(value)
        if e["nid"] in gone:
            continue
        if kind == "delete":
            gone.add(e["nid"])
        elif kind == "note" and n["text"] is not None and value is not None:
            gone.add(e["nid"])
            records.append((n["page"], value, e["value"], n["text"]))
        elif kind == "ref" and n["text"] is not None and fresh:
            n["text"] += e["value"].strip()
            n["refs"].append(value)
        elif kind == "set-text" and n["text"] is not None:
            n.update(text=e["value"] or "", refs=[], edited="set-text")
        elif kind == "set-level" and re.fullmatch(r"-?\d+", e["value"] or ""):
            level = int(e["value"])
            if level <= 0 and n["kind"] == "heading":
                n.update(kind="paragraph", level=None)
            elif level > 0 and n["kind"] in ("heading", "paragraph"):
                if n["kind"] == "paragraph":
                    n["refs"] = []
                n.update(kind="heading", level=min(level, 6))
    dead = True
    while dead:
        dead = [k for k, n in by.items() if k not in gone and n["parent"] in gone]
        gone.update(dead)
    left = {k: n for k, n in by.items() if k not in gone}
    groups = {}
    for n in sorted(left.values(), key=lambda n: (n["place"], n["nid"])):
        groups.setdefault(n["parent"], []).append(n)
    orders = [e for e in sorted(whole, key=lambda e: e["seq"]) if e["kind"] == "reorder" and e["order"]]
    docs = [e for e in orders if e["page"] is None]
    for parent, held in groups.items():
        if docs:
            rank = {nid: k for k, nid in enumerate(docs[-1]["order"])}
            last, keys = -1, {}
            for k, n in enumerate(held):
                if n["nid"] in rank:
                    last = rank[n["nid"]]
                keys[n["nid"]] = (last, n["nid"] not in rank, k)
            before = {n["nid"]: held[k - 1]["nid"] if k else None for k, n in enumerate(held)}
            held.sort(key=lambda n: keys[n["nid"]])
            for k, n in enumerate(held):
                if (held[k - 1]["nid"] if k else None) != before[n["nid"]] and not n["edited"]:
                    n["edited"] = "reorder"
        for k, n in enumerate(held):
            n["place"] = k
    top = groups.get(None, [])
    for page in {e["page"] for e in orders} - {None}:
        rank = {nid: k for k, nid in enumerate([e for e in orders if e["page"] == page][-1]["order"])}
        slots = [k for k, n in enumerate(top) if n["page"] == page]
        for slot, n in zip(slots, sorted((top[k] for k in slots), key=lambda n: rank.get(n["nid"], 10**9))):
            n["slot"] = slot
    for n in top:
        n["place"] = n.pop("slot", n["place"])
    faults += [(e["seq"], "reorder", nid, "node not found") for e in orders for nid in e["order"] if nid not in left]
    for e in sorted((e for e in whole if e["kind"] == "merge"), key=lambda e: (e["seq"], e["nid"], e["other"] or "")):
        a, b = left.get(e["nid"]), left.get(e["other"])
        why = "into not found" if a is None else "from not found" if b is None else "same node" if a is b else "into has no text" if a["text"] is None else "from has no text" if b["text"] is None else None
        if why:
            faults.append((e["seq"], "merge", e["nid"], why))
            continue
        a["text"] += ("" if not a["text"] or a["text"].endswith(("-", " ")) else " ") + b["text"]
        a.update(refs=a["refs"] + b["refs"], edited="merge")
        del left[e["other"]]
    return left.values(), records, faults


def folded(nodes, log):
    docs = {}
    for n in nodes:
        docs.setdefault(n["doc"], ([], []))[0].append(dict(n, text0=n["text"]))
    for e in log:
        docs.setdefault(e["doc"], ([], []))[1].append(e)
    out, records, faults = [], [], []
    for d, (ns, es) in docs.items():
        left, rs, fs = fold(ns, es)
        out += [(d, n["nid"], n["parent"], n["place"], n["page"], n["kind"], n["level"], n["text"], n["refs"], n["edited"]) for n in left]
        records += [(d, *r) for r in rs]
        faults += [(d, *f) for f in fs]
    return sorted(map(repr, out)), sorted(map(repr, records)), sorted(map(repr, faults))


def spark_side(nodes, log):
    return tuple(sorted(repr(tuple(r)) for r in df.collect()) for df in edits.replayed(nodes, log))


def test_replay_query_against_a_plain_fold(spark):
    nodes, log = catalogue_layout.edited_documents(spark, DATA)
    ns, es = ([r.asDict() for r in df.collect()] for df in (nodes, log))
    want = folded(ns, es)
    assert spark_side(nodes, log) == want
    assert len(want[2]) > 20 and len(want[1]) > 10
    assert catalogue.QUERIES["replayed_nodes"](spark, DATA).count() == len(want[0])
    assert catalogue.QUERIES["edit_conflicts"](spark, DATA).count() == len(want[1]) + len(want[2])


@pytest.mark.parametrize("until", [2_000_000, 6_000_000])
def test_replay_of_a_prefix(spark, until):
    nodes, log = catalogue_layout.edited_documents(spark, DATA)
    few = log.where(F.col("seq") < until)
    assert spark_side(nodes, few) == folded(*([r.asDict() for r in df.collect()] for df in (nodes, few)))


NODES = "doc int, nid string, parent string, place int, page int, kind string, level int, text string, refs array<int>"
EDITS = "doc int, seq long, kind string, nid string, value string, other string, page int, order array<string>"


def test_replay_edges(spark):
    nodes = spark.createDataFrame([(1, "a", None, 0, 1, "paragraph", None, "x-", None), (1, "b", None, 1, 1, "paragraph", None, "y", [3]), (1, "c", None, 2, 1, "figure", None, None, None), (None, "z", None, 0, 1, "p", None, "lost", None), (1, None, None, 0, 1, "p", None, "lost", None)], NODES)
    log = spark.createDataFrame([(1, 2, "merge", "a", None, "b", None, None), (1, 3, "merge", "b", None, "a", None, None), (1, 4, "merge", "a", None, "c", None, None), (1, 5, "merge", "a", None, "a", None, None), (1, None, "delete", "a", None, None, None, None), (1, 6, "delete", None, None, None, None, None), (9, 7, "delete", "a", None, None, None, None), (None, 8, "delete", "a", None, None, None, None), (1, 9, None, "a", None, None, None, None)], EDITS)
    out, records, faults = edits.replayed(nodes, log)
    assert sorted((r.nid, r.text, r.refs) for r in out.collect()) == [("a", "x-y", [3]), ("c", None, [])]
    assert records.count() == 0
    assert sorted((str(r.seq), r.reason) for r in faults.collect()) == [("3", "into not found"), ("4", "from has no text"), ("5", "same node"), ("6", "incomplete"), ("7", "node not found"), ("8", "incomplete"), ("9", "incomplete"), ("None", "incomplete")]
    out, _, faults = edits.replayed(nodes, log.limit(0))
    assert sorted((r.nid, r.text, r.edited) for r in out.collect()) == [("a", "x-", None), ("b", "y", None), ("c", None, None)] and faults.count() == 0
    out, _, faults = edits.replayed(nodes.limit(0), log)
    assert out.count() == 0 and faults.count() == 9


# -- markup


def joined_links(links):
    out = []
    for s, e, v in sorted(links, key=lambda r: (r[0], r[1], r[2] or "")):
        if out and out[-1][2] == v and s - out[-1][1] <= 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, v])
    return out


def marked(text, emphasis, links):
    """Character by character: which marks hold it, in order; tags are opened and closed between neighbours."""
    text = text or ""
    held = [(0, s, -e, k, e, f'<a href="{v or ""}">', "</a>") for k, (s, e, v) in enumerate(joined_links(links or []))]
    held += [(1 if v == "strong" else 2, s, -e, k, e, f"<{v}>", f"</{v}>") for k, (s, e, v) in enumerate([r for r in emphasis or [] if r[2] in ("strong", "em")])]
    held.sort()
    usable = {p for h in held for p in (h[1], h[4]) if 0 <= p <= len(text)} | {0, len(text)}
    out, stack, a = "", [], 0
    for b in sorted(usable)[1:]:
        now = [h for h in held if h[1] <= a and b <= h[4]]
        keep = 0
        while keep < min(len(stack), len(now)) and stack[keep] == now[keep]:
            keep += 1
        out += "".join(h[6] for h in reversed(stack[keep:])) + "".join(h[5] for h in now[keep:]) + text[a:b]
        stack, a = now, b
    return re.sub(r"\s+", " ", out + "".join(h[6] for h in reversed(stack))).strip()


RUNS = "array<struct<s:int,e:int,v:string>>"


def well_nested(out):
    stack = []
    for close, name in re.findall(r"<(/?)(a|strong|em)\b[^>]*>", out):
        if not close:
            stack.append(name)
        elif not stack or stack.pop() != name:
            return False
    return not stack


def test_markup_of_random_runs(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(400):
        text = "".join(rnd.choice("abü \n ") for _ in range(rnd.randint(0, 14)))
        run = lambda names: [(s := rnd.randint(-1, 14), s + rnd.randint(-1, 8), rnd.choice(names)) for _ in range(rnd.randint(0, 4))]
        rows.append((k, text, run(["strong", "em", "mark", None]), run(["u", "v", None])))
    rows += [(900, None, None, None), (901, "abc", None, [(0, 3, None)]), (902, "abc", [(0, 2, "em"), (0, 2, "em")], None)]
    df = spark.createDataFrame(rows, f"k int, text string, e {RUNS}, l {RUNS}")
    got = {r.k: r.m for r in inline.woven(df, "text", "e", "l", "m").collect()}
    for k, text, e, links in rows:
        assert got[k] == marked(text, e, links), (text, e, links)
        assert well_nested(got[k]) and re.sub("<[^>]*>", "", got[k]).replace(" ", "") == re.sub(r"\s", "", text or "")
    assert inline.woven(df.limit(0), "text", "e", "l", "m").count() == 0


def test_markup_query(spark):
    want = []
    for r in catalogue_layout.marked_lines(spark, DATA).collect():
        m = marked(r.line, [tuple(x) for x in r.emphasis], [tuple(x) for x in r.links])
        want.append((r.doc_id, r.ord, f"<h{1 + r.ord % 3}>{m}</h{1 + r.ord % 3}>" if r.ord % 5 == 0 else m))
    assert sorted(map(tuple, catalogue.QUERIES["woven_markup"](spark, DATA).collect())) == sorted(want)


def test_canonical_lists(spark):
    df = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", None), (2, 1, None, "1")], "k int, o int, m string, s string")
    assert sorted(map(tuple, inline.canonical_lists(df, ["k"], "o", "m", "s").collect())) == [(1, "<ul><li>a</li><li>b</li></ul>"), (2, '<ol type="1"><li></li></ol>')]


# -- flowing text


def test_flowed_query_against_a_plain_fold(spark):
    lines = catalogue_layout.broken_lines(spark, DATA)
    glue = {(r.doc_id, r.block, r.nth): r.glue for r in vocabulary.line_glue(lines, "doc_id", "block", "nth", "text").collect()}
    blocks = {}
    for r in sorted(lines.where("block >= 1000000").collect(), key=lambda r: (r.doc_id, r.block, r.nth)):
        blocks.setdefault((r.doc_id, r.block), []).append(r)
    want = []
    for (d, b), held in blocks.items():
        out, found = "", []
        for r in held:
            g = glue.get((d, b, r.nth))
            if out.endswith("-") and g == "join":
                out = out[:-1]
            elif out and not (out.endswith("-") and g == "keep"):
                out += " "
            found.append((len(out), len(out) + len(r.text), "strong" if d % 4 == 0 or r.nth % 2 else "em"))
            out += r.text
        runs = []
        for s, e, v in sorted(found):
            if runs and runs[-1][2] == v and s - runs[-1][1] <= 1:
                runs[-1] = (runs[-1][0], max(e, runs[-1][1]), v)
            else:
                runs.append((s, e, v))
        want.append((d, b, out, "[" + ", ".join(f"{s} {e} {v}" for s, e, v in runs) + "]"))
    assert sorted(map(tuple, catalogue.QUERIES["flowed_text"](spark, DATA).collect())) == sorted(want)


def test_glue_by_the_documents_words(spark):
    rows = [(1, 1, 1, "The year-on-year rate and MULTIDIMENSIONAL, air-quality"), (1, 2, 1, "year-"), (1, 2, 2, "on-year"), (1, 3, 1, "MULTI-"), (1, 3, 2, "DIMENSIONAL"), (1, 4, 1, "AIR-"), (1, 4, 2, "QUALITY"), (1, 5, 1, "govern-"), (1, 5, 2, "ment"), (1, 6, 1, "A-"), (1, 6, 2, "9"), (2, 3, 1, "MULTI-"), (2, 3, 2, "DIMENSIONAL"), (2, 4, 1, None), (2, 4, 2, "x")]
    df = spark.createDataFrame(rows, "d int, b int, o int, t string")
    got = {(r.d, r.b): r.glue for r in vocabulary.line_glue(df, "d", "b", "o", "t").collect()}
    assert got == {(1, 2): "keep", (1, 3): "join", (1, 4): "space", (1, 5): "join", (2, 3): "space"}
    assert vocabulary.line_glue(df.limit(0), "d", "b", "o", "t").count() == 0
