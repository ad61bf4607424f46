"""Queries without SQL over boxes, contents and note numbers, against plain loops over the same rows."""

from leafloom import catalogue
from leafloom.operators import toc

DATA = "/root/testdata/sf0.001"


def pages_of(spark):
    held, _ = catalogue.boxes(spark, DATA)
    pages = {}
    for r in held.collect():
        pages.setdefault(r.page, []).append((r.block, float(r.l), float(r.b), float(r.r), float(r.t)))
    return pages


def test_every_line_is_a_block(spark):
    assert catalogue.QUERIES["reading_order"](spark, DATA).count() == catalogue.QUERIES["box_clusters"](spark, DATA).count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def test_box_clusters_against_all_pairs(spark):
    want = []
    for page, held in pages_of(spark).items():
        held.sort()
        group = list(range(len(held)))
        near = lambda a, b: a[1] <= b[3] + 8 and b[1] <= a[3] + 8 and a[2] <= b[4] + 8 and b[2] <= a[4] + 8
        for i in range(len(held)):
            for j in range(i):
                if near(held[i], held[j]) and group[i] != group[j]:
                    low, high = sorted((group[i], group[j]))
                    group = [low if g == high else g for g in group]
        want += [(page, h[0], g) for h, g in zip(held, group)]
    assert sorted(map(tuple, catalogue.QUERIES["box_clusters"](spark, DATA).collect())) == sorted(want)


def test_reading_order_places_every_block_once(spark):
    got = {}
    for r in catalogue.QUERIES["reading_order"](spark, DATA).collect():
        got.setdefault(r.page, []).append((r.place, r.block))
    pages = pages_of(spark)
    assert got.keys() == pages.keys()
    for page, held in pages.items():
        assert sorted(p for p, _ in got[page]) == list(range(len(held)))
        assert sorted(b for _, b in got[page]) == sorted(h[0] for h in held)


def test_contents_are_paired_as_by_hand(spark):
    lines = {}
    for r in catalogue.leaves(spark, DATA).collect():
        lines.setdefault(r.doc_id, []).append((r.ord, r.line))
    got = {}
    for r in catalogue.QUERIES["toc_reconcile"](spark, DATA).collect():
        got.setdefault(r[0], []).append(tuple(r)[1:])
    key = lambda s: spark.range(1).select(toc.title_key(toc.F.lit(s))).first()[0]
    for d in sorted(lines)[:3]:
        entries = [o for o, _ in lines[d] if o % 3 != 1]
        found = [x for x in got[d] if x[0] == "match"]
        assert {x[1] for x in got[d] if x[1] is not None} == set(entries)
        text = dict(lines[d])
        for _, e, h in found:
            assert key(f"{e + 1} {text[e]} {e}") == key(text[h])
