"""Registered queries over laid-out pages, notes, marks and edits, and the SQL that says the same.

Every line of every document is set on a page of two bands, 24 lines to a page, in
one, two or three columns by document and page: each band has a full-width line
and 11 lines in columns, some of which reach over the gutter.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import LEAVES, leaves, query, read
from .operators import contents, edits, figures, inline, layout, lists, notes, scan, settings, vocabulary
from .plans.storage import stored

PLACED_SQL = f"""{LEAVES}, k AS (SELECT doc_id, ord, line, ord // 24 AS page, (ord % 24) // 12 AS half, ord % 12 AS j, 1 + (doc_id + ord // 24) % 3 AS n FROM leaves),
placed AS (SELECT doc_id, page, ord, line, CASE WHEN j = 0 THEN half * 100 ELSE half * 100 + 1 + (j - 1) // (10 // n + 1) END AS block,
  CASE WHEN j = 0 THEN 72.0 ELSE 72.0 + ((j - 1) // (10 // n + 1)) * (468 // n - 16 + 24) END::DOUBLE AS l,
  CASE WHEN j = 0 THEN 540.0 ELSE 72.0 + ((j - 1) // (10 // n + 1)) * (468 // n - 16 + 24) + CASE WHEN ord % 17 = 5 THEN 468 // n + 14 ELSE least(468 // n - 16, 6 * length(line)) END END::DOUBLE AS r,
  CASE WHEN j = 0 THEN 720.0 - half * 330 - 14 ELSE 720.0 - half * 330 - 32 - 14 * ((j - 1) % (10 // n + 1)) END::DOUBLE AS b,
  CASE WHEN j = 0 THEN 720.0 - half * 330 ELSE 720.0 - half * 330 - 20 - 14 * ((j - 1) % (10 // n + 1)) END::DOUBLE AS t FROM k),
blocks AS (SELECT doc_id, page, block, min(l) AS l, min(b) AS b, max(r) AS r, max(t) AS t FROM placed GROUP BY doc_id, page, block)"""


def placed(spark, sf_dir):
    """Lines (doc_id, page, block, ord, line, box) and the blocks they make up."""
    o, j, n, half = F.col("ord"), F.col("ord") % 12, F.col("_n"), F.floor(F.col("ord") % 24 / 12)
    rows = leaves(spark, sf_dir).select("doc_id", "ord", "line", F.floor(o / 24).alias("page")).withColumn("_n", 1 + (F.col("doc_id") + F.col("page")) % 3)
    each = F.floor(10 / n) + 1
    col, row, wide = F.floor((j - 1) / each), (j - 1) % each, F.floor(468 / n) - 16
    left, top = 72 + col * (wide + 24), 720 - half * 330 - 20 - 14 * row
    reach = F.when(o % 17 == 5, wide + 30).otherwise(F.least(wide, 6 * F.length("line")))
    first = j == 0
    head = 720 - half * 330
    boxed = {"block": F.when(first, half * 100).otherwise(half * 100 + 1 + col), "l": F.when(first, 72).otherwise(left), "r": F.when(first, 540).otherwise(left + reach), "b": F.when(first, head - 14).otherwise(top - 12), "t": F.when(first, head).otherwise(top)}
    lines = rows.withColumns({c: v.cast("long" if c == "block" else "double") for c, v in boxed.items()}).drop("_n")
    return lines, lines.groupBy("doc_id", "page", "block").agg(F.min("l").alias("l"), F.min("b").alias("b"), F.max("r").alias("r"), F.max("t").alias("t"))


PAGE = ["doc_id", "page"]

MODEL_SQL = f"""{PLACED_SQL}, st AS (
  SELECT doc_id, page, min(l) AS lft, max(r) AS rgt, min(b) AS low, max(t) AS high, list_sort(list(r - l))[1 + count(*) // 2] AS med FROM blocks GROUP BY doc_id, page HAVING count(*) >= 2 AND max(r) > min(l)
), sz AS (SELECT blocks.*, lft, rgt, low, high, greatest(0.6 * (rgt - lft), 1.3 * med) AS span FROM blocks JOIN st USING (doc_id, page)
), ed AS (
  SELECT DISTINCT doc_id, page, y FROM (SELECT doc_id, page, low, high, unnest([b, t]) AS y FROM sz WHERE r - l >= span) WHERE low < y AND y < high
  UNION SELECT doc_id, page, unnest([low, high]) FROM st
), bd AS (
  SELECT doc_id, page, y0, y1, row_number() OVER (PARTITION BY doc_id, page ORDER BY y1 DESC) - 1 AS band FROM (
    SELECT doc_id, page, y AS y1, lead(y) OVER (PARTITION BY doc_id, page ORDER BY y DESC) AS y0 FROM ed) WHERE y1 - y0 >= 4
), mb AS (
  SELECT s.doc_id, s.page, s.block, band FROM sz s JOIN bd USING (doc_id, page) WHERE r - l < span AND least(y1, t) - greatest(y0, b) > 0.5 * (t - b)
), ln AS (SELECT p.doc_id, p.page, m.band, p.l, p.r FROM placed p JOIN mb m USING (doc_id, page, block)
), cn AS (SELECT doc_id, page, band, count(*) AS n, min(l) AS lo, max(r) AS hi FROM ln GROUP BY ALL
), pr AS (
  SELECT doc_id, page, band, n, lo, k, (SELECT count(*) FROM ln WHERE ln.doc_id = c.doc_id AND ln.page = c.page AND ln.band = c.band AND ln.l < lo + 2 * k AND ln.r > lo + 2 * k) AS crossing
  FROM (SELECT *, unnest(range(1, CAST(ceil((hi - 2 - lo) / 2) AS BIGINT))) AS k FROM cn WHERE n >= 4) c
), ok AS (
  SELECT *, k - row_number() OVER (PARTITION BY doc_id, page, band ORDER BY k) AS g FROM pr
  WHERE crossing <= greatest(CASE WHEN n >= 12 THEN 1 ELSE 0 END, round_even(0.06 * n, 0))
), gt AS (
  SELECT doc_id, page, band, min(lo) + 2 * min(k) AS x0, min(lo) + 2 * max(k) AS x1, max(crossing) AS bridged FROM ok GROUP BY doc_id, page, band, g HAVING 2 * max(k) - 2 * min(k) >= 10
), gg AS (
  SELECT * FROM gt WHERE (SELECT count(*) FROM ln WHERE ln.doc_id = gt.doc_id AND ln.page = gt.page AND ln.band = gt.band AND ln.r <= x0) >= 2
    AND (SELECT count(*) FROM ln WHERE ln.doc_id = gt.doc_id AND ln.page = gt.page AND ln.band = gt.band AND ln.l >= x1) >= 2
), ga AS (SELECT doc_id, page, band, list(x0 ORDER BY x0) AS a, list(x1 ORDER BY x0) AS z, max(bridged) AS bridged FROM gg GROUP BY ALL
), ml AS (
  SELECT b.doc_id, b.page, b.band, b.y0, b.y1, coalesce(n, 0) AS n_lines, bridged,
    list_concat([CASE WHEN coalesce(n, 0) < 4 THEN lft ELSE lo END], coalesce(z, [])) AS xs, list_concat(coalesce(a, []), [CASE WHEN coalesce(n, 0) < 4 THEN rgt ELSE hi END]) AS zs,
    list_min(list_transform(coalesce(a, []), lambda v, i: z[i] - v)) AS narrow
  FROM bd b JOIN st USING (doc_id, page) LEFT JOIN cn USING (doc_id, page, band) LEFT JOIN ga USING (doc_id, page, band)
), model AS (SELECT *, max(len(xs)) OVER w AS n_cols, coalesce(min(least(narrow / 18, 1.0) * (1 - bridged / n_lines)) OVER w, 1.0) AS conf FROM ml WINDOW w AS (PARTITION BY doc_id, page))"""


@query(f"""WITH {MODEL_SQL} SELECT doc_id, page, band, y0, y1, n_lines, list_aggregate(list_transform(xs, lambda x, i: CAST(x AS BIGINT) || '-' || CAST(zs[i] AS BIGINT)), 'string_agg', ' ') AS cols, bridged, n_cols, round(conf, 2) AS conf FROM model""")
def column_model(spark, sf_dir):
    """Gutters and confidence of every page."""
    lines, blocks = placed(spark, sf_dir)
    found = layout.column_model(blocks, lines, PAGE, "block")
    cols = F.array_join(F.transform("cols", lambda c: F.concat(c.x0.cast("long").cast("string"), F.lit("-"), c.x1.cast("long").cast("string"))), " ")
    return found.select("doc_id", "page", "band", "y0", "y1", "n_lines", cols.alias("cols"), "bridged", "n_cols", "conf")


@query(f"""WITH {MODEL_SQL}, hv AS (
  SELECT b.*, m.band, m.xs, m.zs, greatest(0, least(t, y1) - greatest(b.b, y0)) AS tall FROM blocks b JOIN model m USING (doc_id, page)
), ow AS (
  SELECT *, list_transform(xs, lambda x, i: greatest(0, least(r, zs[i]) - greatest(l, x))) AS sh FROM hv QUALIFY row_number() OVER (PARTITION BY doc_id, page, block ORDER BY tall DESC, band) = 1
), sp AS (
  SELECT *, len(xs) > 1 AND len(list_filter(list_transform(xs, lambda x, i: sh[i] > greatest(0.25 * least(r - l, zs[i] - x), 30.0)), lambda x: x)) >= 2 AS split, (b + t) / 2 AS mid, list_position(sh, list_max(sh)) - 1 AS col FROM ow
), ky AS (
  SELECT *, (SELECT count(*) FROM sp u WHERE u.doc_id = sp.doc_id AND u.page = sp.page AND u.band = sp.band AND u.split AND u.mid > sp.mid) AS above,
    row_number() OVER (PARTITION BY doc_id, page, band, split ORDER BY mid DESC, block) AS nth FROM sp
)
SELECT doc_id, page, block, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, CASE WHEN split THEN 2 * nth - 1 ELSE 2 * above END, CASE WHEN split THEN 0 ELSE col END, CASE WHEN split THEN 0.0 ELSE -t END, l, block) - 1 AS place FROM ky""")
def modelled_order(spark, sf_dir):
    """The reading order of every page that has a column model."""
    lines, blocks = placed(spark, sf_dir)
    return layout.modelled_order(blocks, layout.column_model(blocks, lines, PAGE, "block"), PAGE, "block")


@query()
def topological_order(spark, sf_dir):
    """The lines of every page, sorted by which comes before which."""
    lines, _ = placed(spark, sf_dir)
    return layout.topological_order(lines, PAGE, "ord")


def drawn_tables(spark, sf_dir):
    """Regions, drawn paths and blocks: an order's lines as rows of a table, some without posts, some over two columns."""
    d = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag")
    top, order = 400.0 - 25 * F.col("l_linenumber"), F.col("l_orderkey")
    col = F.col("l_partkey") % 3
    wide = F.col("l_partkey") % 11 == 0
    left = F.when(wide, 5.0).otherwise(col * 100 + 5 + F.col("l_suppkey") % 7)
    right = F.when(wide, 150.0 + F.col("l_quantity")).otherwise(left + 40 + F.col("l_quantity"))
    parts = F.when(F.col("l_partkey") % 2 == 0, F.array("l_linestatus", "l_returnflag")).otherwise(F.array("l_linestatus"))
    blocks = d.select(F.floor(order / 4).alias("page"), order.alias("region"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("block"), left.alias("l"), (top - 14).alias("b"), right.alias("r"), top.alias("t"), F.concat_ws(" ", "l_linestatus", "l_returnflag").alias("text"), parts.alias("parts"))
    regions = d.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n")).select(F.floor(order / 4).alias("page"), order.alias("region"), (order % 4 * 1000.0).alias("x"), F.lit(0.0).alias("l"), (400.0 - 25 * (F.col("n") + 1)).alias("b"), F.lit(300.0).alias("r"), F.lit(400.0).alias("t"), (order % 2 == 0).alias("strict"))
    mark = lambda a, b, c, e, filled: F.struct(a.cast("double").alias("l"), b.cast("double").alias("b"), c.cast("double").alias("r"), e.cast("double").alias("t"), F.lit(filled).alias("filled"))
    zero, jitter = F.lit(0), F.col("l_suppkey") % 5
    rule = mark(zero, top, F.lit(300), top + 1, False)
    post = F.when((order % 5 != 0) & (F.col("l_linenumber") < 4), mark(100 * F.least(F.lit(2), F.col("l_linenumber")) + jitter, top - 24, 100 * F.least(F.lit(2), F.col("l_linenumber")) + 1 + jitter, top, False))
    fill = F.when(F.col("l_linenumber") == 4, mark(F.lit(98), top - 20, F.lit(203), top, True))
    marks = d.select(F.floor(order / 4).alias("page"), order.alias("region"), F.explode(F.array_compact(F.array(rule, post, fill))).alias("m")).select("page", "region", "m.*")
    # regions of a page lie side by side
    aside = lambda df: df.withColumns({c: F.col(c) + F.col("region") % 4 * 1000.0 for c in ("l", "r")})
    return aside(regions.drop("x")), aside(marks).drop("region"), aside(blocks)


@query()
def table_cells(spark, sf_dir):
    """Cells of every drawn table, and -1 rows that say why a region is none."""
    cells, told = layout.table_grids(*drawn_tables(spark, sf_dir), "page", "region", "block")
    refused = told.where("outcome <> 'table'").select("page", "region", F.lit(-1).cast("long").alias("row"), F.lit(-1).cast("long").alias("col"), F.lit(0).alias("span"), F.col("outcome").alias("text"))
    return cells.select("page", "region", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("span").cast("int").alias("span"), "text").unionByName(refused)


# --- notes and references


def note_lines(spark, sf_dir):
    """Lines as notes that count up, every third going on with the one before; by document some markers are misread by much or by a digit, or missing at the head of their block."""
    o, d = F.col("ord"), F.col("doc_id") % 4
    n = F.floor(2 * o / 3) + 1
    shown = F.when((d == 1) & (o % 9 == 3), n + 60).when((d == 2) & (o % 9 == 6), n - n % 10 + (n + 5) % 10).otherwise(n).cast("string")
    bare = (o % 3 == 1) | ((d == 3) & (o % 15 == 0))
    said = F.when(bare, F.col("line")).otherwise(F.concat_ws(". ", shown, "line"))
    return leaves(spark, sf_dir).select("doc_id", "ord", F.floor(o / 20).alias("page"), F.when(d == 3, F.floor(o / 15)).otherwise(F.floor(o / 5)).alias("block"), said.alias("text"))


@query()
def note_records(spark, sf_dir):
    """Every note of every document with its text."""
    return notes.note_records(note_lines(spark, sf_dir), "doc_id", "ord", "page", "block", "text")


@query()
def note_blocks(spark, sf_dir):
    """Which blocks of every document hold notes: sizes by block, a year in every fourth, headings of notes in some documents."""
    lines = note_lines(spark, sf_dir).withColumn("text", F.when((F.col("doc_id") % 5 == 2) & (F.col("ord") == 10), F.lit("Notes")).otherwise(F.col("text")))
    parts = lines.groupBy("doc_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("lines"), F.min("page").alias("page"))
    k = F.col("doc_id") + F.col("block")
    text = F.concat(F.array_join("lines", " "), F.when(k % 2 == 0, F.lit(" 2019, 2020, 2021, 2022, 2023")).otherwise(""))
    heading = F.get("lines", F.lit(0)) == "Notes"
    blocks = parts.select("doc_id", "block", "lines", F.when(heading, "Notes").otherwise(text).alias("text"), F.when(k % 3 == 0, 8.0).when(k % 13 == 5, 14.0).otherwise(10.0).alias("size"), F.lit(10.0).alias("body"), (k % 7 == 0).alias("foot"))
    return notes.note_blocks(blocks, "doc_id", "block")


CITED_SQL = f"""{LEAVES}, notes AS (SELECT doc_id, ord // 6 AS page, CASE WHEN doc_id % 2 = 0 THEN 1 + ord % 4 ELSE ord END AS n FROM leaves),
refs AS (SELECT doc_id, ord AS ref, 1 + (ord * 7) % 5 AS n, CASE WHEN ord % 11 <> 0 THEN ord // 5 END AS page FROM leaves),
nk AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY doc_id, n) = 1 THEN CAST(n AS VARCHAR) ELSE page || '-' || n END AS target, count(*) OVER (PARTITION BY doc_id, n) AS copies FROM (SELECT DISTINCT * FROM notes)),
rr AS (SELECT r.doc_id, r.ref, r.n, r.page, k.target, k.page AS target_page, CASE WHEN k.n IS NULL THEN 'no note' WHEN copies = 1 THEN 'only' WHEN r.page IS NULL THEN 'first' WHEN k.page = r.page THEN 'same page' ELSE 'nearest' END AS reason
  FROM refs r LEFT JOIN nk k ON k.doc_id = r.doc_id AND k.n = r.n QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.ref ORDER BY CASE WHEN r.page IS NULL THEN 0 ELSE abs(k.page - r.page) END, k.page) = 1)"""


def cited(spark, sf_dir):
    rows, o = leaves(spark, sf_dir), F.col("ord")
    held = rows.select("doc_id", F.floor(o / 6).alias("page"), F.when(F.col("doc_id") % 2 == 0, 1 + o % 4).otherwise(o).alias("n"))
    refs = rows.select("doc_id", o.alias("ref"), (1 + o * 7 % 5).alias("n"), F.when(o % 11 != 0, F.floor(o / 5)).alias("page"))
    return refs, held


@query(f"WITH {CITED_SQL} SELECT * FROM rr")
def resolved_references(spark, sf_dir):
    """The note that every reference means, or why there is none."""
    refs, held = cited(spark, sf_dir)
    return notes.resolved_references(refs, held, "doc_id", "ref")


@query(f"WITH {CITED_SQL} SELECT k.doc_id, k.target, k.n, k.page, count(rr.ref) AS n_refs, min(rr.ref) AS first_ref FROM nk k LEFT JOIN rr ON rr.doc_id = k.doc_id AND rr.target = k.target GROUP BY ALL")
def back_references(spark, sf_dir):
    """Every note with the references to it."""
    refs, held = cited(spark, sf_dir)
    return notes.back_references(notes.resolved_references(refs, held, "doc_id", "ref"), held, "doc_id")


@query(f"""WITH {LEAVES}, t AS (SELECT doc_id, regexp_replace(lower(line), '[^a-z0-9]+', '', 'g') AS t, max(ord) AS o FROM leaves WHERE ord % 4 = 0 GROUP BY 1, 2),
a AS (SELECT doc_id, ord AS anchor, regexp_replace(lower(regexp_replace(CASE ord % 3 WHEN 0 THEN line WHEN 1 THEN substring(line, 1, 20) || '.' ELSE substring(line, 1, 6) END, '[,.;:]+\\s*$', '')), '[^a-z0-9]+', '', 'g') AS a FROM leaves),
m AS (SELECT a.doc_id, anchor, a, max(CASE WHEN t = a THEN o END) AS same, count(t) AS n, max(o) AS one FROM a LEFT JOIN t ON t.doc_id = a.doc_id AND t <> '' AND length(a) >= 8 AND (starts_with(a, t) OR starts_with(t, a)) GROUP BY 1, 2, 3)
SELECT doc_id, anchor, coalesce(same, CASE WHEN n = 1 THEN one END) AS target, CASE WHEN length(a) < 8 THEN 'short' WHEN same IS NOT NULL THEN 'exact' WHEN n = 0 THEN 'unknown' WHEN n = 1 THEN 'prefix' ELSE 'several' END AS reason FROM m""")
def resolved_anchors(spark, sf_dir):
    """The heading that every cross reference means, or why there is none."""
    rows, o = leaves(spark, sf_dir), F.col("ord")
    said = F.when(o % 3 == 0, F.col("line")).when(o % 3 == 1, F.concat(F.substring("line", 1, 20), F.lit("."))).otherwise(F.substring("line", 1, 6))
    return notes.resolved_anchors(rows.select("doc_id", o.alias("anchor"), said.alias("text")), rows.where(o % 4 == 0).select("doc_id", o.alias("o"), "line"), "doc_id", "anchor", "text", "o", "line")


# --- inline markup and flowing text


def marked_lines(spark, sf_dir):
    """Lines with runs that nest, cross and reach out of them."""
    o, n = F.col("ord"), F.length("line")
    run = lambda s, e, v: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), F.lit(v).alias("v"))
    d = F.col("doc_id")
    emphasis = F.array(run(o % 5, o % 5 + 4 + d % 11, "strong"), run(o % 7, o % 7 + 3 + d % 5, "em"), run(2 + d % 3, 9 + o % 4, "strong"), run(n - 3, n + 2, "em"), run(o % 3, o % 3, "em"), run(F.lit(1), n, "mark"))
    links = F.array(run(o % 6, o % 6 + 5, "u/1"), run(o % 6 + 6, o % 6 + 9, "u/1"), run(4 + d % 4, n - d % 9, "u/2"))
    return leaves(spark, sf_dir).select("doc_id", "ord", "line", emphasis.alias("emphasis"), links.alias("links"))


@query()
def woven_markup(spark, sf_dir):
    """Every line with its marks as nested markup, in its lasting form: every fifth a heading."""
    marked = inline.woven(marked_lines(spark, sf_dir), "line", "emphasis", "links", "marked")
    kind = F.when(F.col("ord") % 5 == 0, "heading").otherwise("paragraph")
    return marked.select("doc_id", "ord", inline.canonical(kind, 1 + F.col("ord") % 3, F.col("marked"), F.col("line")).alias("canonical"))


BROKEN_SQL = f"""{LEAVES}, cut AS (SELECT doc_id, ord, line, 6 + ord % 9 AS k FROM leaves),
parts AS (SELECT doc_id, ord, 2 * ord AS nth, CASE WHEN doc_id % 3 = 0 THEN replace(line, ' ', '-') ELSE line END AS text FROM cut
UNION ALL SELECT doc_id, ord + 1000000, 2 * ord, substring(line, 1, k) || '-' FROM cut UNION ALL SELECT doc_id, ord + 1000000, 2 * ord + 1, CASE WHEN doc_id % 2 = 0 THEN translate(substring(line, k + 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN doc_id % 3 = 0 THEN replace(substring(line, k + 1), ' ', '-') ELSE substring(line, k + 1) END FROM cut)"""


def broken_lines(spark, sf_dir):
    """Every line whole (a block), and as two lines of another block, cut within a word or between."""
    o, k, d = F.col("ord"), 6 + F.col("ord") % 9, F.col("doc_id")
    rest = F.substring(F.col("line"), (k + 1).cast("int"), F.length("line"))
    linked = lambda c: F.replace(c, F.lit(" "), F.lit("-"))
    part = lambda block, nth, text: F.struct(block.alias("block"), nth.alias("nth"), text.alias("text"))
    tail = F.when(d % 2 == 0, F.translate(rest, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(d % 3 == 0, linked(rest)).otherwise(rest)
    parts = F.array(part(o.cast("long"), 2 * o, F.when(d % 3 == 0, linked(F.col("line"))).otherwise(F.col("line"))), part(o + 1_000_000, 2 * o, F.concat(F.substring(F.col("line"), F.lit(1), k.cast("int")), F.lit("-"))), part(o + 1_000_000, 2 * o + 1, tail))
    return leaves(spark, sf_dir).select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.block", "p.nth", "p.text")


@query(f"""WITH {BROKEN_SQL}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z-]*[a-z]')) AS word FROM parts),
b AS (SELECT doc_id, ord, nth, text AS t, lag(text) OVER (PARTITION BY doc_id, ord ORDER BY nth) AS p FROM parts),
c AS (SELECT *, lower(regexp_extract(p, '([A-Za-z]+)-$', 1)) AS a, lower(regexp_extract(t, '^([A-Za-z]+)', 1)) AS z, lower(regexp_extract(t, '^([A-Za-z]+(?:-[A-Za-z]+)+)', 1)) AS zz, regexp_matches(t, '^\\p{{Ll}}') AS small, regexp_matches(t, '^\\p{{Lu}}') AS capital
  FROM b WHERE p LIKE '%-' AND regexp_matches(t, '^\\p{{L}}')),
g AS (SELECT *, CASE WHEN a <> '' AND small AND zz <> '' THEN a || '-' || zz WHEN a <> '' AND NOT small AND z <> '' THEN a || '-' || z END AS whole, CASE WHEN a <> '' AND NOT small AND z <> '' THEN a || z END AS joined FROM c),
f AS (SELECT g.*, w1.word IS NOT NULL AS has_whole, w2.word IS NOT NULL AS has_joined FROM g LEFT JOIN w w1 ON w1.doc_id = g.doc_id AND w1.word = whole LEFT JOIN w w2 ON w2.doc_id = g.doc_id AND w2.word = joined)
SELECT CASE WHEN small THEN CASE WHEN has_whole THEN 'keep' ELSE 'join' END WHEN capital AND has_joined AND NOT has_whole THEN 'join' ELSE 'space' END AS glue, doc_id, ord AS block, nth FROM f""")
def line_glue(spark, sf_dir):
    """How every line that follows a hyphen goes on, by the document's own words."""
    return vocabulary.line_glue(broken_lines(spark, sf_dir), "doc_id", "block", "nth", "text")


@query()
def flowed_text(spark, sf_dir):
    """Every broken line as flowing text with a run for each line, hyphens joined or kept by the document's own words."""
    lines = broken_lines(spark, sf_dir)
    held = lines.where("block >= 1000000").join(vocabulary.line_glue(lines, "doc_id", "block", "nth", "text"), ["doc_id", "block", "nth"], "left")
    run = F.array(F.struct(F.lit(0).alias("s"), F.length("text").alias("e"), F.when(F.col("doc_id") % 4 == 0, "strong").otherwise(F.when(F.col("nth") % 2 == 0, "em").otherwise("strong")).alias("v")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("nth", "text", run.alias("runs"), "glue"))), lambda x: F.struct(x["text"].alias("text"), x["runs"].alias("runs"), x["glue"].alias("glue")))
    flow = held.groupBy("doc_id", "block").agg(inline.flowed(parts).alias("f"))
    return flow.select("doc_id", "block", "f.text", F.transform("f.runs", lambda r: F.concat_ws(" ", r["s"].cast("string"), r["e"].cast("string"), r["v"])).cast("string").alias("runs"))


# --- edits


def edited_documents(spark, sf_dir):
    """Sections of ten lines as nodes, and an edit for every third line: texts, levels, deletions, notes, references, merges, some of nodes that don't exist; orders of documents and pages."""
    o, d = F.col("ord"), F.col("doc_id")
    name = lambda k: F.concat(F.lit("n"), k.cast("string"))
    none = F.lit(None).cast("string")
    rows = leaves(spark, sf_dir).select("doc_id", "ord", "line")
    lone = d % 3 == 0  # no sections: every line stands at the top
    section = F.concat(F.lit("s"), F.floor(o / 10).cast("string"))
    lines = rows.select(d.alias("doc"), name(o).alias("nid"), F.when(~lone, section).alias("parent"), o.cast("long").alias("place"), F.floor(o / 20).alias("page"), F.when(o % 4 == 0, "heading").otherwise("paragraph").alias("kind"), F.when(o % 4 == 0, 2).alias("level"), F.when(o % 13 != 5, F.col("line")).alias("text"), F.when(o % 6 == 1, F.array((o % 9).cast("int"))).otherwise(F.array().cast("array<int>")).alias("refs"))
    heads = rows.where(~lone).groupBy("doc_id", F.floor(o / 10).alias("k")).agg(F.min(F.floor(o / 20)).alias("page"))
    sections = heads.select(d.alias("doc"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("nid"), none.alias("parent"), F.col("k").cast("long").alias("place"), "page", F.lit("section").alias("kind"), F.lit(None).cast("int").alias("level"), none.alias("text"), F.array().cast("array<int>").alias("refs"))
    j = (d + o) % 21
    kind = F.when(j == 0, "delete").when(j == 3, "set-text").when(j == 6, "set-level").when(j == 9, "note").when(j == 12, "ref").when(j == 15, "merge").when(j == 18, "split")
    value = F.when(j == 3, F.concat(F.lit("new "), o.cast("string"))).when(j == 6, (o % 4 - 1).cast("string")).when(j == 9, (o % 12).cast("string")).when(j == 12, (o % 9).cast("string"))
    empty = F.lit(None).cast("array<string>")
    long = F.lit(None).cast("long")
    log = rows.where(kind.isNotNull()).select(d.alias("doc"), ((o * 37) % 1009 * 10_000 + o).cast("long").alias("seq"), kind.alias("kind"), F.when(o % 8 == 7, name(o + 5000)).when((j == 0) & (o % 5 == 0) & ~lone, section).otherwise(name(o)).alias("nid"), value.alias("value"), F.when(j == 15, name(o + 1)).alias("other"), long.alias("page"), empty.alias("order"))
    tops = F.when(d % 3 == 0, name(F.col("_o"))).otherwise(F.concat(F.lit("s"), F.col("_o").cast("string")))
    wholes = rows.groupBy("doc_id").agg(F.max(F.when(lone, o).otherwise(F.floor(o / 10))).alias("_m")).where(d % 2 == 0)
    order = wholes.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m").cast("long"))).alias("_o")).where("_o % 5 <> 3")
    saved = order.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(((F.col("_o") * 7) % 11).alias("a"), F.col("_o").alias("b"), tops.alias("n")))), lambda x: x["n"]).alias("order"))
    whole = saved.select(d.alias("doc"), F.lit(20_000_000).cast("long").alias("seq"), F.lit("reorder").alias("kind"), none.alias("nid"), none.alias("value"), none.alias("other"), long.alias("page"), F.concat("order", F.array(F.lit("gone"))).alias("order"))
    pages = rows.where(d % 6 == 3).groupBy("doc_id", F.floor(o / 20).alias("_p")).agg(F.reverse(F.array_sort(F.collect_list(o))).alias("_o"))
    paged = pages.select(d.alias("doc"), (20_000_001 + F.col("_p")).cast("long").alias("seq"), F.lit("reorder").alias("kind"), none.alias("nid"), none.alias("value"), none.alias("other"), F.col("_p").cast("long").alias("page"), F.transform("_o", lambda x: F.concat(F.lit("n"), x.cast("string"))).alias("order"))
    return lines.unionByName(sections), log.unionByName(whole).unionByName(paged)


@query()
def replayed_nodes(spark, sf_dir):
    """Every document's nodes after its edits."""
    return edits.replayed(*edited_documents(spark, sf_dir))[0].withColumn("refs", F.col("refs").cast("string"))


@query()
def edit_conflicts(spark, sf_dir):
    """Every edit that could not be applied, and why; and the notes that edits made, as 'note' rows."""
    _, records, conflicts = edits.replayed(*edited_documents(spark, sf_dir))
    made = records.select("doc", F.col("n").cast("long").alias("seq"), F.lit("note").alias("kind"), F.lit(None).cast("string").alias("nid"), F.col("text").alias("reason"))
    return conflicts.unionByName(made)


# --- contents, lists, figures, settings


def contents_lines(spark, sf_dir):
    """Every line's beginning as a line of a contents list (doc_id, x, y, text): numbers before, behind and beside titles, dotted ones, chapters, wraps."""
    o, d = F.col("ord"), F.col("doc_id")
    title, n, k = F.substring("line", 1, 30), (2 + o).cast("string"), o % 6
    text = (
        F.when(k == 0, F.concat_ws(" ", F.concat((1 + o % 4).cast("string"), F.lit("."), (1 + o % 3).cast("string")), title, F.lit(" . . . ."), n))
        .when(k == 1, F.concat_ws(" ", n, title))
        .when(k == 2, title)
        .when(k == 3, F.concat_ws(" ", F.lower(title), n))
        .when(k == 4, F.concat_ws(" ", F.lit("Chapter"), (1 + o % 9).cast("string"), title, F.lit("...."), F.lit("xiv")))
        .otherwise(F.concat_ws(" ", F.lit("—"), title))
    )
    x = F.when(d % 3 == 0, 72.0).otherwise(72.0 + 11.0 * (o % 3) + 3.0 * (o % 2))
    y = 10_000.0 - 14.0 * o
    line = lambda x_, y_, t: F.struct(x_.alias("x"), y_.alias("y"), t.alias("text"))
    parts = F.when(k == 2, F.array(line(x, y, text), line(F.lit(500.0), y + 2.5, n))).otherwise(F.array(line(x, y, text)))
    return leaves(spark, sf_dir).select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.x", "p.y", "p.text")


@query()
def contents_entries(spark, sf_dir):
    """Titles, pages and levels of every contents list."""
    return contents.parsed(contents_lines(spark, sf_dir), "doc_id", "x", "y", "text")


def listed_nodes(spark, sf_dir):
    """Lines as nodes: headings of glossaries with terms and definitions, numbered lists with what goes on behind them."""
    o, d = F.col("ord"), F.col("doc_id")
    k = o % 12
    head = F.when(d % 3 == 0, "Key Terms").when(d % 3 == 1, "Glossary of terms").otherwise(F.substring("line", 1, 20))
    more = F.concat(F.lit("3. "), F.substring("line", 1, 12), F.lit(" a) "), F.substring("line", 5, 9), F.lit(" 4) "), F.substring("line", 2, 11), F.lit(" b. no"))
    kind = F.when(k == 0, "heading").when(k == 9, "list").otherwise("paragraph")
    text = F.when(k == 0, head).when(k % 2 == 1, F.substring("line", 1, (20 + 10 * (o % 6)).cast("int"))).when((k == 10) & (d % 2 == 0), more).otherwise(F.col("line"))
    return leaves(spark, sf_dir).select("doc_id", "ord", kind.alias("kind"), text.alias("text"), F.when((d + o) % 29 == 0, "bold").otherwise("plain").alias("style"), F.when(k == 9, F.lit(1)).alias("start"), F.when(k == 9, 1 + d % 3).cast("int").alias("items"), F.when(k == 9, o % 2).cast("int").alias("subs"))


@query()
def definition_lists(spark, sf_dir):
    """Every pair of term and definition behind a glossary's heading."""
    return lists.definition_lists(listed_nodes(spark, sf_dir), "doc_id", "ord")


@query()
def list_continuations(spark, sf_dir):
    """What the paragraph behind every numbered list goes on with."""
    return lists.list_continuations(listed_nodes(spark, sf_dir), "doc_id", "ord")


def gutter_lists(spark, sf_dir):
    """Blocks of every page as nodes in modelled order (a list in two of three), and the model."""
    lines, blocks = placed(spark, sf_dir)
    model = stored(layout.column_model(blocks, lines, PAGE, "block"), "gutter-model")
    order = layout.modelled_order(blocks, model, PAGE, "block")
    k = F.col("block") + F.col("doc_id")
    return blocks.join(order, [*PAGE, "block"]).withColumns({"kind": F.when((F.col("block") % 100 == 0) | (k % 7 == 0), "heading").otherwise("list"), "ordered": F.when(k % 5 == 0, "1")}), model


@query()
def lists_over_columns(spark, sf_dir):
    """Lists that go on in the next column of their band."""
    nodes, model = gutter_lists(spark, sf_dir)
    return lists.lists_over_columns(nodes, model, PAGE, "block", "place")


def charted_pages(spark, sf_dir):
    """Lines of every page as blocks that may be labels, and its full-width lines as regions of drawn paths."""
    lines, _ = placed(spark, sf_dir)
    d, o = F.col("doc_id"), F.col("ord")
    regions = lines.where("block % 100 = 0").select(*PAGE, o.alias("region"), "l", (F.col("b") - 20.0 * (d % 4)).alias("b"), (F.col("l") + 40.0 + 30 * (d % 5)).alias("r"), "t", (6 + (d + o) % 5).alias("paths"))
    text = F.when(o % 3 == 0, F.substring("line", 1, 18)).otherwise(F.col("line"))
    label = figures.label_shaped(text, F.array(text), F.when((d + o) % 4 == 0, 8.0).when((d + o) % 9 == 0, 14.0).otherwise(10.0), F.lit(10.0), o % 11 == 3)
    return regions, lines.where("block % 100 <> 0").select(*PAGE, o.alias("block"), "l", "b", "r", "t", label.alias("label"))


@query()
def grown_figures(spark, sf_dir):
    """Every chart's box after it has grown over its labels, with how many it took."""
    regions, blocks = charted_pages(spark, sf_dir)
    boxes, taken = figures.grown(regions, blocks, PAGE, "region", "block")
    return boxes.join(taken.groupBy(*PAGE, "region").agg(F.count(F.lit(1)).alias("n_labels")), [*PAGE, "region"], "left").withColumn("n_labels", F.coalesce("n_labels", F.lit(0).cast("long")))


def setting_layers(spark, sf_dir):
    """Three layers of settings for every customer, as JSON: objects over values, values over objects, empty ones, some that are broken."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    low = F.to_json(F.struct(F.struct(F.lit("a").alias("font"), F.col("c_nationkey").alias("size"), F.struct(F.lit(True).alias("on")).alias("embed")).alias("output"), F.col("c_mktsegment").alias("name"), F.array(F.lit(1), F.lit(2)).alias("list")))
    mid = F.when(k % 5 == 0, '{"output": 7}').when(k % 5 == 1, '{"output": {"embed": {}}, "name": {"short": "x"}}').when(k % 5 == 2, "{}").when(k % 5 == 3, '{"output": {"size": null, "embed": {"on": false, "all": 1}}}').otherwise("{broken")
    high = F.when(k % 7 == 0, '{"output": {"font": "z"}, "name": {}}').when(k % 7 == 1, '{"list": {"a": []}}').when(k % 7 == 2, '{"output": {"embed": 0}}').when(k % 7 == 3, "[1]").otherwise('{"extra": {"deep": {"er": 1}}}')
    return c.select("c_custkey", F.posexplode(F.array(low, mid, high)).alias("layer", "text"))


@query()
def layered_settings(spark, sf_dir):
    """Every customer's settings after their layers are laid over each other; layers that are no object as rows without value."""
    return settings.laid_over(setting_layers(spark, sf_dir), "c_custkey", "layer", "text")


@query("""WITH s AS (SELECT p_partkey AS k, p_name AS n, p_size AS z FROM part)
SELECT k, CASE k % 4 WHEN 0 THEN 'a: ' || n || '; b: ' || z || 'px solid' WHEN 1 THEN 'x: none; y: ' || n || ' ' || z || 'px' WHEN 2 THEN 'loop: var(--loop)' ELSE '' END AS style,
  CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE 1 END AS rounds_, k % 4 = 2 AS open_, 'part ' || k || ' of {unknown}, ' || CASE WHEN k % 3 = 0 THEN '{size}' ELSE CAST(z AS VARCHAR) END AS label FROM s""")
def named_values(spark, sf_dir):
    """Styles with names in them, through chains, fallbacks and circles, and labels with tokens."""
    k = F.col("p_partkey")
    style = F.when(k % 4 == 0, "a: var(--name); b: var(--edge, 1px)").when(k % 4 == 1, "x: var(--missing, none); y: var(--long)").when(k % 4 == 2, "loop: var(--loop)").otherwise("var(--missing)")
    size = F.col("p_size").cast("string")
    values = F.create_map(F.lit("--name"), F.col("p_name"), F.lit("--edge"), F.lit("var(--width) solid"), F.lit("--width"), F.concat(size, F.lit("px")), F.lit("--long"), F.lit("var(--pair)"), F.lit("--pair"), F.lit("var(--name) var(--width, 3px)"), F.lit("--loop"), F.lit("var(--loop)"))
    tokens = F.when(k % 3 == 0, F.create_map(F.lit("id"), k.cast("string"), F.lit("seen"), F.lit("{size}"))).otherwise(F.create_map(F.lit("id"), k.cast("string"), F.lit("seen"), size))
    parts = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_size").select(k.alias("k"), style.alias("text"), values.alias("values"), settings.interpolated(F.lit("part {id} of {unknown}, {seen}"), tokens).alias("label"))
    return settings.with_values(parts, "text", "values", "style").select("k", "style", "rounds_", "open_", "label")


# --- candidates of all families


def mixed_leaves(spark, sf_dir):
    """Every supplier's document: a sentence that mixes money, law, dates, places, shares and names, a second leaf of another family, a heading; and an aside, a list or a table."""
    k = F.col("s_suppkey")
    name = F.element_at(F.array(F.lit("Green Valley"), F.lit("North River"), F.lit("Red Hill")), (1 + k % 3).cast("int"))
    said = F.concat(F.lit("In "), (1990 + k % 30).cast("string"), F.lit(", the "), name, F.lit(" Health Foundation awarded $"), (2 + k % 70).cast("string"), F.lit(" million to the "), name, F.lit(" School Project, and "), (11 + k % 80).cast("string"), F.lit("% of households in Ohio took part for many years of steady work under HB "), (100 + k).cast("string"), F.lit("."))
    other = F.element_at(F.array(F.lit("Does the plan that we made work? It does."), F.lit("She said “we must go on building homes for everyone” today."), F.lit("Nearly two-thirds of students read every day."), F.lit("Equity means fairness for all people.")), (1 + k % 4).cast("int"))
    leaf = lambda nid, page, ord_, kind, text: F.struct(F.lit(nid).alias("nid"), F.lit(page).alias("page"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), F.lit(2).alias("level"), text.alias("text"))
    rows = read(spark, sf_dir, "supplier", "s_suppkey")
    parts = F.array(leaf("a", 1, 1, "paragraph", said), leaf("b", 2, 2, "paragraph", other), leaf("h", 3, 3, "heading", F.when(k % 2 == 0, "Stories of Impact").otherwise("Board Members")))
    found = rows.select(k.alias("document_id"), F.explode(parts).alias("p")).select("document_id", "p.*").withColumns({"lead": F.lit(None).cast("int"), "quote_open": F.lit(False), "refs": F.when(F.col("nid") == "a", F.array(F.struct(F.lit(0).alias("s"), F.lit(2).alias("e"), F.lit("7").alias("v"))))})
    texts = F.when(k % 3 == 0, F.array(F.lit("We did it together."), F.concat(F.lit("Jane Smith, Director, "), name, F.lit(" Foundation")))).when(k % 3 == 1, F.array(F.lit("What is it that you do?"), F.lit("Why do you do it this way?"))).otherwise(F.array(F.concat(F.lit("Jobs: "), k.cast("string")), F.lit("Homes: 35 units")))
    held = rows.select(k.alias("document_id"), F.lit("c").alias("nid"), F.lit(4).alias("page"), F.when(k % 3 == 0, "aside").when(k % 3 == 1, "list").otherwise("table").alias("kind"), (k % 3 == 0).alias("quote"), F.lit(False).alias("header"), F.lit(False).alias("ordered"), texts.alias("texts"), F.lit(0).alias("open"))
    return found, held


@query("""WITH s AS (SELECT s_suppkey AS k, ['Green Valley', 'North River', 'Red Hill'][1 + s_suppkey % 3] AS n FROM supplier)
SELECT k AS document_id, x.t AS pattern_type, x.l AS layer, x.c AS confidence, x.v AS value FROM (SELECT k, unnest(list_concat([
  {'t': 'legal_reference', 'l': 0, 'c': 0.82, 'v': 'HB ' || (100 + k)}, {'t': 'funding_event', 'l': 1, 'c': 0.76, 'v': '$' || (2 + k % 70) || ' million'}, {'t': 'entity_relationship', 'l': 2, 'c': 0.62, 'v': n || ' Health Foundation -> ' || n || ' School Project'},
  {'t': 'date_time_period', 'l': 0, 'c': 0.78, 'v': CAST(1990 + k % 30 AS VARCHAR)}, {'t': 'geography_place', 'l': 0, 'c': 0.74, 'v': 'Ohio'}, {'t': 'statistic', 'l': 0, 'c': 0.72, 'v': (11 + k % 80) || '%'}, {'t': 'source_note_reference', 'l': 0, 'c': 0.92, 'v': '7'},
  {'t': 'named_entity', 'l': 0, 'c': 0.66, 'v': n || ' Health Foundation'}, {'t': 'named_entity', 'l': 0, 'c': 0.66, 'v': n || ' School Project'}, {'t': 'resource', 'l': 1, 'c': 0.68, 'v': n || ' School Project'},
  [{'t': 'question', 'l': 1, 'c': 0.82, 'v': 'Does the plan that we made work?'}, {'t': 'quotation', 'l': 0, 'c': 0.7, 'v': 'we must go on building homes for everyone'}, {'t': 'statistic', 'l': 0, 'c': 0.68, 'v': 'nearly two-thirds'}, {'t': 'definition', 'l': 1, 'c': 0.62, 'v': 'Equity'}][1 + k % 4]
], list_concat(CASE WHEN k % 2 = 0 THEN [{'t': 'callout_label', 'l': 1, 'c': 0.72, 'v': 'Stories of Impact'}, {'t': 'key_finding', 'l': 1, 'c': 0.62, 'v': 'Stories of Impact'}] ELSE [] END,
CASE k % 3 WHEN 0 THEN [{'t': 'callout', 'l': 1, 'c': 0.82, 'v': 'We did it together. Jane Smith, Director, ' || n || ' Foundation'}, {'t': 'quotation', 'l': 0, 'c': 0.84, 'v': 'We did it together.'}, {'t': 'named_entity', 'l': 0, 'c': 0.82, 'v': 'Jane Smith'}, {'t': 'named_entity', 'l': 0, 'c': 0.78, 'v': n || ' Foundation'}, {'t': 'entity_relationship', 'l': 2, 'c': 0.78, 'v': 'Jane Smith -> ' || n || ' Foundation'}]
WHEN 1 THEN [{'t': 'question_list', 'l': 2, 'c': 0.84, 'v': 'What is it that you do?'}]
ELSE [{'t': 'comparison_table', 'l': 2, 'c': 0.86, 'v': 'Jobs: ' || k || ' Homes: 35 units'}, {'t': 'metric_cluster', 'l': 2, 'c': 0.76, 'v': k || ', 35 units'}] END))) AS x FROM s)""")
def all_candidates(spark, sf_dir):
    """Every candidate of every family, of documents that mix them in one line."""
    found = scan.candidates(*mixed_leaves(spark, sf_dir))
    return found.select("document_id", "pattern_type", "layer", "confidence", "value")


@query()
def document_candidates(spark, sf_dir):
    """How many candidates of every family every document's own lines have."""
    rows = leaves(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("ord").cast("string").alias("nid"), F.floor(F.col("ord") / 20).cast("int").alias("page"), "ord", F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), F.col("line").alias("text"), F.lit(None).cast("int").alias("lead"), F.lit(False).alias("quote_open"), F.lit(None).cast("array<struct<s:int,e:int,v:string>>").alias("refs"))
    return scan.candidates(rows).groupBy("document_id", "pattern_type").agg(F.count(F.lit(1)).alias("n"))
