"""More registered queries: node trees, outlines, markers, gold texts, stages and workspaces, and the SQL that says the same.

Nodes are made of the lines of documents, alike on both sides: every second line
is a heading, of a level that changes every six lines; every seventh is a figure.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import sources
from .catalogue import LEAVES, leaves, query, read
from .operators import gold, graph, markers, outline, pages, platform

NODES_SQL = f"""{LEAVES}, nodes AS (SELECT doc_id, ord, CAST(ord // 4 AS INTEGER) AS page, CASE WHEN ord % 2 = 0 THEN 'heading' WHEN ord % 7 = 3 THEN 'figure' ELSE 'paragraph' END AS kind,
  CAST(1 + (ord // 6) % 3 AS INTEGER) AS level, CASE WHEN ord % 6 = 0 AND doc_id % 3 = 0 THEN 'Summary of ' || line ELSE line END AS text FROM leaves)"""


def nodes(spark, sf_dir):
    o, line = F.col("ord"), F.col("line")
    kind = F.when(o % 2 == 0, "heading").when(o % 7 == 3, "figure").otherwise("paragraph")
    text = F.when((o % 6 == 0) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("Summary of "), line)).otherwise(line)
    return leaves(spark, sf_dir).select("doc_id", "ord", F.floor(o / 4).cast("int").alias("page"), kind.alias("kind"), (1 + F.floor(o / 6) % 3).cast("int").alias("level"), text.alias("text"))


# --- trees and listings


@query("""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT 'section' AS kind, 0 AS depth, count(*) AS n, CAST(0 AS BIGINT) AS n_chars FROM documents UNION ALL SELECT 'paragraph', 1, count(*), sum(length(line)) FROM lines""")
def ir_nodes(spark, sf_dir):
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.lit("paragraph").alias("type"), x.alias("text")))
    tree = F.to_json(F.struct(F.array(F.struct(F.lit("section").alias("type"), F.col("doc_id").cast("string").alias("nid"), lines.alias("children"))).alias("body")))
    found, _ = sources.nodes(read(spark, sf_dir, "documents", "doc_id", "text"), F.col("doc_id"), tree)
    return found.groupBy("kind", "depth").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))


@query("SELECT lang, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1 AND l.quality = 1) GROUP BY lang")
def batch_included(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "lang").withColumn("slug", F.col("doc_id").cast("string"))
    value = F.when(F.col("quality") == 0, "{broken").otherwise(F.to_json(F.struct((F.col("toxic") == 1).alias("batch_excluded"))))
    sidecars = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("slug"), value.alias("value"))
    return sources.included(docs, sidecars).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'none-' ELSE 'd-' END || CAST(p_partkey AS VARCHAR) AS slug FROM part")
def resolved_slugs(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    path = F.concat(F.lit("in/"), F.lower("p_type"), F.lit("/"), key, F.lit(".pdf"))
    parts = read(spark, sf_dir, "part", "p_partkey", "p_type")
    documents = parts.select(F.concat(F.lit("d-"), key).alias("slug"), F.concat(F.lit("part "), key).alias("name"), path.alias("path"))
    k = F.col("p_partkey") % 4
    asked = parts.select("p_partkey", F.when(k == 0, F.concat(F.lit("d-"), key)).when(k == 1, path).when(k == 2, F.concat(key, F.lit(".pdf"))).otherwise(F.concat(F.lit("none-"), key)).alias("argument"))
    return sources.resolved(asked, documents).select("p_partkey", "slug")


# --- outlines


_HEADS = r"heads AS (SELECT doc_id, ord, level, trim(text) AS text FROM nodes WHERE kind = 'heading' AND NOT regexp_matches(text, '(?i)^\s*(figure|table|appendix|references|bibliography|acknowledg|notes?\b|endnotes|index)'))"


@query(f"""WITH {NODES_SQL}, {_HEADS}, lv AS (SELECT doc_id, level, count(*) AS n, min(ord) AS f FROM heads GROUP BY 1, 2),
c AS (SELECT doc_id, level, n, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n >= 3 THEN 0 ELSE 1 END, CASE WHEN n >= 3 THEN level ELSE -n END, f) AS r FROM lv),
l AS (SELECT h.doc_id, c.level, c.n, h.text, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.ord) AS k FROM heads h JOIN c ON h.doc_id = c.doc_id AND h.level = c.level WHERE c.r = 1)
SELECT doc_id, level, n, string_agg(text, '|' ORDER BY k) AS entries FROM l WHERE k <= 8 GROUP BY 1, 2, 3""")
def outline_contents(spark, sf_dir):
    return outline.contents(nodes(spark, sf_dir)).withColumn("entries", F.array_join("entries", "|"))


@query(f"""WITH {NODES_SQL}, f AS (SELECT doc_id, trim(text) AS t, min(ord) AS o FROM nodes WHERE kind = 'heading' AND level IN (2, 3) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k FROM f)
SELECT doc_id, string_agg(t, '|' ORDER BY k) AS highlights FROM r WHERE k <= 6 GROUP BY doc_id""")
def outline_highlights(spark, sf_dir):
    return outline.highlights(nodes(spark, sf_dir)).withColumn("highlights", F.array_join("highlights", "|"))


@query(f"""WITH {NODES_SQL}, u AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN regexp_matches(text, '(?i)\\b(abstract|executive\\s+summary|summary|overview|introduction)\\b') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS under FROM nodes),
r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN coalesce(under, false) AND length(text) > 80 THEN 0 WHEN length(text) >= 120 THEN 1 ELSE 2 END, ord) AS k FROM u WHERE kind = 'paragraph' AND text <> ''),
o AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM r WHERE k = 1), c AS (SELECT *, left(t, 400) AS c FROM o)
SELECT doc_id, CASE WHEN length(t) <= 400 THEN t WHEN regexp_matches(c, '[.!?]\\s') THEN regexp_extract(c, '(?s)^(.*[.!?])\\s', 1) ELSE rtrim(regexp_replace(c, ' [^ ]*$', '')) || '…' END AS summary FROM c""")
def outline_summary(spark, sf_dir):
    return outline.summary(nodes(spark, sf_dir))


@query(f"""WITH {NODES_SQL}, w AS (SELECT *, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS w FROM nodes),
i AS (SELECT doc_id, min(ord) AS o, arg_min(level, ord) AS lv FROM w WHERE kind = 'heading' AND w > 0 AND regexp_matches(text, '(?i)executive summary|abstract|overview|introduction') GROUP BY doc_id),
s AS (SELECT i.doc_id, o, min(CASE WHEN w.kind = 'heading' AND w.level <= lv THEN w.ord END) AS stop FROM i LEFT JOIN w ON w.doc_id = i.doc_id AND w.ord > o GROUP BY 1, 2)
SELECT w.doc_id, CAST(sum(w) AS BIGINT) AS words, count(*) FILTER (WHERE kind = 'heading' AND w > 0) AS headings, CASE WHEN max(page) > 0 THEN max(page) ELSE greatest(1, CAST(round_even(sum(w) / 450, 0) AS BIGINT)) END AS pages,
  CASE WHEN s.doc_id IS NOT NULL THEN coalesce(CAST(sum(CASE WHEN w.ord > o AND (stop IS NULL OR w.ord < stop) THEN w END) AS BIGINT), 0) END AS intro_words FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id, s.doc_id""")
def outline_profile(spark, sf_dir):
    return outline.profile(nodes(spark, sf_dir)).select("doc_id", "words", "headings", "pages", "intro_words")


@query(f"""WITH {NODES_SQL}, e AS (SELECT user_id AS doc_id, CAST(event_id % 5 AS INTEGER) AS page, event_type, CAST(event_id % 4 AS INTEGER) AS ncols, value FROM events),
b AS (SELECT doc_id, page, count(*) FILTER (WHERE kind = 'figure') AS n_figure, count(*) FILTER (WHERE kind = 'paragraph') AS n_paragraph, count(*) FILTER (WHERE kind = 'heading') AS n_heading, 0 AS r_error, 0 AS r_click, NULL AS ncols, NULL AS confidence FROM nodes GROUP BY 1, 2
 UNION ALL SELECT doc_id, page, 0, 0, 0, count(*) FILTER (WHERE event_type = 'error'), count(*) FILTER (WHERE event_type = 'click'), max(ncols), min(value) FROM e GROUP BY 1, 2)
SELECT doc_id, page, CAST(sum(n_figure) AS BIGINT) AS n_figure, CAST(sum(n_paragraph) AS BIGINT) AS n_paragraph, CAST(sum(n_heading) AS BIGINT) AS n_heading, CAST(sum(r_error) AS BIGINT) AS r_error, CAST(sum(r_click) AS BIGINT) AS r_click, max(ncols) AS ncols, min(confidence) AS confidence FROM b GROUP BY 1, 2""")
def outline_signals(spark, sf_dir):
    heard = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 5).cast("int").alias("page"), F.col("event_type").alias("reason"), (F.col("event_id") % 4).cast("int").alias("ncols"), F.col("value").alias("confidence"))
    return outline.page_signals(nodes(spark, sf_dir), heard, ("figure", "paragraph", "heading"), ("error", "click"))


_KEY = r"trim(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\s+[0-9]{1,4}$', ''))"


@query(f"""WITH {LEAVES}, b AS (SELECT doc_id, ord, CASE ord % 3 WHEN 0 THEN 'Annual Report Of Works ' || CAST(ord AS VARCHAR) WHEN 1 THEN 'Annual Report Of Works ' || line ELSE line END AS text FROM leaves),
k AS (SELECT doc_id, {_KEY} AS h, regexp_extract_all({_KEY}, '[A-Za-z][A-Za-z''’-]*') AS w FROM b),
h AS (SELECT doc_id, h FROM (SELECT *, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) AS caps FROM k) WHERE NOT regexp_matches(h, '[.!?]') AND len(w) BETWEEN 3 AND 12 AND caps >= 2 AND 2 * caps >= len(w) GROUP BY 1, 2 HAVING count(*) >= 3),
m AS (SELECT b.doc_id, b.ord, any_value(b.text) AS text, max(length(h.h)) AS cut FROM b LEFT JOIN h ON b.doc_id = h.doc_id AND (b.text = h.h OR starts_with(b.text, h.h || ' ')) GROUP BY 1, 2),
o AS (SELECT doc_id, ord, CASE WHEN cut IS NULL THEN text ELSE regexp_replace(trim(substr(text, cut + 1)), '^[0-9]{{1,4}}\\b\\s*', '') END AS text FROM m)
SELECT * FROM o WHERE text <> ''""")
def running_heads_removed(spark, sf_dir):
    o, head = F.col("ord"), F.lit("Annual Report Of Works ")
    text = F.when(o % 3 == 0, F.concat(head, o.cast("string"))).when(o % 3 == 1, F.concat(head, F.col("line"))).otherwise(F.col("line"))
    return outline.without_running_heads(leaves(spark, sf_dir).select("doc_id", "ord", text.alias("text")))


@query("""WITH s AS (SELECT l_suppkey AS doc_id, round_even(l_quantity / 3.0, 0) AS l, round_even(l_linenumber / 2.0, 0) AS b FROM lineitem)
SELECT doc_id, l, b, count(*) AS n FROM s GROUP BY 1, 2, 3 HAVING count(*) >= 4""")
def images_repeated(spark, sf_dir):
    x, y = F.col("l_quantity") / 3.0, F.col("l_linenumber") / 2.0
    images = read(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_quantity", "l_linenumber").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") % 11).alias("page"), x.alias("l"), y.alias("b"), x.alias("r"), y.alias("t"))
    pages = images.select("doc_id").distinct().withColumn("n_pages", F.lit(11))  # 0.4 of 11 rounds to 4
    return outline.repeated_images(images, pages).select("doc_id", "l", "b", "n")


@query("""WITH s AS (SELECT l_suppkey, l_linenumber, l_returnflag, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY w DESC, l_returnflag) AS k, sum(w) OVER (PARTITION BY l_suppkey, l_linenumber) AS total FROM s)
SELECT l_suppkey, l_linenumber, l_returnflag, round(w / total, 4) AS share FROM r WHERE k = 1""")
def styles_main(spark, sf_dir):
    return outline.main_styles(read(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity"), ["l_suppkey", "l_linenumber"], "l_returnflag", "l_quantity")


@query("""WITH g AS (SELECT l_suppkey, CAST(round(top - lead(top) OVER (PARTITION BY l_suppkey ORDER BY top DESC)) AS INTEGER) AS g FROM (SELECT l_suppkey, l_partkey % 97 + 0.5 AS top FROM lineitem)),
c AS (SELECT l_suppkey, g, count(*) AS n FROM g WHERE g > 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, g) AS k, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM c)
SELECT l_suppkey, g AS pitch FROM r WHERE k = 1 AND total >= 8 AND n >= 0.35 * total""")
def pitch_of_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").select("l_suppkey", (F.col("l_partkey") % 97 + 0.5).alias("top"))
    return outline.line_pitch(lines, ["l_suppkey"], "top")


@query(f"""WITH {NODES_SQL}, u AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used, lag(page) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM nodes WHERE text <> '')
SELECT doc_id, coalesce(string_agg(CASE WHEN before IS NOT DISTINCT FROM page THEN text ELSE '[page ' || CAST(page AS VARCHAR) || ']' || chr(10) || text END, chr(10) ORDER BY ord) FILTER (WHERE used <= 600), '') AS text, bool_and(used <= 600) AS whole FROM u GROUP BY doc_id""")
def linear_text(spark, sf_dir):
    return outline.text_of(nodes(spark, sf_dir), 600)


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY user_id")
def severity_counts(spark, sf_dir):
    return outline.severities(read(spark, sf_dir, "events", "user_id", "event_type"), ["user_id"], "event_type", ("click", "error"))


@query(f"""WITH {NODES_SQL}, i AS (SELECT doc_id, ord, 'n' || substr(sha1(concat_ws('|', kind, CAST(page AS VARCHAR), substr(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 1, 60))), 1, 10) AS base FROM nodes),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY ord) AS k FROM i) SELECT doc_id, ord, CASE WHEN k = 1 THEN base ELSE base || '-' || CAST(k AS VARCHAR) END AS node_id FROM k""")
def node_ids(spark, sf_dir):
    base = outline.content_id(F.col("kind"), F.col("page"), F.col("text"))
    return outline.with_ids(nodes(spark, sf_dir), base, ["ord"], ["doc_id"]).select("doc_id", "ord", "node_id")


@query(f"""WITH {LEAVES}, s AS (SELECT doc_id, ord, regexp_replace(substr(regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60), '-$', '') AS s FROM leaves),
k AS (SELECT doc_id, ord, CASE s WHEN '' THEN 'section' ELSE s END AS s FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY ord) AS k FROM k) SELECT doc_id, ord, CASE WHEN k = 1 THEN s ELSE s || '-' || CAST(k AS VARCHAR) END AS heading_id FROM r""")
def heading_ids(spark, sf_dir):
    return outline.with_ids(leaves(spark, sf_dir), outline.heading_slug(F.col("line")), ["ord"], ["doc_id"], "heading_id").select("doc_id", "ord", "heading_id")


# --- markers and scalars


@query(r"""WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) || '. ' WHEN 1 THEN chr(97 + p_size % 26) || ') ' WHEN 2 THEN chr(65 + p_size % 26) || ' . ' WHEN 3 THEN 'Note: ' ELSE CAST(p_size + 100 AS VARCHAR) || '. ' END || p_name AS line FROM part),
m AS (SELECT *, regexp_extract(line, '^([0-9]{1,2}|[A-Za-z])\s?[.)]\s+', 1) AS mark FROM p)
SELECT p_partkey, CASE WHEN regexp_matches(mark, '[0-9]') THEN 'decimal' WHEN regexp_matches(mark, '[a-z]') THEN 'lower-alpha' ELSE 'upper-alpha' END AS style, CASE WHEN regexp_matches(mark, '[0-9]') THEN TRY_CAST(mark AS INTEGER) ELSE ascii(lower(mark)) - 96 END AS n, length(regexp_extract(line, '^(([0-9]{1,2}|[A-Za-z])\s?[.)]\s+)', 1)) AS "length" FROM m WHERE mark <> ''""")
def ordinal_markers(spark, sf_dir):
    k, size, letter = F.col("p_partkey") % 5, F.col("p_size"), lambda base: F.char((base + F.col("p_size") % 26).cast("long"))
    lead = F.when(k == 0, F.concat(size.cast("string"), F.lit(". "))).when(k == 1, F.concat(letter(97), F.lit(") "))).when(k == 2, F.concat(letter(65), F.lit(" . "))).when(k == 3, "Note: ").otherwise(F.concat((size + 100).cast("string"), F.lit(". ")))
    made = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_name").select("p_partkey", markers.ordinal_marker(F.concat(lead, F.col("p_name"))).alias("m"))
    return made.where("m IS NOT NULL").select("p_partkey", "m.style", "m.n", "m.length")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 3 AS k, 1 + p_size % 20 AS r, chr(97 + p_size % 26) AS c, p_size FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN r WHEN k = 1 AND c = 'i' THEN 1 WHEN k = 1 AND c = 'v' THEN 5 WHEN k = 1 AND c = 'x' THEN 10 WHEN k = 1 THEN 1000 + ascii(c) - 96 ELSE p_size END AS "value", CASE WHEN k = 1 AND c NOT IN ('i', 'v', 'x') THEN c WHEN k = 1 THEN CASE c WHEN 'i' THEN '1' WHEN 'v' THEN '5' ELSE '10' END WHEN k = 0 THEN CAST(r AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS label FROM p""")
def marker_values(spark, sf_dir):
    k, size = F.col("p_partkey") % 3, F.col("p_size")
    raw = F.when(k == 0, F.concat(F.upper(markers.roman(1 + size % 20)), F.lit("."))).when(k == 1, F.concat(F.char((97 + size % 26).cast("long")), F.lit(")"))).otherwise(F.concat(F.lit(" "), size.cast("string")))
    value = markers.marker_value(raw)
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", value.alias("value"), markers.marker_label(value).alias("label"))


@query("""WITH d AS (SELECT DISTINCT user_id, day(ts) AS d FROM events), g AS (SELECT *, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g FROM d), s AS (SELECT user_id, min(d) AS a, max(d) AS b FROM g GROUP BY user_id, g)
SELECT user_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) END, ', ' ORDER BY a) AS runs FROM s GROUP BY user_id""")
def day_runs(spark, sf_dir):
    return markers.number_runs(read(spark, sf_dir, "events", "user_id", "ts").select("user_id", F.dayofmonth("ts").alias("d")), ["user_id"], "d")


@query(r"""WITH o AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), p AS (SELECT *, position('tion' IN lower(t)) AS p FROM o), c AS (SELECT doc_id, t, greatest(1, p - 30) AS a, least(length(t), p + 3 + 30) AS b FROM p WHERE p > 0)
SELECT doc_id, CASE WHEN a > 1 THEN '...' ELSE '' END || trim(t[a:b]) || CASE WHEN b < length(t) THEN '...' ELSE '' END AS context FROM c""")
def term_contexts(spark, sf_dir):
    found = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", markers.context(F.col("text"), F.lit("tion"), 60).alias("context"))
    return found.where("context IS NOT NULL")


@query("SELECT page_id, md5(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM pages")
def html_escaped(spark, sf_dir):
    return read(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.md5(markers.escaped(F.col("html"))).alias("digest"))


@query("""WITH p AS (SELECT p_partkey, p_brand, ['Bold', 'Light', 'SemiBold', 'Medium', 'Regular', 'Black'][1 + p_size % 6] AS w, p_size FROM part)
SELECT p_partkey, p_brand || '-' || w AS font, CASE w WHEN 'Bold' THEN 700 WHEN 'Light' THEN 300 WHEN 'SemiBold' THEN 600 WHEN 'Medium' THEN 500 WHEN 'Black' THEN 800 ELSE 400 END AS weight, CASE WHEN least(p_size * 5, 200 + p_size) <= 225 THEN printf('#%02x%02xff', p_size * 5, 200 + p_size) END AS colour FROM p""")
def fonts_and_colours(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("Bold", "Light", "SemiBold", "Medium", "Regular", "Black")])
    name = F.concat(F.lit("ABCDEF+"), F.col("p_brand"), F.lit("-"), F.element_at(names, 1 + F.col("p_size") % 6))
    colour = markers.hex_colour(F.col("p_size") * 5, 200 + F.col("p_size"), F.lit(255))
    return read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").select("p_partkey", markers.font_name(name).alias("font"), markers.font_weight(name).alias("weight"), markers.usable_colour(colour).alias("colour"))


# --- gold texts and stages

_GOLD_SQL = f"""{LEAVES}, c AS (SELECT doc_id, doc_id * 1000 + ord AS candidate_id, ord, 'k' || CAST(ord % 3 AS VARCHAR) AS kind, CASE WHEN ord % 4 <> 3 THEN ord // 4 END AS page, line AS text FROM leaves),
g AS (SELECT doc_id, doc_id * 1000 + ord AS gold_id, 'k' || CAST(ord % 4 AS VARCHAR) AS kind, CASE WHEN ord % 2 = 0 THEN ord // 4 END AS page, CASE WHEN ord % 5 = 4 THEN 'zzz nothing' ELSE replace(substr(line, 5, 20), ' ', '  ') END AS text, ord % 4 <> 1 AS expected FROM leaves),
h AS (SELECT g.gold_id, c.candidate_id, row_number() OVER (PARTITION BY g.gold_id ORDER BY c.ord) AS r FROM (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM g) g JOIN (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM c) c ON g.doc_id = c.doc_id AND g.kind = c.kind WHERE (g.page IS NULL OR c.page IS NULL OR g.page = c.page) AND (g.t = '' OR contains(c.t, g.t) OR contains(g.t, c.t))),
m AS (SELECT g.*, h.candidate_id, h.candidate_id IS NOT NULL AS matched FROM g LEFT JOIN h ON g.gold_id = h.gold_id AND h.r = 1)"""


def _gold(spark, sf_dir):
    o, lines = F.col("ord"), leaves(spark, sf_dir)
    id_, page = F.col("doc_id") * 1000 + o, F.floor(o / 4)
    held = lines.select("doc_id", id_.alias("candidate_id"), "ord", F.concat(F.lit("k"), (o % 3).cast("string")).alias("kind"), F.when(o % 4 != 3, page).alias("page"), F.col("line").alias("text"))
    text = F.when(o % 5 == 4, "zzz nothing").otherwise(F.replace(F.substring("line", 5, 20), F.lit(" "), F.lit("  ")))
    asked = lines.select("doc_id", id_.alias("gold_id"), F.concat(F.lit("k"), (o % 4).cast("string")).alias("kind"), F.when(o % 2 == 0, page).alias("page"), text.alias("text"), (o % 4 != 1).alias("expected"))
    return asked, held


@query(f"WITH {_GOLD_SQL} SELECT gold_id, matched, candidate_id FROM m")
def gold_matches(spark, sf_dir):
    return gold.gold_match(*_gold(spark, sf_dir)).select("gold_id", "matched", "candidate_id")


@query(f"""WITH {_GOLD_SQL}, w AS (SELECT doc_id, round(count(*) FILTER (WHERE found) / count(*), 3) AS type_recall FROM (SELECT DISTINCT doc_id, kind, (doc_id, kind) IN (SELECT (doc_id, kind) FROM c) AS found FROM g WHERE expected) GROUP BY 1),
a AS (SELECT doc_id, round(avg(CASE WHEN expected THEN CAST(matched AS INTEGER) END), 3) AS hit_rate, count(*) FILTER (WHERE NOT expected AND matched) AS negative_hits, count(*) FILTER (WHERE expected) AS gold_count FROM m GROUP BY 1)
SELECT a.*, w.type_recall FROM a LEFT JOIN w USING (doc_id)""")
def gold_rates(spark, sf_dir):
    asked, held = _gold(spark, sf_dir)
    return gold.gold_rates(gold.gold_match(asked, held), held)


@query("SELECT count(*) FILTER (WHERE o = t) AS same_kind, count(*) FILTER (WHERE o <> t) AS other_kind, count(*) FILTER (WHERE o IS NULL) AS alone FROM (SELECT event_type AS t, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'click' ELSE 'error' END AS o FROM events)")
def overlap_kinds(spark, sf_dir):
    k = F.col("event_id") % 3
    found = read(spark, sf_dir, "events", "event_id", "event_type").withColumn("other", F.when(k == 1, "click").when(k == 2, "error"))
    return gold.overlap_counts(found, "event_type", "other")


@query("SELECT min(o_orderkey) AS o_orderkey, o_orderpriority, o_custkey % 50 AS about FROM orders GROUP BY o_orderpriority, o_custkey % 50")
def statistics_once(spark, sf_dir):
    quote = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "About, ").otherwise("ABOUT "), F.col("about").cast("string"), F.lit("!"))
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_custkey").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 50).alias("about"))
    return gold.first_statistics(orders, "o_orderpriority", quote, "o_orderkey")


_ONE = r"trim(regexp_replace(line, '\s+', ' ', 'g'))"


@query(f"""WITH {LEAVES}, n AS (SELECT doc_id, ord, {_ONE} AS line FROM leaves), a AS (SELECT doc_id AS check_id, doc_id, 0 AS i, line AS a FROM n WHERE ord = 0 UNION ALL SELECT doc_id, doc_id, 1, line FROM n WHERE ord = 2 UNION ALL SELECT doc_id, doc_id, 2, 'lost text' FROM n WHERE ord = 0 AND doc_id % 5 = 0),
s AS (SELECT check_id, i, EXISTS (SELECT 1 FROM n WHERE n.doc_id = a.doc_id AND contains(n.line, a.a)) AS was, EXISTS (SELECT 1 FROM n WHERE n.doc_id = a.doc_id AND n.ord % 2 = 1 AND contains(n.line, a.a)) AS still FROM a),
p AS (SELECT check_id, i, CASE WHEN NOT was THEN 'lost' WHEN still THEN 'kept' ELSE 'claimed' END AS place FROM s)
SELECT check_id, bool_and(place = 'claimed') AS passed, arg_min(place, CASE WHEN place = 'claimed' THEN 99 ELSE i END) AS place FROM p GROUP BY check_id""")
def claimed_texts(spark, sf_dir):
    lines = leaves(spark, sf_dir).select("doc_id", "ord", F.col("line").alias("text"))
    asked = lines.groupBy("doc_id").agg(F.max(F.when(F.col("ord") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("ord") == 2, F.col("text"))).alias("b"))
    lost = F.when(F.col("a").isNotNull() & (F.col("doc_id") % 5 == 0), "lost text")
    rows = asked.select(F.col("doc_id").alias("check_id"), "doc_id", F.filter(F.array("a", "b", lost), lambda x: x.isNotNull()).alias("args")).where("size(args) > 0")
    return gold.claimed(rows, lines, lines.where("ord % 2 = 1"))


# --- workspaces

_GRANTS_SQL = """g AS (SELECT c_nationkey AS workspace, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS feature, CASE WHEN o_orderkey % 4 = 0 THEN 'plan' || CAST(o_orderkey % 12 AS VARCHAR) END AS plan, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS allowed, o_orderdate AS f, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 400 DAY END AS u FROM orders JOIN customer ON o_custkey = c_custkey),
v AS (SELECT * FROM g WHERE f <= TIMESTAMP '1996-06-01' AND (u IS NULL OR u > TIMESTAMP '1996-06-01')), plans AS (SELECT 'plan' || CAST(n_nationkey % 12 AS VARCHAR) AS plan, 'seats ' || n_name AS feature, CASE WHEN n_nationkey % 6 <> 0 THEN n_nationkey END AS allowed FROM nation),
e AS (SELECT workspace, feature, allowed FROM v WHERE feature IS NOT NULL UNION ALL SELECT workspace, p.feature, p.allowed FROM v JOIN plans p ON v.plan = p.plan),
features AS (SELECT workspace, feature, CASE WHEN NOT bool_or(allowed IS NULL) THEN max(allowed) END AS "limit" FROM e GROUP BY 1, 2)"""


def _features(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate").join(read(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    begun = F.col("o_orderdate").cast("timestamp_ntz")
    grants = orders.select(F.col("c_nationkey").alias("workspace"), F.when(key % 3 != 0, F.col("o_orderpriority")).alias("feature"), F.when(key % 4 == 0, F.concat(F.lit("plan"), (key % 12).cast("string"))).alias("plan"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("allowed"), begun.alias("valid_from"), F.when(key % 5 != 0, begun + F.expr("INTERVAL 400 DAYS")).alias("valid_until"))
    n = F.col("n_nationkey")
    plans = read(spark, sf_dir, "nation", "n_nationkey", "n_name").select(F.concat(F.lit("plan"), (n % 12).cast("string")).alias("plan"), F.concat(F.lit("seats "), F.col("n_name")).alias("feature"), F.when(n % 6 != 0, n).cast("bigint").alias("allowed"))
    return platform.workspace_features(grants, plans, F.lit("1996-06-01 00:00:00").cast("timestamp_ntz"))


@query(f"WITH {_GRANTS_SQL} SELECT * FROM features")
def workspace_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query(f"""WITH {_GRANTS_SQL}, r AS (SELECT c_nationkey AS workspace, CASE c_custkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' ELSE 'none' END AS feature, c_custkey AS used FROM customer)
SELECT r.used, CASE WHEN f.workspace IS NULL THEN 'no_entitlement' WHEN r.used >= f."limit" THEN 'limit_reached' ELSE 'allowed' END AS state FROM r LEFT JOIN features f ON r.workspace = f.workspace AND r.feature = f.feature""")
def quota_states(spark, sf_dir):
    k = F.col("c_custkey") % 3
    asked = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(F.col("c_nationkey").alias("workspace"), F.when(k == 0, "1-URGENT").when(k == 1, "5-LOW").otherwise("none").alias("feature"), F.col("c_custkey").alias("used"))
    return platform.within_quota(asked, _features(spark, sf_dir)).select("used", "state")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 THEN 'cancelled' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'running' END AS status FROM orders) GROUP BY status")
def jobs_cancelled(spark, sf_dir):
    jobs = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").withColumn("status", F.when(F.col("o_orderstatus") == "O", "queued").otherwise("running"))
    return platform.cancelled(jobs, jobs.where("o_custkey % 2 = 0"), "o_orderkey", "status").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND (event_id % 7 = 0 OR ts < TIMESTAMP '2024-01-20' - INTERVAL 3600 SECOND)")
def jobs_lost(spark, sf_dir):
    jobs = read(spark, sf_dir, "events", "event_id", "ts", "event_type").select("event_id", F.when(F.col("event_type") == "click", "running").otherwise("queued").alias("status"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("beat"))
    return platform.lost_jobs(jobs, "status", "beat", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 3600).select("event_id")


@query("""WITH p AS (SELECT o_custkey AS k, o_orderkey % 3 AS v, o_orderpriority AS b, o_orderkey AS line FROM orders), w AS (SELECT k, arg_min(b, line) AS b FROM p WHERE v = k % 3 GROUP BY k)
SELECT c_custkey AS k, c_custkey % 3 + CASE WHEN w.k IS NULL THEN 0 ELSE 1 END AS v, coalesce(w.b, 'held') AS b FROM customer LEFT JOIN w ON c_custkey = w.k""")
def state_versions(spark, sf_dir):
    held = read(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 3).alias("v"), F.lit("held").alias("b"))
    puts = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderpriority").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 3).alias("v"), F.col("o_orderpriority").alias("b"), F.col("o_orderkey").alias("line"))
    return platform.put_if_current(held, puts, "k", "v", "b")[0]


@query("""WITH h AS (SELECT DISTINCT 'lever' || CAST(l_linenumber % 4 AS VARCHAR) AS lever, l_suppkey % 40 AS target, CAST(l_suppkey % 2 AS VARCHAR) AS "value" FROM lineitem WHERE l_suppkey % 40 < 15),
a AS (SELECT o_orderkey AS line, 'lever' || CAST(o_orderkey % 5 AS VARCHAR) AS lever, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 3 END AS page, o_custkey % 40 AS target, CAST(o_custkey % 2 AS VARCHAR) AS "value", o_orderkey % 3 AS from_page FROM orders),
x AS (SELECT *, lever <> 'lever4' AS known, page IS NULL OR page = from_page AS scoped FROM a), b AS (SELECT lever, target, list("value") AS vs FROM h GROUP BY 1, 2), f AS (SELECT lever, target, arg_min("value", line) AS v1, min(line) AS l1 FROM x WHERE known AND scoped GROUP BY 1, 2)
SELECT line, CASE WHEN NOT known OR NOT scoped THEN 'refused' WHEN vs IS NOT NULL THEN CASE WHEN list_contains(vs, "value") THEN 'repeated' ELSE 'refused' END WHEN line > l1 THEN CASE WHEN "value" = v1 THEN 'repeated' ELSE 'refused' END ELSE 'applied' END AS outcome,
CASE WHEN NOT known THEN 'unknown lever' WHEN NOT scoped THEN 'other page' WHEN vs IS NOT NULL AND NOT list_contains(vs, "value") THEN 'flips' WHEN vs IS NULL AND line > l1 AND "value" <> v1 THEN 'flips' END AS why FROM x LEFT JOIN b USING (lever, target) LEFT JOIN f USING (lever, target)""")
def overrides_judged(spark, sf_dir):
    lever = lambda n: F.concat(F.lit("lever"), n.cast("string"))
    held = read(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber").where("l_suppkey % 40 < 15").select(lever(F.col("l_linenumber") % 4).alias("lever"), (F.col("l_suppkey") % 40).alias("target"), (F.col("l_suppkey") % 2).cast("string").alias("value"))
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    asked = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(key.alias("line"), lever(key % 5).alias("lever"), F.when(key % 7 != 0, who % 3).alias("page"), (who % 40).alias("target"), (who % 2).cast("string").alias("value"), (key % 3).alias("from_page"))
    return platform.prescribed(held, asked, [f"lever{k}" for k in range(4)]).select("line", "outcome", "why")


# --- pages

_SIGNALS_SQL = """s AS (SELECT source AS doc_id, doc_id AS page, CASE WHEN doc_id % 31 = 0 THEN 1 ELSE 0 END AS hero, CASE WHEN doc_id % 11 = 0 THEN 1 END AS n_tables, doc_id % 5 // 3 AS n_callouts, n_chars % 6 AS n_figures, CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS n_asides, 1 + n_chars % 2 AS ncols, (n_chars % 10) / 10.0 AS colconf, n_chars % 3 // 2 AS fig_anatomy FROM documents)"""


def _signals(spark, sf_dir):
    i, n = F.col("doc_id"), F.col("n_chars")
    none = [F.lit(0).alias(c) for c in ("label_soup", "assembled", "grown", "dissolve", "questions", "uncertain", "n_lists")]
    made = [F.when(i % 31 == 0, 1).otherwise(0).alias("hero"), F.when(i % 11 == 0, 1).alias("n_tables"), F.floor(i % 5 / 3).alias("n_callouts"), (n % 6).alias("n_figures"), F.when(F.col("lang") == "de", 1).otherwise(0).alias("n_asides"), (1 + n % 2).alias("ncols"), (n % 10 / 10).alias("colconf"), F.floor(n % 3 / 2).alias("fig_anatomy")]
    return read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars").select(F.col("source").alias("doc_id"), i.alias("page"), *made, *none, (i % 9 == 0).alias("scanned"))


@query(f"WITH {_SIGNALS_SQL} SELECT page, CASE WHEN hero > 0 OR coalesce(n_tables, 0) >= 1 OR n_callouts >= 2 OR n_figures > 4 OR (ncols >= 2 AND colconf < 0.55) THEN 'hard' WHEN n_figures >= 2 OR n_callouts >= 1 OR n_asides >= 1 OR (n_figures = 1 AND fig_anatomy > 0) THEN 'moderate' ELSE 'easy' END AS class FROM s")
def page_classes(spark, sf_dir):
    return _signals(spark, sf_dir).select("page", pages.page_class().alias("class"))


@query()
def pages_to_scan(spark, sf_dir):
    return pages.pages_to_scan(_signals(spark, sf_dir))


@query("SELECT o_orderpriority AS label, o_orderstatus AS kind, count(*) AS mentions, count(DISTINCT o_custkey) AS n_documents FROM orders GROUP BY 1, 2")
def graph_mentions(spark, sf_dir):
    mentions = read(spark, sf_dir, "orders", "o_orderpriority", "o_orderstatus", "o_custkey").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("label"), "o_custkey")
    return graph.nodes(mentions, "kind", "label", "o_custkey").drop("id")


@query()
def figure_captions(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    x, y = F.col("l_quantity").cast("double"), (F.col("l_partkey") % 97).cast("double")
    boxes = d.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block"), x.alias("l"), y.alias("b"), (x + 20).alias("r"), (y + 10).alias("t"), F.when(F.col("l_partkey") % 3 == 0, "Figure 1: it").otherwise("text").alias("text"), F.when(F.col("l_partkey") % 2 == 0, 8.0).otherwise(10.0).alias("size"))
    return pages.captions(boxes.where("block <= 3").withColumnRenamed("block", "figure"), boxes.where("block > 3"), 10.0)


@query("""WITH n AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, CASE WHEN o_orderkey % 5 = 0 THEN 'paragraph' ELSE 'list' END AS kind, CASE WHEN o_orderkey % 7 = 0 THEN 1.0 ELSE 0.1 END AS b, CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 0.9 END AS t FROM orders),
m AS (SELECT *, coalesce(kind = 'list' AND lag(kind) OVER w = 'list' AND lag(b) OVER w < 0.22 AND t > 0.78, false) AS m, lag(ord) OVER w AS up FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
r AS (SELECT *, page - max(CASE WHEN NOT m THEN page END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM m) SELECT ord, CASE WHEN m AND run % 2 = 1 THEN up END AS "into" FROM r""")
def lists_over_breaks(spark, sf_dir):
    key = F.col("o_orderkey")
    made = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("doc_id"), key.alias("ord"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"), F.when(key % 5 == 0, "paragraph").otherwise("list").alias("kind"), F.lit(False).alias("ordered"), F.when(key % 7 == 0, 1.0).otherwise(0.1).alias("b"), F.when(key % 4 == 0, 0.5).otherwise(0.9).alias("t"), F.lit(1.0).alias("height"))
    return pages.lists_over_breaks(made).select("ord", "into")
