"""The registered queries of the engine's own operators, and the SQL that says the same.

Each query reads whole tables from sf_dir and applies an operator of this
package. Where the driver's prose has nothing for a detector to find, sentences
are made from typed columns, alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions, streaming
from .operators import checks, detectors, evidence, geometry, graph, logs, match, pages, patterns, platform, runs, sequence, text, toc, tree, validate, windows
from .plans.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "leaves_by_lang"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as leaves: doc_id, lang, source, ord, line."""
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "source", "text")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line")).where(F.trim("line") != "")


LEAVES = """leaves AS (
  SELECT doc_id, lang, source, i - 1 AS ord, ls[i] AS line FROM (
    SELECT *, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents)
  ) WHERE trim(ls[i]) <> ''
)"""


# --- scans and leaves


@query(f"WITH {LEAVES} SELECT lang, count(*) AS n_leaves, sum(length(line)) AS n_chars FROM leaves GROUP BY lang")
def leaves_by_lang(spark, sf_dir):
    return leaves(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n_leaves"), F.sum(F.length("line")).alias("n_chars"))


@query(f"WITH {LEAVES} SELECT source, count(*) AS n_leaves, sum(len(regexp_extract_all(line, '{text.NUMBER}', 1))) AS n_numbers FROM leaves GROUP BY source")
def numeric_candidates(spark, sf_dir):
    return leaves(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_leaves"), F.sum(F.size(text.extract_all(F.col("line"), text.NUMBER))).alias("n_numbers"))


# by source, over all documents; for DuckDB each separator is doubled, as its patterns can't look around
@query(f"WITH {LEAVES} SELECT source, term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, source, unnest(regexp_extract_all('  ' || regexp_replace(line, '[^\\p{{L}}\\p{{N}}_]', '  ', 'g') || '  ', ' ([A-Z]{{2,6}}) ', 1)) AS term FROM leaves) GROUP BY source, term")
def acronym_terms(spark, sf_dir):
    found = leaves(spark, sf_dir).select("doc_id", "source", F.explode(text.extract_all(F.col("line"), text.ACRONYM_ANY)).alias("term"))
    return found.groupBy("source", "term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"WITH {LEAVES} SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all('  ' || regexp_replace(line, '[^\\p{{L}}\\p{{N}}_]', '  ', 'g') || '  ', ' ([A-Z]{{2,6}}) ', 1)) AS term FROM leaves) GROUP BY term")
def acronym_terms_all(spark, sf_dir):
    found = leaves(spark, sf_dir).select("doc_id", F.explode(text.extract_all(F.col("line"), text.ACRONYM_ANY)).alias("term"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"""WITH {LEAVES}, r AS (SELECT source, line, count(DISTINCT doc_id) AS n_docs FROM leaves GROUP BY source, line HAVING count(DISTINCT doc_id) >= 3)
SELECT l.source, count(*) AS n_kept FROM leaves l ANTI JOIN r ON l.source = r.source AND l.line = r.line GROUP BY l.source""")
def running_header_strip(spark, sf_dir):
    return pages.without_repeated_lines(leaves(spark, sf_dir), "source", "line", "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_kept"))


@query(f"""WITH {LEAVES}, p AS (SELECT doc_id, line, lead(line) OVER (PARTITION BY doc_id ORDER BY ord) AS following FROM leaves)
SELECT doc_id, count(*) AS n_broken FROM p WHERE regexp_matches(line, '[a-z,]\\s*$') AND regexp_matches(following, '^\\s*[a-z]') GROUP BY doc_id""")
def broken_pairs(spark, sf_dir):
    following = F.lead("line").over(windows.Window.partitionBy("doc_id").orderBy("ord"))
    pairs = leaves(spark, sf_dir).withColumn("following", following)
    return pairs.where(F.col("line").rlike(r"[a-z,]\s*$") & F.col("following").rlike(r"^\s*[a-z]")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_broken"))


# --- detectors over made sentences

FUNDING_SQL = """sentences AS (
  SELECT o_orderkey AS id, c_name || ' Foundation awarded $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' million to Relief Works on ' || strftime(o_orderdate, '%B %-d, %Y') || '.' AS s
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def funding_sentences(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    named = orders.join(read(spark, sf_dir, "customer", "c_custkey", "c_name"), orders.o_custkey == F.col("c_custkey"))
    return named.select(F.col("o_orderkey").alias("id"), F.concat(F.col("c_name"), F.lit(" Foundation awarded $"), F.floor("o_totalprice").cast("bigint").cast("string"), F.lit(" million to Relief Works on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(".")).alias("s"))


@query(f"WITH {FUNDING_SQL} SELECT id, regexp_extract(s, '{text.MONEY.replace(chr(39), chr(39) * 2)}', 1) AS amount, regexp_extract(s, '{text.DATE}', 1) AS at, regexp_extract(s, ' to ([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)+)', 1) AS recipient FROM sentences WHERE regexp_matches(s, '{text.FUNDING}')")
def funding_events(spark, sf_dir):
    s = F.col("s")
    return funding_sentences(spark, sf_dir).where(s.rlike(text.FUNDING)).select("id", F.regexp_extract(s, text.MONEY, 1).alias("amount"), F.regexp_extract(s, text.DATE, 1).alias("at"), F.regexp_extract(s, " to ([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)+)", 1).alias("recipient"))


@query(f"WITH {FUNDING_SQL} SELECT regexp_extract(regexp_extract(s, '{text.DATE}', 1), '^([A-Za-z]+)', 1) AS month, count(*) AS n FROM sentences GROUP BY 1")
def date_periods(spark, sf_dir):
    month = F.regexp_extract(F.regexp_extract("s", text.DATE, 1), "^([A-Za-z]+)", 1)
    return funding_sentences(spark, sf_dir).groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT CASE l_linenumber % 6 WHEN 0 THEN 'H.R. ' || CAST(l_partkey AS VARCHAR) WHEN 1 THEN '42 U.S.C. ' || CAST(l_suppkey AS VARCHAR) WHEN 2 THEN '§ ' || CAST(l_linenumber AS VARCHAR) WHEN 3 THEN '552(a)(' || CAST(l_linenumber AS VARCHAR) || ')' WHEN 4 THEN 'hb 12' ELSE 'Section 5(a)' END AS ref FROM lineitem)
SELECT CASE WHEN regexp_matches(lower(ref), '^(hb|sb|hr|h\\.r\\.|s\\.)\\s*\\d+') THEN 'bill_number' WHEN contains(lower(ref), 'usc') OR contains(lower(ref), 'u.s.c') THEN 'statute' WHEN starts_with(ref, '§') THEN 'section' WHEN regexp_matches(ref, '^\\d{2,4}\\s*(?:\\([a-zA-Z0-9]+\\)){1,4}$') THEN 'legal_subsection' ELSE 'legal_reference' END AS kind, count(*) AS n FROM r GROUP BY 1""")
def legal_references(spark, sf_dir):
    n, text_of = F.col("l_linenumber") % 6, lambda c: F.col(c).cast("string")
    ref = (
        F.when(n == 0, F.concat(F.lit("H.R. "), text_of("l_partkey")))
        .when(n == 1, F.concat(F.lit("42 U.S.C. "), text_of("l_suppkey")))
        .when(n == 2, F.concat(F.lit("§ "), text_of("l_linenumber")))
        .when(n == 3, F.concat(F.lit("552(a)("), text_of("l_linenumber"), F.lit(")")))
        .when(n == 4, F.lit("hb 12"))
        .otherwise("Section 5(a)")
    )
    return read(spark, sf_dir, "lineitem", "l_linenumber", "l_partkey", "l_suppkey").groupBy(evidence.legal_kind(ref).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN regexp_matches(lower(s), 'backlog|need') THEN 'need' WHEN regexp_matches(lower(s), 'economic impact|touched|served|reached|helped|created|generated') THEN 'accomplishment' WHEN regexp_matches(lower(s), 'known funding|average grant|funding went|foundation funding') THEN 'funding_summary' ELSE 'impact' END AS kind, count(*) AS n
FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'We served ' WHEN 'O' THEN 'Families need ' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Known funding for ' ELSE 'Change for ' END END || o_orderpriority AS s FROM orders) GROUP BY 1""")
def impact_types(spark, sf_dir):
    lead = F.when(F.col("o_orderstatus") == "F", "We served ").when(F.col("o_orderstatus") == "O", "Families need ").when(F.col("o_orderkey") % 2 == 0, "Known funding for ").otherwise("Change for ")
    return read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").groupBy(evidence.impact_kind(F.concat(lead, F.col("o_orderpriority"))).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT s_suppkey, regexp_extract(t, '{text.LABEL_VALUE}', 1) AS label, regexp_extract(t, '{text.LABEL_VALUE}', 2) AS value FROM (SELECT s_suppkey, 'Account balance: ' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS t FROM supplier)")
def label_values(spark, sf_dir):
    t = F.concat(F.lit("Account balance: "), F.floor("s_acctbal").cast("bigint").cast("string"))
    return read(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").select("s_suppkey", F.regexp_extract(t, text.LABEL_VALUE, 1).alias("label"), F.regexp_extract(t, text.LABEL_VALUE, 2).alias("value"))


@query("SELECT role, count(*) AS n_turns, count(*) FILTER (WHERE regexp_matches(s, '\\?\\s*$')) AS n_questions FROM (SELECT role, text || CASE WHEN turn % 3 = 0 THEN '?' ELSE '.' END AS s FROM conversations) GROUP BY role")
def questions(spark, sf_dir):
    s = F.concat("text", F.when(F.col("turn") % 3 == 0, "?").otherwise("."))
    return read(spark, sf_dir, "conversations", "role", "turn", "text").groupBy("role").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(s.rlike(text.QUESTION)).alias("n_questions"))


@query(f"WITH {FUNDING_SQL} SELECT entity, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(s, '{text.CAPITALISED}', 1))[1:6]) AS entity FROM sentences) GROUP BY entity")
def entity_candidates(spark, sf_dir):
    return funding_sentences(spark, sf_dir).select(F.explode(text.entities(F.col("s"))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


# --- evidence rules, over statements that meet them and statements that don't

#: {n} is the part's number.
STATEMENTS = [
    "The program served {n} families in West Virginia, Ohio and New York.",
    "We should increase the budget by {n} percent.",
    "Smith et al. wrote of this in volume {n}(2), 11-19.",
    "See p. 12/13 of the {n} filing.",
    "Visit www.example.org/page{n} to learn more.",
    "Have you met number {n}?",
    "For example, number {n} took part.",
    "Suppose {n} people came.",
    "A grant is defined as support of {n} dollars.",
    "Applicants need at least {n} points.",
    "Survey respondents from {n} towns took part.",
    "We asked {n} questions of everyone.",
    "Annual Giving Report",
    "Table {n} shows the methodology.",
    "The sample size was n={n}.",
    "Community Health Project",
    "Policy in Action",
    "Harbor Relief Foundation awarded ${n} million to Delta Health Network for shelters.",
    "The total of ${n} was funding to projects.",
    "A fee waiver for grant {n} was asked for.",
    "This report was made possible by Harbor Relief Foundation and {n} donors.",
    "Graphics and layout by Studio Works Company, number {n} in the work.",
    "Data from generous data sharing by Metro Transit Agency, {n} files, for the project.",
    "Our mission is to end the backlog of {n} cases because families wait, and the need to act is plain for children.",
    "Why shelter number {n} matters so that children among us can sleep.",
    "About two-thirds of the workforce left in month {n}.",
    "It rained for half a day in {n}.",
    "In the first half of {n} the share grew by one-third.",
    "Civic Data Toolkit: a set of {n} tables.",
    "They used the Rural Housing Resource Guide for {n} months.",
    "Director of the Civic Data Toolkit, number {n}",
    "Indicator: The term Housing Burden typically means costs above {n} percent of income.",
    "This means that {n} people left.",
    "Equity, which means fairness to {n} groups, is our aim.",
    "Key finding: number {n} grew.",
    "How families find shelter number {n}",
    "Jane Q. Doe",
    "Executive Director",
    "J.D.",
    "Plain words about number {n}.",
]


def statements(spark, sf_dir):
    """id, kind (place in STATEMENTS) and s of every part."""
    kind = (F.col("p_partkey") % len(STATEMENTS)).cast("int")
    s = F.replace(F.element_at(F.array(*[F.lit(x) for x in STATEMENTS]), kind + 1), F.lit("{n}"), F.col("p_partkey").cast("string"))
    return read(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("id"), kind.alias("kind"), s.alias("s"))


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _m(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {_sql(pattern)})"


def _x(c: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({c}, {_sql(pattern)}, {group}), '')"


STATEMENTS_SQL = f"""st AS (SELECT id, kind, s, lower(s) AS low, regexp_extract(s, '^(.+?(?:[.!?](?:\\s|$)|$))', 1) AS f FROM (
  SELECT p_partkey AS id, CAST(p_partkey % {len(STATEMENTS)} AS INTEGER) AS kind, replace([{", ".join(map(_sql, STATEMENTS))}][CAST(p_partkey % {len(STATEMENTS)} AS INTEGER) + 1], '{{n}}', CAST(p_partkey AS VARCHAR)) AS s FROM part))"""
CLEAN_ENTITY = "trim({}, ' ,;:.')"
CITED = f"({_m('low', patterns.CITATION_WORDS)} OR {_m('s', patterns.CITATION_VOLUME)} OR ({_m('low', patterns.CITATION_PAGE)} AND contains(s, '/')))"
ASKED = f"(contains(s, '?') OR {_m('low', patterns.QUESTION_LEADS)} OR {_m('low', patterns.QUESTION_PHRASES)})"
CHARTED = f"({_m('low', patterns.CHART_LEADS)} OR {_m('low', patterns.METHODOLOGY)})"
METADATA = f"(length(s) >= 20 AND NOT {CITED} AND NOT {_m('s', patterns.URL_LIKE)} AND NOT {ASKED} AND {_m('s', patterns.REPORT_METADATA)})"
GATES_SQL = {
    "url": _m("s", patterns.URL_LIKE),
    "asked": ASKED,
    "example": f"({_m('low', patterns.EXAMPLE_LEADS)} OR {_m('low', patterns.EXAMPLE_PHRASES)})",
    "rule": f"({_m('low', patterns.DEFINITIONAL)} OR {_m('low', patterns.THRESHOLDS)})",
    "survey": f"({_m('low', patterns.SURVEY_SUBJECTS)} OR {_m('low', patterns.SURVEY_METHODS)})",
    "title": f"(length(e) <= 120 AND (({_m('lower(e)', patterns.PUBLICATIONS)} AND NOT {_m('lower(e)', patterns.PUBLICATION_VERBS)}) OR (len(string_split(e, ' ')) <= 8 AND {_m('e', '[A-Z]')} AND NOT {_m('e', '(^|[^A-Za-z])[a-z]|[A-Za-z][A-Z]')} AND NOT {_m('e', '[.!?]')} AND {_m('e', patterns.RESOURCE_HINT)})))",
    "chart": CHARTED,
    "cited": CITED,
    "impact_defined": _m("s", patterns.DEFINITION_LIKE_IMPACT),
    "resource_name": _m("s", patterns.RESOURCE_HINT),
    "resource_only": _m("s", patterns.RESOURCE_ONLY),
    "callout": f"(list_contains([{', '.join(map(_sql, patterns.CALLOUT_LABELS))}], lower(e)) OR (len(string_split(e, ' ')) <= 5 AND {_m('lower(e)', patterns.CALLOUT_CUES)}))",
    "recommended": f"(NOT contains(f, '?') AND {_m('f', patterns.RECOMMENDATION)})",
    "action": f"({_m('s', patterns.ACTION_START)} OR {_m('s', patterns.RECOMMENDATION)})",
    "finding": _m("s", patterns.KEY_FINDING),
    "funding": f"({_m('s', patterns.FUNDING_CONTEXT)} AND NOT {_m('s', patterns.FUNDING_NEGATIVE)})",
    "funding_event": f"(NOT {METADATA} AND NOT {_m('s', patterns.FUNDING_SUMMARY)} AND NOT {_m('s', patterns.FUNDING_ADVICE)} AND {_m('s', patterns.FUNDING_ACTION)})",
    "metadata": METADATA,
    "strong": _m("s", patterns.STRONG_METRIC),
    "credential": _m("s", r"^(?:[A-Z]\.){1,4}$"),
    "person": f"(len(string_split(s, ' ')) BETWEEN 2 AND 4 AND len(list_filter(string_split(s, ' '), lambda w: NOT regexp_matches(trim(w, '.'), '^[A-Z][A-Za-z.''’-]+$'))) = 0 AND NOT len(list_filter(string_split(low, ' '), lambda w: NOT list_contains([{', '.join(map(_sql, evidence.ROLES + evidence.ROLE_MODIFIERS))}], trim(w, '.,')))) = 0)",
}
GATES = {
    "url": evidence.is_url_like, "asked": evidence.is_question, "example": evidence.is_example, "rule": evidence.is_rule_or_threshold, "survey": evidence.is_survey_admin, "title": evidence.is_publication_title, "chart": evidence.is_chart_or_methodology,
    "cited": evidence.is_citation_like, "impact_defined": evidence.is_definition_like_impact, "resource_name": evidence.is_resource_name, "resource_only": evidence.is_resource_only_name, "callout": evidence.is_callout_label, "recommended": evidence.is_recommendation,
    "action": evidence.is_action_item, "finding": evidence.is_key_finding, "funding": evidence.is_funding_context, "funding_event": evidence.is_funding_event, "metadata": lambda s: evidence.report_metadata(s).isNotNull(), "strong": evidence.is_strong_metric,
    "credential": evidence.is_credential, "person": evidence.is_person,
}


@query(f"WITH {STATEMENTS_SQL}, g AS (SELECT *, {CLEAN_ENTITY.format('s')} AS e FROM st) SELECT kind, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {v}) AS {k}' for k, v in GATES_SQL.items())} FROM g GROUP BY kind")
def evidence_gates(spark, sf_dir):
    s = F.col("s")
    return statements(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f(s)).alias(k) for k, f in GATES.items()])


@query(f"WITH {STATEMENTS_SQL}, g AS (SELECT *, {CLEAN_ENTITY.format('s')} AS e FROM st) SELECT id FROM g WHERE NOT ({' OR '.join(GATES_SQL[k] for k in ('url', 'asked', 'example', 'rule', 'survey', 'title', 'chart', 'cited'))})")
def evidence_leaves(spark, sf_dir):
    return statements(spark, sf_dir).where(evidence.is_evidence(F.col("s"))).select("id")


@query(f"""WITH {STATEMENTS_SQL} SELECT id,
  CASE WHEN {_m('low', 'writer:|contributors include|graphics and layout by')} THEN 'production_credit' WHEN {_m('low', 'data sharing|data collected by')} THEN 'data_or_research_support' WHEN {_m('low', 'support|supported by|made possible by')} THEN 'supporter' ELSE 'report_context' END AS metadata_type,
  CASE WHEN contains(low, 'pro bono support') THEN 'pro_bono_supporter' WHEN {_m('low', 'data sharing|data collected by')} THEN 'data_provider' WHEN contains(low, 'graphics and layout') THEN 'designer' WHEN contains(low, 'writer:') THEN 'writer' WHEN contains(low, 'contributors include') THEN 'contributor' WHEN {_m('low', 'support|made possible')} THEN 'supporter' END AS role,
  CASE WHEN contains(low, 'project') THEN 'project' WHEN contains(low, 'work') THEN 'work' ELSE 'report' END AS applies_to
FROM st WHERE {METADATA}""")
def report_credits(spark, sf_dir):
    found = statements(spark, sf_dir).withColumn("m", evidence.report_metadata(F.col("s"))).where("m IS NOT NULL")
    return found.select("id", "m.metadata_type", "m.role", "m.applies_to")


@query(f"""WITH {STATEMENTS_SQL} SELECT id, f AS statement_text, trim({_x('f', patterns.PURPOSE_PROBLEM)}) AS problem, {_x('f', patterns.PURPOSE_STAKES)} AS stakes, {_x('f', patterns.BENEFICIARIES)} AS audience
FROM st WHERE length(f) >= 40 AND NOT {CHARTED} AND NOT {CITED} AND {_m('f', patterns.PURPOSE)} AND NOT {_m('f', patterns.ADVICE)}""")
def purpose_statements(spark, sf_dir):
    found = statements(spark, sf_dir).withColumn("p", evidence.purpose_statement(F.col("s"))).where("p IS NOT NULL")
    return found.select("id", "p.statement_text", "p.problem", "p.stakes", "p.audience")


VALUED = f"({_m('f', patterns.NUMBER)} OR {_m('f', patterns.MONEY)} OR {_m('f', patterns.MAGNITUDE)})"


@query(f"""WITH {STATEMENTS_SQL} SELECT id, CASE WHEN {_m('lower(f)', 'backlog|need')} THEN 'need' WHEN {_m('lower(f)', 'economic impact|touched|served|reached|helped|created|generated')} THEN 'accomplishment' WHEN {_m('lower(f)', 'known funding|average grant|funding went|foundation funding')} THEN 'funding_summary' ELSE 'impact' END AS impact_type,
  coalesce({_x('f', patterns.MONEY)}, trim({_x('f', patterns.NUMBER)}), {_x('f', patterns.MAGNITUDE)}) AS value, {_x('f', patterns.BENEFICIARIES)} AS beneficiaries
FROM st WHERE length(f) >= 30 AND NOT {CHARTED} AND NOT {_m('f', patterns.DEFINITION_LIKE_IMPACT)} AND {_m('f', patterns.IMPACT)} AND ({VALUED} OR (NOT (contains(f, ',') AND {_m('f', patterns.ROLE_HINT)}) AND {_m('f', patterns.IMPACT_NEED)}))""")
def impact_statements(spark, sf_dir):
    found = statements(spark, sf_dir).withColumn("i", evidence.impact_statement(F.col("s"))).where("i IS NOT NULL")
    return found.select("id", "i.impact_type", "i.value", "i.beneficiaries")


PLAUSIBLE = f"length(name) BETWEEN 5 AND 120 AND NOT {_m('lower(name)', patterns.RESOURCE_LEADS)} AND NOT {_m('lower(name)', patterns.RESOURCE_PEOPLE)} AND {_m('name', patterns.RESOURCE_HINT)}"


@query(f"""WITH {STATEMENTS_SQL}, l AS (SELECT *, regexp_extract(s, {_sql(patterns.LABEL_VALUE)}, 1) AS label FROM st WHERE NOT {CITED}),
n AS (SELECT *, {CLEAN_ENTITY.format("CASE WHEN " + _m("label", patterns.RESOURCE_HINT) + " THEN label ELSE regexp_extract(s, " + _sql(patterns.RESOURCE_PHRASE) + ", 1) END")} AS name FROM l)
SELECT id, name AS resource_name, CASE {' '.join(f"WHEN contains(lower(name), '{k}') THEN '{'grant_program' if k == 'grant' else k}'" for k in patterns.RESOURCE_KINDS)} ELSE 'resource' END AS resource_type FROM n WHERE {PLAUSIBLE} AND NOT list_contains([{', '.join(map(_sql, patterns.CALLOUT_LABELS))}], lower(name))""")
def resources_named(spark, sf_dir):
    found = statements(spark, sf_dir).withColumn("r", evidence.resource(F.col("s"))).where("r IS NOT NULL")
    return found.select("id", "r.resource_name", "r.resource_type")


BARE_TERM = _x("s", patterns.WHICH_MEANS)
TERM = f"coalesce({_x('s', patterns.WHICH_MEANS)}, {_x('s', patterns.DEFINITION)})"
MEANS = f"CASE WHEN {_m('s', patterns.WHICH_MEANS)} THEN {_x('s', patterns.WHICH_MEANS, 2)} ELSE {_x('s', patterns.DEFINITION, 2)} END"


@query(f"""WITH {STATEMENTS_SQL}, t AS (SELECT id, {CLEAN_ENTITY.format(TERM)} AS a, trim({MEANS}) AS definition FROM st),
u AS (SELECT id, definition, {CLEAN_ENTITY.format(f"regexp_replace(regexp_replace(regexp_replace(a, {_sql(patterns.TERM_PREFIX)}, ''), '(?i)^(?:a|an|the)\\s+', ''), {_sql(patterns.TERM_QUALIFIER)}, '')")} AS term FROM t WHERE a IS NOT NULL)
SELECT id, term, definition FROM u WHERE term <> '' AND NOT list_contains([{', '.join(map(_sql, patterns.TERM_PRONOUNS + patterns.TERM_GENERIC))}], lower(term)) AND NOT list_contains([{', '.join(map(_sql, patterns.TERM_PRONOUNS))}], string_split(lower(term), ' ')[1])
  AND len(string_split(term, ' ')) <= 8 AND NOT (NOT {_m('term', '[A-Z]')} AND (len(string_split(term, ' ')) > 3 OR {_m('lower(term)', patterns.TERM_VERBS)})) AND NOT (upper(term) <> term AND {_m('lower(term)', patterns.TERM_VERBS_CASED)}) AND NOT {_m('lower(definition)', patterns.DEFINITION_SKIPS)}""")
def definitions(spark, sf_dir):
    found = statements(spark, sf_dir).withColumn("d", evidence.definition(F.col("s"))).where("d IS NOT NULL")
    return found.select("id", "d.term", "d.definition")


@query(f"WITH {STATEMENTS_SQL} SELECT place, count(*) AS n FROM (SELECT unnest(regexp_extract_all(s, {_sql(evidence.PLACES)}, 1)) AS place FROM st) GROUP BY place")
def places_named(spark, sf_dir):
    return statements(spark, sf_dir).select(F.explode(evidence.places(F.col("s"))).alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STATEMENTS_SQL} SELECT id, v AS value FROM (SELECT id, unnest(list_transform(regexp_extract_all(s, {_sql(patterns.WORD_STAT)}, 1), lambda x: lower(x))) AS v FROM st WHERE {_m('s', patterns.WORD_STAT_CONTEXT)} AND NOT {_m('s', patterns.WORD_STAT_IDIOM)})")
def worded_shares(spark, sf_dir):
    return statements(spark, sf_dir).select("id", F.explode(evidence.word_stats(F.col("s"))).alias("value"))


@query(f"""WITH {STATEMENTS_SQL}, e AS (SELECT id, {CLEAN_ENTITY.format('x')} AS entity FROM (SELECT id, unnest(regexp_extract_all(s, {_sql(patterns.ENTITY_PHRASE)}, 1)) AS x FROM st))
SELECT id, entity, CASE WHEN {_m('lower(entity)', patterns.ENTITY_ORGANIZATION)} THEN 'organization' WHEN {_m('lower(entity)', patterns.ENTITY_LAW)} THEN 'law_or_policy' WHEN {_m('lower(entity)', patterns.ENTITY_PROGRAM)} THEN 'program_or_initiative' ELSE 'entity' END AS entity_type FROM (SELECT DISTINCT * FROM e)
WHERE length(entity) BETWEEN 4 AND 90 AND NOT list_contains([{', '.join(map(_sql, patterns.ENTITY_STOPS))}], entity) AND NOT (upper(entity) = entity AND len(string_split(entity, ' ')) <= 3)
  AND len(list_filter(string_split(entity, ' '), lambda w: list_contains([{', '.join(map(_sql, patterns.ENTITY_SUFFIXES))}], trim(w, '.,')))) > 0""")
def entities_typed(spark, sf_dir):
    entity = F.explode(evidence.entities(F.col("s"))).alias("entity")
    return statements(spark, sf_dir).select("id", entity).select("id", "entity", evidence.entity_kind(F.col("entity")).alias("entity_type"))


# --- logs

EVENT_LOG_SQL = "log AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def event_log(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).drop("props")


@query(f"WITH {EVENT_LOG_SQL} SELECT user_id, k, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE user_id IS NOT NULL AND k IS NOT NULL) WHERE rn = 1")
def latest_decision(spark, sf_dir):
    return logs.latest(event_log(spark, sf_dir), ["user_id", "k"], "ts", "event_id").select("user_id", "k", "event_id", "event_type")


@query(f"WITH {EVENT_LOG_SQL} SELECT user_id, k, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS decisions, arg_max(event_type, (ts, event_id)) AS latest, count(*) AS n_rows FROM log GROUP BY user_id, k HAVING count(DISTINCT event_type) > 1")
def decision_conflicts(spark, sf_dir):
    found = logs.conflicts(event_log(spark, sf_dir), ["user_id", "k"], "event_type", "ts", "event_id")
    return found.withColumn("decisions", F.concat_ws(",", "decisions"))


@query("SELECT lang, count(*) AS reviewed, count(*) FILTER (WHERE quality = 1) AS accepted, count(*) FILTER (WHERE quality = 0 AND doc_id % 3 > 0) AS rejected, count(*) FILTER (WHERE quality = 0 AND doc_id % 3 = 0) AS review_gap, round(count(*) FILTER (WHERE quality = 1) / count(*), 3) AS acceptance_rate FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def type_quality(spark, sf_dir):
    log = read(spark, sf_dir, "labels", "doc_id", "quality").join(read(spark, sf_dir, "documents", "doc_id", "lang"), "doc_id")
    poor, open_ = F.col("quality") == 0, F.col("doc_id") % 3 == 0
    return logs.quality(log, "lang", F.col("quality") == 1, poor & ~open_, poor & open_)


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id)")
def decision_rollup(spark, sf_dir):
    return logs.rollup_counts(read(spark, sf_dir, "events", "event_type", "user_id"), "event_type", "user_id")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def recent_findings(spark, sf_dir):
    return logs.recent(read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts"), "ts", "event_id", 30).drop("ts")


@query("SELECT l.doc_id, quality FROM labels l ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON l.doc_id = d.doc_id")
def stale_reviews(spark, sf_dir):
    current = read(spark, sf_dir, "documents", "doc_id", "lang").where("lang = 'en'")
    return logs.stale(read(spark, sf_dir, "labels", "doc_id", "quality"), current, ["doc_id"])


@query(f"WITH {EVENT_LOG_SQL} SELECT value, count(*) AS n FROM (SELECT unnest([event_type, 'k' || CAST(k AS VARCHAR)]) AS value FROM log) WHERE value IS NOT NULL GROUP BY value ORDER BY n DESC, value LIMIT 20")
def reason_topk(spark, sf_dir):
    reasons = F.filter(F.array("event_type", F.concat(F.lit("k"), F.col("k").cast("string"))), lambda x: x.isNotNull())
    return logs.top_values(event_log(spark, sf_dir), reasons, 20)


@query("SELECT user_id, coalesce(c.total, h.total) AS total FROM (SELECT user_id, count(*) AS total FROM events GROUP BY user_id) h FULL JOIN (SELECT user_id, -1 AS total FROM events WHERE event_type = 'purchase' GROUP BY user_id) c USING (user_id)")
def feedback_upsert(spark, sf_dir):
    events = read(spark, sf_dir, "events", "user_id", "event_type")
    held = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    changes = events.where("event_type = 'purchase'").select("user_id").distinct().withColumn("total", F.lit(-1).cast("long"))
    return logs.upsert(held, changes, "user_id")


# --- matching

TOKENS_SQL = "list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda x: length(x) > 2))"


@query(f"""WITH a AS (SELECT item_id, unnest(t) AS t, len(t) AS n FROM (SELECT item_id, {TOKENS_SQL} AS t FROM benchmark)),
b AS (SELECT doc_id, unnest(t) AS t, len(t) AS n FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)),
s AS (SELECT item_id, doc_id, CASE WHEN least(any_value(a.n), any_value(b.n)) >= 4 THEN greatest(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), count(*) / least(any_value(a.n), any_value(b.n)) * 0.85) ELSE count(*) / (any_value(a.n) + any_value(b.n) - count(*)) END AS score FROM a JOIN b ON a.t = b.t GROUP BY item_id, doc_id)
SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM s) WHERE rn = 1""")
def best_overlap(spark, sf_dir):
    return match.best_overlap(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents", "doc_id", "text"), "item_id", "doc_id")


@query("SELECT coalesce(o_orderkey, l_orderkey) AS orderkey, CASE WHEN l_orderkey IS NULL THEN 'left_only' WHEN o_orderkey IS NULL THEN 'right_only' ELSE 'both' END AS status FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F') FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey")
def reconcile_full(spark, sf_dir):
    left = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("orderkey"))
    right = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("orderkey"))
    return match.reconcile(left, right, "orderkey")


@query("""SELECT e.event_id, (SELECT arg_max(p.value, (p.ts, p.event_id)) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) AS nearest FROM events e WHERE e.event_type = 'click'""")
def nearest_prior_event(spark, sf_dir):
    events = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    left = events.where("event_type = 'click'").select("event_id", "ts", "user_id")
    right = events.where("event_type = 'purchase'").select("event_id", "ts", "user_id", "value")
    return match.nearest_before(left, right, "user_id", "ts", "value", "event_id").select("event_id", "nearest")


@query()
def fuzzy_remap(spark, sf_dir):
    parts = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    old = parts.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "old_id")
    new = parts.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "new_id")
    return match.fuzzy_remap(old, new, ["p_brand", "p_type", "p_size"], "old_id", "new_id", "p_name")


# --- aggregates

@query("SELECT event_type, count(*) FILTER (WHERE day(ts) <= 10) AS d1, count(*) FILTER (WHERE day(ts) BETWEEN 11 AND 20) AS d2, count(*) FILTER (WHERE day(ts) > 20) AS d3, count(*) AS total FROM events GROUP BY event_type")
def pattern_matrix(spark, sf_dir):
    thirds = read(spark, sf_dir, "events", "event_type", "ts").select("event_type", F.least(F.ceil(F.dayofmonth("ts") / 10), F.lit(3)).cast("int").alias("d"))
    wide = thirds.groupBy("event_type").pivot("d", [1, 2, 3]).count().na.fill(0).toDF("event_type", "d1", "d2", "d3")
    return wide.join(thirds.groupBy("event_type").agg(F.count(F.lit(1)).alias("total")), "event_type")


@query(f"SELECT event_type, {', '.join(f'count(*) FILTER (WHERE day(ts) = {k}) AS d{k}' for k in range(1, 32))}, count(*) AS total FROM events GROUP BY event_type")
def pattern_matrix_days(spark, sf_dir):
    events = read(spark, sf_dir, "events", "event_type", "ts").select("event_type", F.dayofmonth("ts").alias("d"))
    return events.groupBy("event_type").agg(*[F.count_if(F.col("d") == k).alias(f"d{k}") for k in range(1, 32)], F.count(F.lit(1)).alias("total"))


@query(f"WITH {FUNDING_SQL} SELECT 'funding_event' AS pattern_type, count(*) AS n FROM sentences UNION ALL SELECT 'date_time_period', count(*) FROM sentences WHERE regexp_matches(s, '{text.DATE}') UNION ALL SELECT 'statistic', CAST(sum(len(regexp_extract_all(s, '{text.NUMBER}', 1))) AS BIGINT) FROM sentences")
def pattern_inventory(spark, sf_dir):
    s = F.col("s")
    counted = funding_sentences(spark, sf_dir).agg(F.count(F.lit(1)).alias("a"), F.count_if(s.rlike(text.DATE)).alias("b"), F.sum(F.size(text.extract_all(s, text.NUMBER))).alias("c"))
    return counted.select(F.expr("stack(3, 'funding_event', a, 'date_time_period', b, 'statistic', c) AS (pattern_type, n)"))


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_in, coalesce(b.n, 0) AS n_out, greatest(0, coalesce(a.n, 0) - coalesce(b.n, 0)) AS lost
FROM (SELECT o_orderkey % 100 AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT l_orderkey % 100 AS k, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1) b ON a.k = b.k""")
def audit_ledger(spark, sf_dir):
    a = read(spark, sf_dir, "orders", "o_orderkey").groupBy((F.col("o_orderkey") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").where("l_quantity > 10").groupBy((F.col("l_orderkey") % 100).alias("k")).agg(F.count_distinct("l_orderkey").alias("n"))
    return pages.ledger(a, b, "k")


TRIAGE_SQL = "triage AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_err, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1, 2), classed AS (SELECT *, CASE WHEN n_err >= 1 OR n >= 6 THEN 'hard' WHEN kinds >= 3 THEN 'moderate' ELSE 'easy' END AS class FROM triage)"


def triage(spark, sf_dir):
    days = read(spark, sf_dir, "events", "user_id", "ts", "event_type").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_err"), F.count_distinct("event_type").alias("kinds"))
    return days.withColumn("class", F.when((F.col("n_err") >= 1) | (F.col("n") >= 6), "hard").when(F.col("kinds") >= 3, "moderate").otherwise("easy"))


@query(f"WITH {TRIAGE_SQL} SELECT class, count(*) AS n_pages, sum(n) AS n_events FROM classed GROUP BY class")
def triage_class(spark, sf_dir):
    return triage(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n").alias("n_events"))


@query(f"WITH {TRIAGE_SQL} SELECT n_err, kinds, least(n, 5) AS bucket, count(*) AS n_pages, min(user_id) AS first_user FROM classed WHERE class = 'hard' GROUP BY 1, 2, 3")
def triage_clusters(spark, sf_dir):
    hard = triage(spark, sf_dir).where("class = 'hard'")
    return hard.groupBy("n_err", "kinds", F.least("n", F.lit(5)).alias("bucket")).agg(F.count(F.lit(1)).alias("n_pages"), F.min("user_id").alias("first_user"))


@query("""SELECT d.source, count(*) AS n_pages, count(l.doc_id) AS n_reviewed, count(*) FILTER (WHERE l.quality = 1) AS green, count(*) FILTER (WHERE l.quality = 0) AS red, count(*) FILTER (WHERE l.toxic = 1) AS flagged,
CASE WHEN count(l.doc_id) = 0 THEN 'open' WHEN count(*) FILTER (WHERE l.quality = 0) > 0 THEN 'failing' ELSE 'passing' END AS ring FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def scoreboard(spark, sf_dir):
    return pages.scoreboard(read(spark, sf_dir, "documents", "doc_id", "source"), read(spark, sf_dir, "labels"), "source", "doc_id", F.col("quality") == 1, F.col("quality") == 0, F.col("toxic") == 1)


# --- windows

@query("WITH s AS (SELECT l_returnflag, l_quantity, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_quantity, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY w DESC, l_quantity) AS rn FROM s) WHERE rn = 1")
def weighted_mode(spark, sf_dir):
    return windows.weighted_mode(read(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_linenumber"), "l_returnflag", "l_quantity", "l_linenumber")


@query("WITH s AS (SELECT l_shipmode, l_linenumber, sum(l_partkey) AS w FROM (SELECT l_linestatus || l_returnflag AS l_shipmode, l_linenumber, l_partkey FROM lineitem) GROUP BY 1, 2), t AS (SELECT *, w / sum(w) OVER (PARTITION BY l_shipmode) AS share FROM s) SELECT l_shipmode AS k, coalesce(min(l_linenumber) FILTER (WHERE share >= 0.15), min(l_linenumber)) AS l_linenumber FROM t GROUP BY 1")
def share_threshold_min(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_linestatus", "l_returnflag", "l_linenumber", "l_partkey").withColumn("k", F.concat("l_linestatus", "l_returnflag"))
    return windows.least_of_share(lines, "k", "l_linenumber", "l_partkey", 0.15)


@query("SELECT p_size, least(6, dense_rank() OVER (ORDER BY p_size DESC)) AS level FROM (SELECT DISTINCT p_size FROM part WHERE p_size > 20)")
def size_levels(spark, sf_dir):
    return windows.levels(read(spark, sf_dir, "part", "p_size"), "p_size", 20)


INTERVAL_SQL = "i AS (SELECT user_id, epoch_us(ts) // 1000000 AS lo, epoch_us(ts) // 1000000 + 21600 AS hi FROM events), f AS (SELECT *, CASE WHEN max(hi) OVER w IS NULL OR lo > max(hi) OVER w THEN 1 ELSE 0 END AS fresh FROM i WINDOW w AS (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f), m AS (SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY user_id, island)"


def sittings(spark, sf_dir):
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return read(spark, sf_dir, "events", "user_id", "ts").select("user_id", start.alias("lo"), (start + 21600).alias("hi"))


@query(f"WITH {INTERVAL_SQL} SELECT user_id, lo, hi, n FROM m")
def interval_merge(spark, sf_dir):
    return windows.merged_intervals(sittings(spark, sf_dir), "user_id", "lo", "hi")


@query(f"WITH {INTERVAL_SQL} SELECT * FROM (SELECT user_id, hi AS gap_lo, lead(lo) OVER (PARTITION BY user_id ORDER BY lo) AS gap_hi FROM m) WHERE gap_hi IS NOT NULL")
def interior_gaps(spark, sf_dir):
    return windows.interior_gaps(sittings(spark, sf_dir), "user_id", "lo", "hi")


@query("SELECT p_brand, p_retailprice, coalesce(sum(j) OVER (PARTITION BY p_brand ORDER BY p_retailprice), 0) AS cluster FROM (SELECT p_brand, p_retailprice, CASE WHEN p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) > 8 THEN 1 ELSE 0 END AS j FROM part)")
def gaps_islands(spark, sf_dir):
    return windows.chains(read(spark, sf_dir, "part", "p_brand", "p_retailprice"), "p_brand", "p_retailprice", 8)


@query("WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM d), r AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b FROM i GROUP BY l_orderkey, g) SELECT l_orderkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS runs FROM r GROUP BY l_orderkey")
def run_compress(spark, sf_dir):
    return windows.compressed_runs(read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM conversations) WHERE used <= 600")
def excerpt_budget(spark, sf_dir):
    return windows.within_budget(read(spark, sf_dir, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", F.length("text"), 600).drop("text")


@query("SELECT conv_id, turn, last_value(h IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section, first_value(h IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_section FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn END AS h FROM conversations)")
def section_bounds(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    return windows.sections(turns, "conv_id", "turn", F.col("role") == "user").drop("role")


@query("WITH p AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey END AS pin FROM orders), b AS (SELECT *, coalesce(last_value(pin IGNORE NULLS) OVER w, 0) AS rank_base, count(pin) OVER w AS block FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT o_custkey, o_orderkey, rank_base, row_number() OVER (PARTITION BY o_custkey, block ORDER BY o_orderkey) - 1 AS rank_step FROM b")
def interpolated_order(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderpriority")
    return windows.interpolated(orders, "o_custkey", "o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderkey"))).drop("o_orderpriority")


# --- trees and graphs

GEO_SQL = "geo AS (SELECT 'r' || r_regionkey AS nid, CAST(NULL AS VARCHAR) AS parent, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier)"


def geography(spark, sf_dir):
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    region = read(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("nid"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    nation = read(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("nid"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("label"))
    supplier = read(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("nid"), key("n", "s_nationkey").alias("parent"), F.col("s_name").alias("label"))
    return region.unionByName(nation).unionByName(supplier)


@query(f"WITH RECURSIVE {GEO_SQL}, t AS (SELECT nid, nid AS path, 0 AS depth FROM geo WHERE parent IS NULL UNION ALL SELECT g.nid, t.path || '/' || g.nid, t.depth + 1 FROM geo g JOIN t ON g.parent = t.nid) SELECT nid, path, depth FROM t")
def tree_paths(spark, sf_dir):
    return tree.with_paths(geography(spark, sf_dir)).select("nid", F.array_join("path", "/").alias("path"), "depth")


@query(f"WITH RECURSIVE {GEO_SQL}, t AS (SELECT nid, label, [nid] AS path FROM geo WHERE parent IS NULL UNION ALL SELECT g.nid, g.label, list_append(t.path, g.nid) FROM geo g JOIN t ON g.parent = t.nid), u AS (SELECT unnest(path) AS a, path, label FROM t) SELECT a AS nid, count(*) AS n, sum(length(label)) + count(*) - 1 AS n_chars FROM u GROUP BY a")
def subtree_text(spark, sf_dir):
    return tree.subtree(tree.with_paths(geography(spark, sf_dir)), "label").select("nid", "n", F.length("text").cast("long").alias("n_chars"))


@query("SELECT 'customer:' || c_mktsegment AS id, 'segment' AS kind, count(*) AS mentions, count(DISTINCT c_nationkey) AS n_documents FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'nation:' || n_name, 'nation', count(*), count(DISTINCT c_nationkey) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def graph_nodes(spark, sf_dir):
    mentions = read(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment").join(read(spark, sf_dir, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    both = F.filter(F.array(F.struct(F.concat(F.lit("customer:"), F.col("c_mktsegment")).alias("id"), F.lit("segment").alias("kind")), F.struct(F.concat(F.lit("nation:"), F.col("n_name")).alias("id"), F.lit("nation").alias("kind"))), lambda x: x["id"].isNotNull())
    return mentions.select(F.explode(both).alias("m"), "c_nationkey").groupBy("m.id", "m.kind").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("c_nationkey").alias("n_documents"))


@query("SELECT c_mktsegment AS source, n_name AS target, 'located_in' AS predicate, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def graph_edges(spark, sf_dir):
    mentions = read(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment").join(read(spark, sf_dir, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return mentions.groupBy(F.col("c_mktsegment").alias("source"), F.col("n_name").alias("target"), F.lit("located_in").alias("predicate")).agg(F.count(F.lit(1)).alias("n"))


# --- platform

@query("SELECT c_mktsegment, o_orderpriority AS feature, CASE WHEN bool_or(o_orderstatus = 'P') THEN NULL ELSE max(o_custkey) END AS \"limit\" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def entitlement_max(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_orderstatus").join(read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    grants = orders.select("c_mktsegment", F.col("o_orderpriority").alias("feature"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("allowed"))
    return platform.entitlements(grants, "c_mktsegment", "feature", "allowed")


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O') WHERE rn = 1")
def job_claim(spark, sf_dir):
    jobs = read(spark, sf_dir, "orders", "o_orderpriority", "o_orderkey", "o_orderdate", "o_orderstatus")
    return platform.next_jobs(jobs, "o_orderpriority", [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_orderstatus") == "O").select("o_orderpriority", "o_orderkey")


@query("SELECT event_id, attempt, CAST(30 * pow(2, attempt - 1) AS BIGINT) AS wait_s FROM (SELECT event_id, event_id % 3 + 1 AS attempt FROM events)")
def retry_backoff(spark, sf_dir):
    jobs = read(spark, sf_dir, "events", "event_id").withColumn("attempt", F.col("event_id") % 3 + 1)
    return jobs.select("event_id", "attempt", platform.retry_after(F.col("attempt")).alias("wait_s"))


@query("SELECT l_returnflag, sum(CASE l_returnflag WHEN 'A' THEN l_partkey / 1e6 * 3.0 + l_suppkey / 1e6 * 15.0 WHEN 'N' THEN l_partkey / 1e6 * 0.5 + l_suppkey / 1e6 * 2.5 END) AS cost, bool_and(l_returnflag IN ('A', 'N')) AS complete FROM lineitem GROUP BY 1")
def usage_cost(spark, sf_dir):
    usage = read(spark, sf_dir, "lineitem", "l_returnflag", "l_partkey", "l_suppkey").toDF("l_returnflag", "input_tokens", "output_tokens")
    rates = spark.createDataFrame([("A", 3.0, 15.0), ("N", 0.5, 2.5)], "l_returnflag string, input_rate double, output_rate double")
    return platform.usage_cost(usage, rates, "l_returnflag").groupBy("l_returnflag").agg(F.sum("cost").alias("cost"), F.bool_and(F.col("cost").isNotNull()).alias("complete"))


# --- HTML and tables

@query("SELECT lower(h) AS header, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, trim(unnest(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1))) AS h FROM pages) GROUP BY 1")
def html_headers(spark, sf_dir):
    heads = read(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.explode(text.extract_all(F.col("html"), "(?s)<h1[^>]*>(.*?)</h1>")).alias("h"))
    return heads.groupBy(F.lower(F.trim("h")).alias("header")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("n_pages"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%1%' OR lower(p_brand) LIKE '%1%' OR lower(p_type) LIKE '%1%'")
def any_column_search(spark, sf_dir):
    parts = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return parts.where(F.exists(F.array("p_name", "p_brand", "p_type"), lambda x: F.lower(x).contains("1"))).select("p_partkey")


# --- candidates

CANDIDATE_SQL = f"""{FUNDING_SQL}, found AS (
  SELECT id AS document_id, 'funding_event' AS pattern_type, unnest(list_distinct(regexp_extract_all(s, '{text.MONEY}', 1))) AS value FROM sentences WHERE regexp_matches(s, '{text.FUNDING}')
  UNION ALL SELECT id, 'date_time_period', unnest(list_distinct(regexp_extract_all(s, '{text.DATE}', 1))) FROM sentences
  UNION ALL SELECT id, 'named_entity', unnest(list_distinct(regexp_extract_all(s, '{text.CAPITALISED}', 1))[1:6]) FROM sentences
)"""


def found_candidates(spark, sf_dir):
    return detectors.candidates(funding_sentences(spark, sf_dir).withColumn("ord", F.lit(0)), "id", "ord", "s", ("funding_event", "date_time_period", "named_entity"))


@query(f"WITH {CANDIDATE_SQL} SELECT document_id, pattern_type, value, 'c_' || substr(sha1('[\"' || document_id || '\",\"' || pattern_type || '\",\"' || value || '\"]'), 1, 12) AS pattern_id FROM found")
def candidates(spark, sf_dir):
    return found_candidates(spark, sf_dir).select("document_id", "pattern_type", "value", "pattern_id")


@query(f"WITH {CANDIDATE_SQL} SELECT pattern_type, count(*) AS n, count(DISTINCT document_id) AS n_documents FROM found GROUP BY pattern_type")
def candidate_inventory(spark, sf_dir):
    return detectors.inventory(found_candidates(spark, sf_dir))


@query(f"WITH {CANDIDATE_SQL} SELECT document_id % 50 AS page, count(*) FILTER (WHERE pattern_type = 'funding_event') AS funding, count(*) FILTER (WHERE pattern_type = 'named_entity') AS entities FROM found GROUP BY 1")
def page_inventory(spark, sf_dir):
    pages = detectors.page_inventory(found_candidates(spark, sf_dir), F.col("document_id") % 50)
    return pages.select("page", F.coalesce(F.col("types")["funding_event"], F.lit(0)).alias("funding"), F.coalesce(F.col("types")["named_entity"], F.lit(0)).alias("entities"))


@query(f"""WITH {CANDIDATE_SQL}, c AS (SELECT *, CASE pattern_type WHEN 'funding_event' THEN 0.76 WHEN 'date_time_period' THEN 0.78 ELSE 0.66 END AS confidence, 'c_' || substr(sha1('["' || document_id || '","' || pattern_type || '","' || value || '"]'), 1, 12) AS pattern_id FROM found),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern_type ORDER BY confidence DESC, document_id, pattern_id) AS rn, count(*) OVER (PARTITION BY pattern_type) AS n FROM c)
SELECT pattern_type, any_value(n) AS n, string_agg(pattern_id, ',' ORDER BY rn) AS best FROM r WHERE rn <= 3 GROUP BY pattern_type""")
def review_focus(spark, sf_dir):
    return detectors.review_focus(found_candidates(spark, sf_dir)).withColumn("best", F.array_join("best", ","))


@query(f"""WITH {LEAVES}, e AS (SELECT doc_id, arg_min(line, ord) AS a, arg_max(line, ord) AS b FROM leaves GROUP BY doc_id), t AS (SELECT doc_id, ord, regexp_replace(lower(line), '[^a-z0-9]+', '', 'g') AS t FROM leaves),
c AS (SELECT doc_id, k, regexp_replace(lower(CASE k WHEN 0 THEN a WHEN 1 THEN 'no such text' ELSE a END), '[^a-z0-9]+', '', 'g') AS x, regexp_replace(lower(b), '[^a-z0-9]+', '', 'g') AS y FROM e, (SELECT unnest([0, 1, 2]) AS k)),
f AS (SELECT c.doc_id, k, min(CASE WHEN contains(t, x) THEN ord END) AS at_x, min(CASE WHEN contains(t, y) THEN ord END) AS at_y FROM c JOIN t ON c.doc_id = t.doc_id GROUP BY 1, 2)
SELECT doc_id * 10 + k AS check_id, ['in_flow', 'absent', 'order'][k + 1] AS kind, CASE k WHEN 0 THEN at_x IS NOT NULL WHEN 1 THEN at_x IS NULL ELSE coalesce(at_x < at_y, false) END AS passed FROM f""")
def assertion_results(spark, sf_dir):
    """In flow, absent and order, of every document that has a line: its whole first and last one."""
    lines = leaves(spark, sf_dir).withColumn("leaf", F.lit("paragraph"))
    ends = lines.groupBy("doc_id").agg(F.min_by("line", "ord").alias("a"), F.max_by("line", "ord").alias("b"))
    asked = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.array(*args).alias("args")) for k, (kind, *args) in enumerate((("in_flow", F.col("a")), ("absent", F.lit("no such text")), ("order", F.col("a"), F.col("b"))))])
    rows = ends.select("doc_id", F.explode(asked).alias("c")).select((F.col("doc_id") * 10 + F.col("c.k")).alias("check_id"), "doc_id", "c.kind", "c.args")
    return checks.results(rows, lines, "doc_id", "ord", "line", "leaf")


@query()
def assertion_checks(spark, sf_dir):
    """Every kind of check, of every document: its first and last leaf, whole; the document's first line is its heading."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    held = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    first, last = F.try_element_at(held, F.lit(1)), F.try_element_at(held, F.lit(-1))
    asked = [("in_flow", first), ("absent", F.lit("no such text")), ("order", first, last), ("merge", first, last), ("split", first, last), ("role", first, F.lit("heading")), ("freeze", last)]
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.array(*args).alias("args")) for k, (kind, *args) in enumerate(asked)])
    rows = docs.select("doc_id", F.explode(each).alias("c")).select((F.col("doc_id") * 10 + F.col("c.k")).alias("check_id"), "doc_id", "c.kind", "c.args")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line")).where(F.trim("line") != "")
    return checks.results(rows, lines.withColumn("leaf", F.when(F.col("ord") == 0, "heading").otherwise("paragraph")), "doc_id", "ord", "line", "leaf")


# --- sequence and layout

@query(f"""WITH {LEAVES}, f AS (SELECT *, CASE WHEN coalesce(regexp_matches(line, '^[a-z]'), false) AND lag(line) OVER w IS NOT NULL THEN 0 ELSE 1 END AS fresh FROM leaves WINDOW w AS (PARTITION BY doc_id ORDER BY ord)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM f)
SELECT doc_id, min(ord) AS ord, count(*) AS n, length(string_agg(line, ' ' ORDER BY ord)) AS n_chars FROM g GROUP BY doc_id, part""")
def joined_paragraphs(spark, sf_dir):
    before = F.lag("line").over(windows.Window.partitionBy("doc_id").orderBy("ord"))
    lines = leaves(spark, sf_dir).select("doc_id", "ord", "line").withColumn("before", before)
    return sequence.joined(lines, "doc_id", "ord", "line", F.col("before").isNotNull() & F.col("line").rlike("^[a-z]")).select("doc_id", "ord", "n", F.length("text").alias("n_chars"))


BOX_SQL = "boxes AS (SELECT l_orderkey AS page, l_partkey * 10 + l_linenumber AS block, l_quantity AS l, l_partkey % 97 AS b, l_quantity + 5 + l_suppkey % 20 AS r, l_partkey % 97 + 12 AS t FROM lineitem), regions AS (SELECT l_orderkey AS page, l_returnflag AS role, l_quantity - 5 AS r_l, l_partkey % 89 AS r_b, l_quantity + 25 AS r_r, l_partkey % 89 + 40 AS r_t FROM lineitem)"


def boxes(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_returnflag")
    x, y = F.col("l_quantity"), F.col("l_partkey") % 97
    held = d.select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("block"), x.alias("l"), y.cast("double").alias("b"), (x + 5 + F.col("l_suppkey") % 20).alias("r"), (y + 12).cast("double").alias("t"))
    y = F.col("l_partkey") % 89
    over = d.select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("role"), (x - 5).alias("r_l"), y.cast("double").alias("r_b"), (x + 25).alias("r_r"), (y + 40).cast("double").alias("r_t"))
    return held, over


@query(f"""WITH {BOX_SQL}, v AS (SELECT page, block, role, sum(greatest(0, least(r, r_r) - greatest(l, r_l)) * greatest(0, least(t, r_t) - greatest(b, r_b))) AS a, min((r - l) * (t - b)) AS own FROM (SELECT DISTINCT * FROM boxes) JOIN regions USING (page) WHERE greatest(0, least(r, r_r) - greatest(l, r_l)) * greatest(0, least(t, r_t) - greatest(b, r_b)) > 0 GROUP BY page, block, role)
SELECT page, block, arg_max(role, (a, -ascii(role))) AS role, round(least(1.0, sum(a) / min(own)), 6) AS coverage FROM v GROUP BY page, block""")
def block_roles(spark, sf_dir):
    held, over = boxes(spark, sf_dir)
    unique = held.distinct()
    return geometry.region_votes(unique, over, "page", "block", "role").withColumn("coverage", F.round("coverage", 6))


@query()
def reading_order(spark, sf_dir):
    held, _ = boxes(spark, sf_dir)
    return geometry.reading_order(held, ["page"], "block")


@query()
def note_numbers(spark, sf_dir):
    notes = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").withColumn("marker", F.when(F.col("l_partkey") % 11 == 0, F.lit(None).cast("int")).when(F.col("l_partkey") % 13 == 0, 97).otherwise(F.col("l_linenumber")))
    return sequence.note_numbers(notes, "l_orderkey", "l_linenumber", "marker")


@query()
def cover_selection(spark, sf_dir):
    pages = read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars").withColumns({"signature": F.concat_ws("-", "lang", F.least(F.lit(3), F.floor(F.log10(F.col("n_chars") + 1))).cast("string")), "features": F.array("lang")})
    return sequence.covering_pages(pages, "source", "doc_id", "n_chars", "signature", "features")


# --- HTML

@query()
def html_blocks(spark, sf_dir):
    found = read(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.explode(functions.html_blocks("html")).alias("x"))
    return found.groupBy(F.col("x.tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("n_pages"))


@query()
def find_spans(spark, sf_dir):
    functions.register(spark)
    read(spark, sf_dir, "documents", "doc_id", "text").createOrReplaceTempView("leafloom_documents")
    return spark.sql("SELECT doc_id, n, start, end, value FROM leafloom_documents, LATERAL find_spans(text, '[0-9]+(?:[.,][0-9]+)*')")


# --- live logs

@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(spark, sf_dir):
    live = streaming.event_stream(spark, f"{sf_dir}/event[s].parquet")
    return streaming.drained(streaming.windowed_counts(live, "event_type")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def stream_latest(spark, sf_dir):
    live = streaming.event_stream(spark, f"{sf_dir}/event[s].parquet")
    return streaming.drained(streaming.latest(live, ["user_id"], "event_id", ["event_type", "event_id"]))


@query("SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def stream_dedupe(spark, sf_dir):
    live = streaming.event_stream(spark, f"{sf_dir}/event[s].parquet").select("user_id", "event_type", "ts")
    found = streaming.drained(streaming.deduplicated(live, ["user_id", "event_type"]), "append")
    return found.agg(F.count(F.lit(1)).alias("n"))


# --- tables

@query("SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_type ORDER BY regexp_extract(p_brand, '^([^0-9]*)', 1), CAST(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS BIGINT), p_partkey) AS place FROM part")
def natural_sort(spark, sf_dir):
    parts = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return windows.placed_within(parts, ["p_type"], text.natural_key(F.col("p_brand")), F.col("p_partkey")).drop("p_brand", "p_type")


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY regexp_extract(p_brand, '^([^0-9]*)', 1), CAST(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS BIGINT), p_partkey) AS place FROM part")
def natural_order(spark, sf_dir):
    parts = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    return windows.placed(parts, text.natural_key(F.col("p_brand")), F.col("p_partkey")).drop("p_brand")


@query("SELECT l_suppkey, sum(l_quantity) AS quantity FROM lineitem WHERE l_quantity > 20 GROUP BY l_suppkey HAVING count(*) > 5 EXCEPT SELECT s_suppkey, 0 FROM supplier WHERE s_acctbal < 0")
def set_difference(spark, sf_dir):
    big = read(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity").where("l_quantity > 20").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n")).where("n > 5").drop("n")
    return big.subtract(read(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").where("s_acctbal < 0").select("s_suppkey", F.lit(0.0)))


# --- more on leaves, graphs, lists and validity

@query(f"WITH {FUNDING_SQL}, e AS (SELECT id, list_sort(list_distinct(regexp_extract_all(s, '{text.CAPITALISED}', 1)[1:6])) AS x FROM sentences), i AS (SELECT id, x, unnest(generate_series(1, len(x))) AS a FROM e), p AS (SELECT id, x[a] AS source, x[b] AS target FROM (SELECT *, unnest(generate_series(a + 1, len(x))) AS b FROM i)) SELECT source, target, count(*) AS n, count(DISTINCT id) AS n_documents FROM p GROUP BY 1, 2")
def graph_comentions(spark, sf_dir):
    return graph.comentions(funding_sentences(spark, sf_dir), text.entities(F.col("s")), "id")


@query(f"WITH {LEAVES}, p AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS p, regexp_matches(line, '^[A-Z][a-z]*[ ,]') AS m FROM leaves), g AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM p WHERE m) SELECT doc_id, min(ord) AS first, count(*) AS n FROM g GROUP BY doc_id, g HAVING count(*) >= 3")
def marked_lists(spark, sf_dir):
    return sequence.marked_lists(leaves(spark, sf_dir).select("doc_id", "ord", "line"), "doc_id", "ord", F.col("line").rlike("^[A-Z][a-z]*[ ,]"))


@query("WITH p AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS p, CASE WHEN l_partkey % 5 < 4 THEN l_linenumber END AS n FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2)), d AS (SELECT *, n - p AS d FROM p WHERE n IS NOT NULL), g AS (SELECT *, p - row_number() OVER (PARTITION BY l_orderkey, d ORDER BY p) AS g FROM d) SELECT l_orderkey, min(l_partkey) AS first, min(n) AS start, count(*) AS n FROM g GROUP BY l_orderkey, d, g HAVING count(*) >= 2")
def ordinal_lists(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    return sequence.ordinal_lists(rows, "l_orderkey", "l_partkey", F.when(F.col("l_partkey") % 5 < 4, F.col("l_linenumber")))


@query(f"WITH RECURSIVE {GEO_SQL}, t AS (SELECT nid, label, [nid] AS path FROM geo WHERE parent IS NULL UNION ALL SELECT g.nid, g.label, list_append(t.path, g.nid) FROM geo g JOIN t ON g.parent = t.nid) SELECT nid FROM t WHERE NOT list_has_any(path, (SELECT list(nid) FROM geo WHERE label LIKE 'A%'))")
def tree_walk(spark, sf_dir):
    marked = geography(spark, sf_dir).withColumn("kind", F.when(F.col("label").startswith("A"), "skipped").otherwise("kept"))
    return tree.walked(tree.with_paths(marked), "kind", skip=("skipped",)).select("nid")


@query(f"WITH RECURSIVE {GEO_SQL}, t AS (SELECT nid, label, [nid] AS path FROM geo WHERE parent IS NULL UNION ALL SELECT g.nid, g.label, list_append(t.path, g.nid) FROM geo g JOIN t ON g.parent = t.nid), u AS (SELECT unnest(path) AS a, path, label FROM t WHERE label LIKE '%1%') SELECT a AS nid, arg_min(label, path) AS text FROM u GROUP BY a")
def tree_first_text(spark, sf_dir):
    marked = tree.with_paths(geography(spark, sf_dir)).withColumn("t", F.when(F.col("label").contains("1"), F.col("label")))
    return tree.first_text(marked, "t")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS subject, 'unknown kind' AS error FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'confidence outside 0 to 1' FROM orders WHERE o_totalprice / 300000 > 1")
def validate_report(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_totalprice").withColumn("confidence", F.col("o_totalprice") / 300000)
    registry = orders.select(F.col("o_orderpriority").alias("id")).distinct().where(~F.col("id").startswith("1"))
    return validate.report_errors(orders, registry, "o_orderkey", "o_orderpriority", "confidence")


@query(f"WITH {GEO_SQL} SELECT nid AS subject, 'parent not there' AS error FROM geo WHERE parent IN (SELECT nid FROM geo WHERE label LIKE 'A%')")
def validate_tree(spark, sf_dir):
    return validate.tree_errors(geography(spark, sf_dir).where(~F.col("label").startswith("A")))


@query("SELECT state, next, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'running' ELSE 'queued' END AS state, CASE WHEN o_orderstatus <> 'O' THEN 'queued' WHEN NOT o_totalprice > 200000 THEN 'succeeded' WHEN o_orderkey % 4 < 3 THEN 'queued' ELSE 'failed' END AS next FROM orders) GROUP BY 1, 2")
def job_states(spark, sf_dir):
    jobs = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").withColumn("state", F.when(F.col("o_orderstatus") == "O", "running").otherwise("queued"))
    following = platform.finished(F.col("state"), F.col("o_totalprice") > 200000, F.col("o_orderkey") % 4, F.lit(3))
    return jobs.groupBy("state", following.alias("next")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, arg_min(event_id, event_id) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-15') GROUP BY 1, 2")
def idempotent_append(spark, sf_dir):
    events = read(spark, sf_dir, "events", "user_id", "event_type", "event_id", "ts")
    edge = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return platform.fresh_only(events.where(F.col("ts") >= edge).drop("ts"), events.where(F.col("ts") < edge), ["user_id", "event_type"], "event_id")


@query(f"WITH {FUNDING_SQL} SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(s, '{text.PROPER_NAME}', 1)) AS name FROM sentences) GROUP BY name")
def proper_names(spark, sf_dir):
    return funding_sentences(spark, sf_dir).select(F.explode(text.extract_all(F.col("s"), text.PROPER_NAME)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, list_transform([least(greatest(p_size, 5), 30) - 5, least(p_size + 10, 30) - 5], lambda x: CAST(x AS INTEGER))[1] AS s, least(p_size + 10, 30) - 5 AS e FROM part WHERE greatest(p_size, 5) < least(p_size + 10, 30)")
def run_slices(spark, sf_dir):
    held = F.array(runs.run(F.col("p_size"), F.col("p_size") + 10, F.col("p_brand")))
    cut = read(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand").select("p_partkey", F.explode(runs.sliced(held, F.lit(5), F.lit(30))).alias("r"))
    return cut.select("p_partkey", "r.s", "r.e")


@query()
def box_clusters(spark, sf_dir):
    held, _ = boxes(spark, sf_dir)
    return geometry.clusters(held, ["page"], "block")


@query()
def toc_reconcile(spark, sf_dir):
    docs = leaves(spark, sf_dir)
    headings = docs.select("doc_id", "ord", F.col("line").alias("title"), (F.col("ord") + 3).alias("page"), F.lit(1).alias("level"))
    entries = docs.where("ord % 3 <> 1").select("doc_id", "ord", F.concat_ws(" ", (F.col("ord") + 1).cast("string"), "line", F.col("ord").cast("string")).alias("title"), F.col("ord").alias("page"), F.lit(1).alias("level"))
    return toc.reconcile(entries, headings, "doc_id")


from . import catalogue_layout, catalogue_nodes  # noqa: E402, F401  register their queries here
