"""Typed candidates of all families from leaves, headings, containers and notes: one scan, first find wins.

A candidate: document_id, nid, page, pattern_type, layer, confidence, reason-free
fields (map of strings; lists as JSON), quote, value (its main field), pattern_id.
The rules are those of `evidence` and `patterns`. Equal fields of one node and type
are one candidate, the first by pass, family and place. Leaves that cite, or are
about charts or methods, have none.

Nulls: rows without document or node are left out, null text is empty, a null page
or level is unknown. Rows that repeat are one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored
from . import evidence as e
from . import patterns as p
from .text import clean_quote, collapsed

# The layer of every type.
LAYERS = {
    "statistic": 0, "report_metadata": 0, "legal_reference": 0, "quotation": 0, "named_entity": 0, "source_note_reference": 0, "date_time_period": 0, "geography_place": 0,
    "funding_event": 1, "impact_statement": 1, "purpose_statement": 1, "resource": 1, "key_finding": 1, "question": 1, "definition": 1, "callout": 1, "callout_label": 1,
    "recommendation": 2, "entity_relationship": 2, "metric_cluster": 2, "question_list": 2, "comparison_table": 2, "process_step_list": 2,
}
QUESTION = r"(?:^|[.!?]\s+)([^.!?]{8,220}\?)"
FINDING_HEADINGS = ["stories of impact", "impact", "highlights", "key findings"]
#: Entries of a cluster or list that a candidate names, and texts that its quote holds.
MOST_METRICS, MOST_QUOTES, MOST_ITEMS = 12, 8, 20

SPANS = "array<struct<start:int,end:int,v:string>>"
FIELDS = "map<string,string>"
FOUND = f"struct<type:string,confidence:double,fields:{FIELDS},value:string,quote:string>"
COLUMNS = ["document_id", "nid", "page", "pattern_type", "layer", "confidence", "fields", "value", "quote", "pattern_id"]


def spans(text: Column, pattern: str) -> Column:
    """Every match's half-open place and text. A text is what lies between its matches and the matches, so their lengths add up to the places."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def add(held: Column, x: Column) -> Column:
        start = held["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(held["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("v")))).alias("out"))

    pairs = F.filter(F.arrays_zip(between.alias("b"), found.alias("m")), lambda x: x["m"].isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(pairs, empty, add, lambda held: held["out"])).otherwise(F.array().cast(SPANS))


def _fields(**of: Column) -> Column:
    return F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v.cast("string"))])


def _found(kind: str, confidence: Column | float, value: Column, quote: Column, /, **of: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"), _fields(**of).alias("fields"), value.cast("string").alias("value"), clean_quote(quote).alias("quote")).cast(FOUND)


def _json(c: Column) -> Column:
    return F.to_json(c)


def _tagged(family: str, order: int, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(family).alias("family"), F.lit(order).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), m["v"].alias("v")))


def _once(family: str, order: int, when: Column) -> Column:
    none = F.array().cast("array<struct<family:string,rank:int,start:int,end:int,v:string>>")
    one = F.array(F.struct(F.lit(family).alias("family"), F.lit(order).alias("rank"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(None).cast("string").alias("v")))
    return F.when(F.coalesce(when, F.lit(False)), one).otherwise(none)


def _dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly: a file of few bytes, which one task reads, may hold texts that are dear to work out."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def looked(leaves: DataFrame) -> DataFrame:
    """Leaves that may have a candidate, dealt out evenly: headings, those that open a quote or hold references, and texts that have what every match must have."""

    look = p.LOOK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = pc.or_(pc.fill_null(pc.match_substring_regex(b.column("text"), look), False), pc.or_(pc.fill_null(b.column("quote_open"), False), pc.is_valid(b.column("refs"))))
            yield b.filter(pc.or_(some, pc.fill_null(pc.equal(b.column("kind"), "heading"), False)))

    rows = leaves.where(F.col("document_id").isNotNull() & F.col("nid").isNotNull()).withColumns({"text": F.col("text").cast("string"), "kind": F.col("kind").cast("string"), "quote_open": F.col("quote_open").cast("boolean")})
    return _dealt(rows.mapInArrow(run, rows.schema))


def leaf_finds(leaves: DataFrame) -> DataFrame:
    """document_id, nid, page, seq, f (what was found) of leaves: document_id, nid, page, kind, text, lead, quote_open, refs (array of s, e, v).

    Matches of all families are gathered in one array, exploded once, and each row's
    fields are worked out for its family alone. Numbers inside legal references,
    money and dates are theirs.
    """
    text = F.col("text")
    heading = F.col("kind") == "heading"
    rows = leaves.where(F.col("document_id").isNotNull() & F.col("nid").isNotNull()).select("document_id", "nid", "page", "kind", F.coalesce("text", F.lit("")).alias("text"), "lead", F.coalesce("quote_open", F.lit(False)).alias("quote_open"), "refs")
    rows = rows.where((text != "") & ~e.is_citation_like(text) & ~e.is_chart_or_methodology(text)).withColumn("ev", e.is_evidence(text, heading))
    # a cheap look at what every match must have comes first
    none = F.array().cast(SPANS)
    where = lambda has, pattern: F.when(has, spans(text, pattern)).otherwise(none)
    digits = text.rlike("[0-9]")
    rows = rows.withColumn("digits", digits)
    rows = rows.withColumns({"legal": where(F.col("digits") | text.contains("§"), p.LEGAL), "money": where(F.col("digits") & F.col("ev") & text.rlike(p.FUNDING_CONTEXT), p.MONEY), "dates": where(F.col("digits"), p.DATE)})
    legal = F.filter("legal", lambda m: (e.clean_legal(m["v"]) != "") & ~e.skips_legal(e.clean_legal(m["v"]), text))

    def funded(m: Column) -> Column:
        quote = e.sentence_around(text, m["start"], m["end"])
        return e.is_evidence(quote, heading) & e.is_funding_context(quote)

    rows = rows.withColumns({"legal": legal, "money": F.filter("money", funded)})
    taken = F.concat("legal", "money", "dates")
    rows = rows.withColumn("numbers", F.when(F.col("ev") & F.col("digits"), F.filter(spans(text, p.NUMBER), lambda m: ~e.overlaps(m["start"], m["end"], taken))).otherwise(F.array().cast(SPANS)))
    rows = rows.withColumns({"worded": where(F.col("ev") & text.rlike("(?i)third|quarter|fourth|half"), p.WORD_STAT), "purpose": F.when(F.col("ev") & text.rlike(p.PURPOSE), e.purpose_statement(text))})
    quoted = F.col("quote_open") | text.contains("“") | text.contains('"')
    quotes = F.when(quoted, spans(text, p.QUOTE)).otherwise(F.array().cast(SPANS))
    questions = F.when(text.contains("?"), F.filter(spans(text, QUESTION), lambda m: ~e.skips_question(F.trim(F.regexp_extract(m["v"], QUESTION, 1)), text))).otherwise(F.array().cast(SPANS))
    rows = rows.withColumns({"quotes": quotes, "questions": questions})
    cited = F.transform(F.filter(F.coalesce("refs", F.array().cast("array<struct<s:int,e:int,v:string>>")), lambda r: r["s"].isNotNull() & r["e"].isNotNull()), lambda r: F.struct(r["s"].alias("start"), r["e"].alias("end"), r["v"].alias("v")))
    worth = ~(F.size("money") > 0) | ~e.is_funding_context(text)
    every = F.concat(
        _tagged("legal", 0, F.col("legal")),
        _once("report", 1, F.col("ev") & text.rlike(p.REPORT_METADATA)),
        _tagged("money", 2, F.col("money")),
        _once("purpose", 3, F.col("purpose").isNotNull()),
        _once("impact", 4, F.col("ev") & F.col("purpose").isNull() & worth & text.rlike(p.IMPACT)),
        _once("resource", 5, text.rlike(p.RESOURCE_HINT)),
        _tagged("number", 6, F.col("numbers")),
        _tagged("worded", 7, F.col("worded")),
        _tagged("date", 8, F.col("dates")),
        _tagged("place", 9, spans(text, e.PLACES)),
        _tagged("ref", 10, cited),
        _tagged("quote", 11, F.col("quotes")),
        _once("open", 12, F.col("quote_open") & (F.size("quotes") == 0)),
        _tagged("question", 13, F.col("questions")),
        _once("prompt", 14, (F.size("questions") == 0) & text.rlike(r"(?i)^[\s:]*(what|who|when|where|why|how|which)\b")),
        _once("definition", 15, text.rlike(p.DEFINITION) | text.rlike(p.WHICH_MEANS)),
        _once("finding", 16, e.is_key_finding(text)),
    )
    each = rows.select("document_id", "nid", "page", "kind", "text", "lead", "ev", "purpose", F.explode(every).alias("m")).select("*", "m.*").drop("m")
    around = e.sentence_around(text, F.col("start"), F.col("end"))
    each = each.withColumn("quote", F.when(F.col("family").isin("legal", "money", "number", "worded", "date", "place"), around))
    quote, v, family = F.col("quote"), F.col("v"), F.col("family")
    said = F.col("said")
    amount, stat = collapsed(v), F.trim(v)
    parties = e.funding_parties(quote, amount)
    each = each.withColumns({"amount": F.when(family == "money", amount), "event": (family == "money") & e.is_funding_event(quote), "parties": F.when((family == "money") & e.is_funding_event(quote), parties)})
    funder = F.coalesce("parties.funder", F.when(F.col("parties.program").isNull(), e.funder(text, F.col("start"))))
    recipient = F.coalesce("parties.recipient", e.recipient(text, F.col("end")))
    each = each.withColumns({"funder": F.when(F.col("event"), funder), "recipient": F.when(F.col("event"), recipient)})
    date = F.regexp_extract(quote, p.DATE, 1)
    when = F.when(date != "", date)
    aggregate_actor = F.try_element_at(e.entities(F.substring(text, F.greatest(F.lit(1), F.col("start") - 159), F.least(F.lit(320), F.col("start") + 160))), F.lit(1))
    # what several fields are taken from is a column of its own, worked out once and for its family alone
    of = lambda name, c: F.when(family == name, c)
    each = each.withColumns(
        {
            "reference": of("legal", e.clean_legal(v)), "report": of("report", e.report_metadata(text)), "impact": of("impact", e.impact_statement(text)), "resource": of("resource", e.resource(text)), "definition": of("definition", e.definition(text)), "worded": of("worded", F.lower(collapsed(v))),
            "first": of("finding", e.first_sentence(text)), "inner": of("quote", F.trim(F.regexp_extract(v, p.QUOTE, 1))), "asked": F.when(family == "question", F.trim(F.regexp_extract(v, QUESTION, 1))).when(family == "prompt", e.prompt(text, F.col("lead"))), "near": of("ref", e.reference_context(text, F.col("start"), F.col("end"), v)), "label": F.when(family.isin("number", "worded"), e.label_before(text, F.col("start"))), "time": F.when(family == "money", when), "said": F.when(family.isin("number", "worded"), e.is_evidence(quote, heading)),
        }
    )
    ref, report, impact, resource, definition, worded, first, inner, question, prompt = (F.col(c) for c in ("reference", "report", "impact", "resource", "definition", "worded", "first", "inner", "asked", "asked"))
    when, label, near = F.col("time"), F.col("label"), F.col("near")
    means = F.instr(text, definition["definition"])
    found = (
        F.when(family == "legal", _found("legal_reference", 0.82, ref, quote, reference_text=ref, reference_type=e.legal_kind(ref), context=quote))
        .when((family == "report") & report.isNotNull(), _found("report_metadata", 0.76, report["value"], report["value"], metadata_type=report["metadata_type"], value=report["value"], entities=_json(report["entities"]), role=report["role"], applies_to=report["applies_to"]))
        .when((family == "money") & F.col("event"), _found("funding_event", 0.76, F.col("amount"), quote, amount=F.col("amount"), funder=F.col("funder"), recipient=F.col("recipient"), program=F.col("parties.program"), purpose=e.funding_purpose(quote), time_period=when))
        .when(family == "money", _found("impact_statement", 0.68, F.col("amount"), quote, statement_text=quote, impact_type=e.impact_kind(quote), actor=aggregate_actor, value=F.col("amount"), time_period=when, beneficiaries=e.beneficiaries(quote)))
        .when(family == "purpose", _found("purpose_statement", 0.66, F.col("purpose.statement_text"), F.col("purpose.statement_text"), **{c: F.col(f"purpose.{c}") for c in ("statement_text", "problem", "audience", "stakes")}))
        .when((family == "impact") & impact.isNotNull(), _found("impact_statement", 0.64, impact["statement_text"], impact["statement_text"], **{c: impact[c] for c in ("statement_text", "impact_type", "actor", "value", "time_period", "beneficiaries")}))
        .when((family == "resource") & resource.isNotNull(), _found("resource", 0.68, resource["resource_name"], F.coalesce(F.nullif(resource["description"], F.lit("")), resource["resource_name"]), **{c: resource[c] for c in ("resource_name", "resource_type", "description")}))
        .when((family == "number") & said & ~e.skips_number(stat, text, F.col("start")), _found("statistic", 0.72, stat, quote, value=stat, unit=e.unit_behind(text, F.col("end")), label=label, surrounding_claim=quote))
        .when((family == "worded") & said & (F.size(e.word_stats(quote)) > 0), _found("statistic", 0.68, worded, quote, value=worded, unit=F.lit("proportion"), label=label, surrounding_claim=quote))
        .when(family == "date", _found("date_time_period", 0.78, v, quote, value=v, context=quote))
        .when(family == "place", _found("geography_place", 0.74, v, quote, place=v, context=quote))
        .when(family == "ref", _found("source_note_reference", 0.92, v, near, marker=v, context=near))
        .when((family == "quote") & ~e.skips_quote(inner, text), _found("quotation", 0.7, inner, v, quote_text=inner, speaker_name=F.lit(None)))
        .when(family == "open", _found("quotation", 0.68, F.trim(text), text, quote_text=F.trim(text), speaker_name=F.lit(None)))
        .when(family == "question", _found("question", 0.82, question, question, question_text=question, answer_context=e.answer_behind(text, question)))
        .when((family == "prompt") & prompt.isNotNull(), _found("question", 0.66, prompt, prompt, question_text=prompt, answer_context=e.answer_behind(text, prompt)))
        .when((family == "definition") & definition.isNotNull(), _found("definition", 0.62, definition["term"], F.when(means > 0, e.sentence_around(text, means - 1, means - 1 + F.length(definition["definition"]))).otherwise(text), term=definition["term"], definition=definition["definition"]))
        .when(family == "finding", _found("key_finding", 0.58, first, first, finding_text=first))
    )
    link = F.when(F.col("event") & F.col("funder").isNotNull() & F.col("recipient").isNotNull(), _found("entity_relationship", 0.62, F.concat_ws(" -> ", "funder", "recipient"), quote, subject=F.col("funder"), predicate=F.lit("funds"), object=F.col("recipient"), subject_type=e.entity_kind(F.col("funder")), object_type=e.entity_kind(F.col("recipient"))))
    seq = F.struct(F.lit(0).alias("pass"), F.col("rank").cast("long").alias("rank"), F.col("start").cast("long").alias("start"))
    return each.select("document_id", "nid", "page", seq.alias("seq"), F.explode(F.array_compact(F.array(found, link))).alias("f"))


def heading_finds(nodes: DataFrame) -> DataFrame:
    """What headings name: labels of modules, resources, organisations, findings."""
    one = F.col("one")
    rows = nodes.where((F.col("kind") == "heading") & F.col("document_id").isNotNull() & F.col("nid").isNotNull()).withColumn("one", e.clean_entity(F.col("text"))).withColumn("resource", e.resource(one))
    resource = F.col("resource")
    parts = [
        F.when(e.is_callout_label(one) & (one != ""), _found("callout_label", 0.72, one, one, label_text=one, module_type=e.callout_kind(one), sample_content=F.lit(None))),
        F.when(resource.isNotNull(), _found("resource", 0.7, resource["resource_name"], one, **{c: resource[c] for c in ("resource_name", "resource_type", "description")})),
        F.when(e.is_entity(one) & ~e.is_resource_only_name(one), _found("named_entity", F.when(F.coalesce("level", F.lit(9)) <= 2, 0.82).otherwise(0.7), one, one, entity_text=one, entity_type=e.entity_kind(one), source=F.lit("heading"))),
        F.when(F.lower(one).isin(FINDING_HEADINGS), _found("key_finding", 0.62, one, one, finding_text=one)),
    ]
    tagged = F.array(*[F.struct(F.lit(k).cast("long").alias("rank"), f.alias("f")) for k, f in enumerate(parts)])
    each = rows.select("document_id", "nid", "page", F.explode(tagged).alias("x")).where("x.f IS NOT NULL")
    return each.select("document_id", "nid", "page", F.struct(F.lit(1).alias("pass"), F.col("x.rank").alias("rank"), F.lit(0).cast("long").alias("start")).alias("seq"), F.col("x.f").alias("f"))


def entity_finds(leaves: DataFrame) -> DataFrame:
    """Organisations and programmes that leaves name, six a leaf at most."""
    text = F.coalesce("text", F.lit(""))
    rows = leaves.where(F.col("document_id").isNotNull() & F.col("nid").isNotNull() & ~e.is_citation_like(text) & ~e.is_chart_or_methodology(text))
    each = rows.select("document_id", "nid", "page", text.alias("text"), F.posexplode(e.entities(text)).alias("k", "v")).where(~e.is_resource_only_name(F.col("v")))
    v = F.col("v")
    return each.select("document_id", "nid", "page", F.struct(F.lit(2).alias("pass"), F.col("k").cast("long").alias("rank"), F.lit(0).cast("long").alias("start")).alias("seq"), _found("named_entity", 0.66, v, e.sentence_containing(F.col("text"), v), entity_text=v, entity_type=e.entity_kind(v), source=F.lit("text")).alias("f"))


def cluster_finds(statistics: DataFrame) -> DataFrame:
    """A cluster for each page with two different statistics or more; of strong ones (money, shares, magnitudes) alone where there are two. statistics: those of leaf_finds with `ord`, the leaf's place."""
    value, quote = F.col("f.value"), F.col("f.quote")
    key = F.substring(F.regexp_replace(F.lower(quote), r"[^\p{L}\p{N}_]+", ""), 1, 120)
    rows = statistics.where("f.type = 'statistic' AND page IS NOT NULL").select("document_id", "page", value.alias("v"), key.alias("_k"), F.struct("ord", "seq").alias("at"), F.struct("nid", *[F.try_element_at("f.fields", F.lit(c)).alias(c) for c in ("label", "value", "unit")], quote.alias("quote")).alias("s"))
    distinct = rows.groupBy("document_id", "page", "v", "_k").agg(F.min("at").alias("at"), F.min_by("s", "at").alias("s")).withColumn("strong", e.is_strong_metric(F.col("v")))
    page = Window.partitionBy("document_id", "page")
    counted = distinct.withColumns({"_n": F.count(F.lit(1)).over(page), "_s": F.sum(F.col("strong").cast("int")).over(page)}).where("_n >= 2 AND (_s < 2 OR strong)")
    ranked = counted.withColumn("_r", F.row_number().over(page.orderBy("at", "v", "_k"))).where(F.col("_r") <= MOST_METRICS)
    listed = F.array_sort(F.collect_list(F.struct("_r", "s", "_k")))
    pages = ranked.groupBy("document_id", "page").agg(listed.alias("l"))
    first = F.filter(F.slice("l", 1, MOST_QUOTES), lambda x: x["_k"] != "")
    # quotes of one key count once
    texts = F.transform(F.filter(first, lambda x: ~F.exists(first, lambda y: (y["_k"] == x["_k"]) & (y["_r"] < x["_r"]))), lambda x: x["s"]["quote"])
    metrics = F.transform("l", lambda x: F.struct(x["s"]["label"].alias("label"), x["s"]["value"].alias("value"), x["s"]["unit"].alias("unit")))
    where = F.concat(F.lit("page "), F.col("page").cast("string"))
    found = _found("metric_cluster", 0.68, F.array_join(F.transform("l", lambda x: x["s"]["value"]), ", "), F.array_join(texts, " "), metrics=_json(metrics), shared_context=where)
    return pages.select("document_id", F.get("l", F.lit(0))["s"]["nid"].alias("nid"), "page", F.struct(F.lit(3).alias("pass"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("start")).alias("seq"), found.alias("f"))


def container_finds(containers: DataFrame) -> DataFrame:
    """What asides, tables and lists are: document_id, nid, page, kind, quote, header, ordered, texts (of its leaves or items, in order), open (place of the leaf that opens a quote).

    Asides are callouts; those that quote also give the quotation, who said it and for whom. Tables are comparisons; lists of questions, of steps and of labelled numbers are told apart.
    """
    rows = containers.where(F.col("document_id").isNotNull() & F.col("nid").isNotNull()).withColumn("t", F.filter(F.transform(F.coalesce("texts", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit(""))), lambda x: x != ""))
    quoting = F.coalesce("quote", F.lit(False)) & (F.col("kind") == "aside")
    at = F.coalesce(F.col("open"), F.lit(0))
    lines = F.transform(F.slice("t", at + 2, F.greatest(F.lit(0), F.size("t") - at - 1)), lambda x: clean_quote(x, 180))
    rows = rows.withColumns({"all": F.array_join("t", " "), "said": F.when(quoting, clean_quote(F.coalesce(F.get("t", at), F.lit("")))), "lines": F.when(quoting, lines)})

    def first(held: Column, wanted) -> Column:
        """The first line that is wanted, before any that begins a new quote."""
        stop = F.array_position(F.transform(held, e.starts_new_quote), True)
        found = F.array_position(F.transform(held, wanted), True)
        return F.when((found > 0) & ((stop == 0) | (found < stop)), found)

    speaker = first(F.col("lines"), lambda x: e.is_speaker_line(x))
    rows = rows.withColumn("_k", speaker.cast("int")).withColumn("speaker", F.get("lines", F.col("_k") - 1))
    behind = F.slice("lines", F.col("_k") + 1, F.greatest(F.lit(0), F.size("lines") - F.col("_k")))
    rows = rows.withColumn("behind", F.when(F.col("speaker").isNotNull() & e.role_may_follow(F.col("speaker")), behind))
    rows = rows.withColumn("role", F.get("behind", first(F.col("behind"), lambda x: e.is_role_line(x)).cast("int") - 1))
    who = e.attribution(F.col("speaker"), F.col("role"))
    rows = rows.withColumns({"who": F.when(F.col("speaker").isNotNull(), who), "credit": F.concat_ws(" ", "speaker", "role")})
    name, company = F.col("who.speaker_name"), F.col("who.speaker_affiliation")
    named = name.isNotNull()
    source = F.coalesce(F.nullif(F.col("credit"), F.lit("")), F.col("all"))
    asked = F.filter("t", lambda x: x.contains("?") & ~e.skips_question(x, x))
    acts = F.size(F.filter("t", e.is_action_item))
    ordered = F.coalesce("ordered", F.lit(False))
    is_list = F.col("kind") == "list"
    questions = is_list & (F.size("t") >= 2) & (F.size(asked) >= F.greatest(F.lit(2), F.floor(F.size("t") / 2)))
    steps = is_list & ~questions & (F.size("t") >= 3) & (ordered | (acts >= 2))
    metrics = e.label_values(F.col("t"))
    lined = F.array_join("t", "\n")
    parts = [
        F.when((F.col("kind") == "aside") & (F.col("all") != ""), _found("callout", F.when(quoting, 0.82).otherwise(0.66), clean_quote(F.col("all")), F.col("all"), callout_text=clean_quote(F.col("all")), callout_type=F.when(quoting, "quote").otherwise("sidebar"))),
        F.when(quoting & (F.col("said") != ""), _found("quotation", F.when(named, 0.84).otherwise(0.76), F.col("said"), F.col("said"), quote_text=F.col("said"), speaker_name=name, speaker_title=F.col("who.speaker_title"), speaker_affiliation=company)),
        F.when(quoting & named, _found("named_entity", 0.82, name, source, entity_text=name, entity_type=F.lit("person"), source=F.lit("quote_attribution"))),
        F.when(quoting & company.isNotNull(), _found("named_entity", 0.78, company, source, entity_text=company, entity_type=e.entity_kind(company), source=F.lit("quote_attribution"))),
        F.when(quoting & named & company.isNotNull(), _found("entity_relationship", 0.78, F.concat_ws(" -> ", name, company), source, subject=name, predicate=F.lit("affiliated_with"), object=company, subject_type=F.lit("person"), object_type=e.entity_kind(company))),
        F.when((F.col("kind") == "table") & (F.col("all") != ""), _found("comparison_table", 0.86, clean_quote(F.col("all")), F.col("all"), table_text=clean_quote(F.col("all")), has_header=F.coalesce("header", F.lit(False)))),
        F.when(questions, _found("question_list", 0.84, F.get(asked, F.lit(0)), F.array_join(asked, "\n"), questions=_json(F.slice(asked, 1, MOST_ITEMS)))),
        F.when(steps, _found("process_step_list", 0.7, F.get("t", F.lit(0)), lined, steps=_json(F.slice("t", 1, MOST_ITEMS)), ordered=ordered)),
        F.when(F.col("kind").isin("table", "list") & (F.size(metrics) >= 2), _found("metric_cluster", F.when(is_list, 0.72).otherwise(0.76), F.array_join(F.transform(metrics, lambda m: m["value"]), ", "), F.when(is_list, lined).otherwise(F.col("all")), metrics=_json(F.slice(metrics, 1, MOST_METRICS)), shared_context=F.lit(None))),
    ]
    tagged = F.array(*[F.struct(F.lit(k).cast("long").alias("rank"), f.alias("f")) for k, f in enumerate(parts)])
    each = rows.select("document_id", "nid", "page", F.explode(tagged).alias("x")).where("x.f IS NOT NULL")
    return each.select("document_id", "nid", "page", F.struct(F.lit(4).alias("pass"), F.col("x.rank").alias("rank"), F.lit(0).cast("long").alias("start")).alias("seq"), F.col("x.f").alias("f"))


def note_finds(notes: DataFrame) -> DataFrame:
    """A source for every note with text: document_id, nid (of the notes), page, marker, text."""
    said = clean_quote(F.coalesce("text", F.lit("")))
    rows = notes.where(F.col("document_id").isNotNull() & F.col("nid").isNotNull() & (said != ""))
    mark = F.col("marker").cast("string")
    return rows.select("document_id", F.concat_ws(":", "nid", F.lit("note"), mark).alias("nid"), "page", F.struct(F.lit(5).alias("pass"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("start")).alias("seq"), _found("source_note_reference", 0.88, mark, said, marker=mark, context=said, note_text=said).alias("f"))


def first_finds(found: DataFrame) -> DataFrame:
    """One candidate for each document, node, type and fields: the first."""
    fields = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("f.fields"))))
    rows = found.where("f.quote <> ''").select("document_id", F.col("nid").cast("string").alias("nid"), "page", "seq", "f", fields.alias("_fields"))
    first = rows.groupBy("document_id", "nid", F.col("f.type").alias("pattern_type"), "_fields").agg(F.min_by(F.struct("page", "f"), F.struct("seq", F.col("f.confidence"), F.col("f.quote"))).alias("x"))
    layer = F.create_map(*[y for k, v in LAYERS.items() for y in (F.lit(k), F.lit(v))])[F.col("pattern_type")]
    digest = F.concat(F.lit("patt_"), F.substring(F.sha1(F.to_json(F.array(F.col("document_id").cast("string"), "pattern_type", "nid", "_fields"))), 1, 12))
    return first.select("document_id", "nid", "x.page", "pattern_type", layer.alias("layer"), "x.f.confidence", "x.f.fields", "x.f.value", "x.f.quote", digest.alias("pattern_id"))


def candidates(leaves: DataFrame, containers: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """All candidates of a corpus. leaves: document_id, nid, page, ord, kind, level, text, lead, quote_open, refs; containers and notes as their finds take them."""
    places = leaves.groupBy("document_id", "nid").agg(F.min("ord").alias("ord"))
    some = stored(looked(leaves), "looked")
    own = stored(leaf_finds(some), "leaf-finds")
    found = own.unionByName(heading_finds(some)).unionByName(entity_finds(some)).unionByName(cluster_finds(own.where("f.type = 'statistic'").join(places, ["document_id", "nid"])))
    if containers is not None:
        found = found.unionByName(container_finds(_dealt(containers)))
    if notes is not None:
        found = found.unionByName(note_finds(notes))
    return first_finds(stored(found, "finds"))
