"""Evidence rules: which leaf texts count as evidence of what, and what is read from them.

All rules are Column expressions over a leaf's text (null counts as empty), so a
scan of the leaves stays inside code generation, however many rules it asks.
Rules that find something return a struct, or null where they find nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as p
from .text import clean_quote, collapsed, first_of, let

ENDS = r"[.!?]"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _low(c: Column) -> Column:
    return F.lower(F.trim(_text(c)))


def _or_null(c: Column) -> Column:
    return let(c, lambda c: F.when(c != "", c))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """What the pattern's first match holds in the group, else null."""
    return let(text, lambda t: F.when(_text(t).rlike(pattern), F.regexp_extract(t, pattern, group)))


def _any(word_lists: list[str], text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in word_lists])


# --- sentences


def first_sentence(text: Column) -> Column:
    """Up to the first end of a sentence that white space or the end of the text follows, 220 characters at the most."""
    return let(collapsed(_text(text)), lambda one: clean_quote(F.when(one == "", "").otherwise(F.regexp_extract(one, rf"^(.+?(?:{ENDS}(?:\s|$)|$))", 1)), 220))


def _last_end(before: Column) -> Column:
    """The place behind the last end of a sentence, 0 where there is none."""
    return F.length(F.regexp_extract(before, rf"(?s)^(.*{ENDS})", 1))


def sentence_around(text: Column, start: Column, end: Column) -> Column:
    """The sentence that holds the span [start, end): from the end of the one before, to its own end or 120 characters on."""
    rest = F.regexp_extract(F.substring(text, end + 1, F.length(text)), rf"(?s)^(.*?{ENDS})", 1)
    right = let(rest, lambda rest: F.when(rest != "", end + F.length(rest)).otherwise(F.least(F.length(text), end + 120)))
    return let(_last_end(F.substring(text, F.lit(1), start)), lambda left: clean_quote(F.substring(text, left + 1, right - left), 240))


def sentence_containing(text: Column, needle: Column) -> Column:
    return let(F.instr(text, needle), lambda at: F.when(at == 0, clean_quote(text, 240)).otherwise(sentence_around(text, at - 1, at - 1 + F.length(needle))))


def sentence_before(text: Column, offset: Column) -> Column:
    """The last sentence that ends before the offset; null where nothing does."""

    def of(prefix: Column) -> Column:
        left = _last_end(F.substring(prefix, F.lit(1), F.greatest(F.lit(0), F.length(prefix) - 1)))
        return F.when(prefix != "", clean_quote(F.substring(prefix, left + 1, F.length(prefix)), 240))

    return let(F.rtrim(F.substring(text, F.lit(1), offset)), of)


def marker_context(text: Column) -> Column:
    return F.regexp_replace(_text(text), r"[^\p{L}\p{N}_]+", "")


def reference_context(text: Column, start: Column, end: Column, marker: Column) -> Column:
    """The sentence around a reference; where that is the marker alone, the one before it."""
    return let(sentence_around(text, start, end), lambda around: F.when(marker_context(around) == marker_context(marker), F.coalesce(sentence_before(text, start), around)).otherwise(around))


# --- gates


def is_url_like(text: Column) -> Column:
    return _text(text).rlike(p.URL_LIKE)


def is_question(text: Column) -> Column:
    return F.contains(_text(text), F.lit("?")) | let(_low(text), lambda low: low.rlike(p.QUESTION_LEADS) | low.rlike(p.QUESTION_PHRASES))


def is_example(text: Column) -> Column:
    return let(_low(text), lambda low: low.rlike(p.EXAMPLE_LEADS) | low.rlike(p.EXAMPLE_PHRASES))


def is_rule_or_threshold(text: Column) -> Column:
    return let(_low(text), lambda low: low.rlike(p.DEFINITIONAL) | low.rlike(p.THRESHOLDS))


def is_survey_admin(text: Column) -> Column:
    return let(_low(text), lambda low: low.rlike(p.SURVEY_SUBJECTS) | low.rlike(p.SURVEY_METHODS))


def is_title_case(text: Column) -> Column:
    """Every run of letters begins with a capital and goes on in small letters."""
    return text.rlike("[A-Z]") & ~text.rlike("(^|[^A-Za-z])[a-z]|[A-Za-z][A-Z]")


def clean_entity(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_text(text), r"\s+", " "), r"^[ ,;:.]+|[ ,;:.]+$", "")


def n_words(text: Column) -> Column:
    return let(collapsed(text), lambda one: F.when(one == "", 0).otherwise(F.size(F.split(one, " "))))


def is_publication_title(text: Column) -> Column:

    def of(one: Column) -> Column:
        named = let(F.lower(one), lambda low: low.rlike(p.PUBLICATIONS) & ~low.rlike(p.PUBLICATION_VERBS))
        titled = (n_words(one) <= 8) & is_title_case(one) & ~one.rlike(ENDS) & one.rlike(p.RESOURCE_HINT)
        return (one != "") & (F.length(one) <= 120) & (named | titled)

    return let(clean_entity(text), of)


def is_chart_or_methodology(text: Column) -> Column:
    return let(_low(text), lambda low: low.rlike(p.CHART_LEADS) | low.rlike(p.METHODOLOGY))


def is_definition_like_impact(text: Column) -> Column:
    return _text(text).rlike(p.DEFINITION_LIKE_IMPACT)


def is_citation_like(text: Column) -> Column:
    return _text(text).rlike(p.CITATION_VOLUME) | let(F.lower(_text(text)), lambda low: low.rlike(p.CITATION_WORDS) | (low.rlike(p.CITATION_PAGE) & F.contains(low, F.lit("/"))))


def is_evidence(text: Column, is_heading: Column | None = None) -> Column:
    """Neither a heading nor empty, cited, an address, about charts or method, asked, an example, a rule, or a title."""
    no = [is_citation_like, is_url_like, is_chart_or_methodology, is_survey_admin, is_question, is_example, is_rule_or_threshold, is_publication_title]
    heading = F.lit(False) if is_heading is None else F.coalesce(is_heading, F.lit(False))
    return ~heading & let(clean_quote(_text(text), 320), lambda one: (one != "") & ~reduce(lambda a, b: a | b, [f(one) for f in no]))


def is_recommendation(text: Column) -> Column:
    return let(first_sentence(text), lambda first: ~F.contains(first, F.lit("?")) & first.rlike(p.RECOMMENDATION))


def is_action_item(text: Column) -> Column:
    return _text(text).rlike(p.ACTION_START) | _text(text).rlike(p.RECOMMENDATION)


def is_key_finding(text: Column) -> Column:
    return _text(text).rlike(p.KEY_FINDING)


def is_callout_label(text: Column) -> Column:
    return let(F.lower(clean_entity(text)), lambda low: low.isin(p.CALLOUT_LABELS) | ((n_words(low) <= 5) & low.rlike(p.CALLOUT_CUES)))


def callout_kind(text: Column) -> Column:
    return first_of(F.lower(_text(text)), ("own words", "first_person_quote"), ("policy", "policy_example"), ("impact", "impact_story"), default="editorial_module")


# --- entities and places


def is_entity(text: Column) -> Column:
    """4 to 90 characters with a word that organisations' names end in; no stock phrase, no short one in capitals."""
    suffixes = F.array(*[F.lit(w) for w in p.ENTITY_SUFFIXES])

    def named(words: Column) -> Column:
        shouted = (F.upper(text) == text) & (F.size(words) <= 3)
        suffixed = F.exists(words, lambda w: F.array_contains(suffixes, F.regexp_replace(w, "^[.,]+|[.,]+$", "")))
        return ~shouted & F.when(F.size(words) == 1, F.array_contains(suffixes, words[0])).otherwise(suffixed)

    return F.length(text).between(4, 90) & ~text.isin(p.ENTITY_STOPS) & let(F.split(text, r"\s+"), named)


def entities(text: Column, most: int = 6) -> Column:
    """Distinct entity phrases in order, at most `most`."""
    found = F.transform(F.regexp_extract_all(_text(text), F.lit(p.ENTITY_PHRASE), 1), clean_entity)
    return F.slice(F.array_distinct(F.filter(found, is_entity)), 1, most)


def entity_kind(entity: Column) -> Column:
    return first_of(F.lower(entity), (p.ENTITY_ORGANIZATION, "organization"), (p.ENTITY_LAW, "law_or_policy"), (p.ENTITY_PROGRAM, "program_or_initiative"), default="entity")


#: Longest names first, so that West Virginia is not read as Virginia.
PLACES = r"\b(" + "|".join(sorted(p.STATES, key=len, reverse=True)) + r")\b"


def places(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(PLACES), 1)


# --- money, funding, law


def is_money(value: Column) -> Column:
    return F.regexp_replace(F.trim(_text(value)), p.MONEY, "") == ""


def is_funding_context(text: Column) -> Column:
    return _text(text).rlike(p.FUNDING_CONTEXT) & ~_text(text).rlike(p.FUNDING_NEGATIVE)


def report_metadata(text: Column) -> Column:
    """Who a report thanks: metadata_type, value, entities, role, applies_to."""

    def of(quote: Column, low: Column) -> Column:
        kind = first_of(low, (r"writer:|contributors include|graphics and layout by", "production_credit"), (r"data sharing|data collected by", "data_or_research_support"), (r"support|supported by|made possible by", "supporter"), default="report_context")
        role = first_of(
            low,
            ("pro bono support", "pro_bono_supporter"),
            ("data sharing|data collected by", "data_provider"),
            ("graphics and layout", "designer"),
            ("writer:", "writer"),
            ("contributors include", "contributor"),
            ("support|made possible", "supporter"),
            default=None,
        )
        about = first_of(low, ("project", "project"), ("work", "work"), default="report")
        found = (F.length(quote) >= 20) & quote.rlike(p.REPORT_METADATA) & ~is_citation_like(quote) & ~is_url_like(quote) & ~is_question(quote)
        return F.when(found, F.struct(kind.alias("metadata_type"), quote.alias("value"), entities(quote).alias("entities"), role.alias("role"), about.alias("applies_to")))

    return let(clean_quote(_text(text), 400), lambda quote: let(F.lower(quote), lambda low: of(quote, low)))


def is_funding_event(text: Column) -> Column:
    return report_metadata(text).isNull() & ~_text(text).rlike(p.FUNDING_SUMMARY) & ~_text(text).rlike(p.FUNDING_ADVICE) & _text(text).rlike(p.FUNDING_ACTION)


def funder(text: Column, start: Column) -> Column:
    """The last entity in the 140 characters before an amount."""
    from_ = F.greatest(F.lit(0), start - 140)
    return F.try_element_at(entities(F.substring(text, from_ + 1, start - from_)), F.lit(-1))


def recipient(text: Column, end: Column) -> Column:
    """The first entity that a preposition in the 160 characters behind an amount leads to."""
    return F.try_element_at(entities(_first(F.substring(text, end + 1, F.lit(160)), p.RECIPIENT)), F.lit(1))


def funding_purpose(quote: Column) -> Column:
    return clean_quote(_first(quote, p.FUNDING_PURPOSE), 140)


def funding_parties(quote: Column, amount: Column) -> Column:
    """funder, program and recipient around an amount, whatever the sentence's form: received from, launched, made by, to.

    The amount is put in the text as one mark, so that patterns needn't hold it.
    """
    has = (_text(quote) != "") & (_text(amount) != "")
    back = lambda c: F.replace(c, F.lit("\x01"), amount)
    one = lambda c, at: F.try_element_at(entities(back(c)), F.lit(at))
    named = lambda c, at: F.coalesce(one(c, at), clean_entity(back(c)))
    received = "(?i)^(.+?)\\s+received\\s+\x01.*?\\bfrom\\s+(.+?)(?:[.;,]|$)"

    def of(text: Column) -> Column:
        program = _first(text, "(?i)\\blaunched\\s+(.+?),\\s+a\\s+\x01\\s+program\\b")
        by = _first(text, r"(?i)\b(?:pledge|grant|investment|award).*?\b(?:made|provided|funded|awarded)\s+by\s+(.+?)(?:[.;,]|$)")
        to = _first(text, "(?i)\x01.*?\\b(?:to|for|supporting)\\s+(.+?)(?:[.;,]|$)")
        who = let(_first(text, received, 2), lambda giver: F.when(giver.isNotNull(), named(giver, 1)).otherwise(let(by, lambda by: F.when(by.isNotNull(), named(by, 1)))))
        whom = F.when(_text(text).rlike(received), one(_first(text, received, 1), -1)).otherwise(one(to, 1))
        what = let(program, lambda program: F.when(program.isNotNull(), named(program, -1)))
        return F.struct(F.when(has, who).alias("funder"), F.when(has, what).alias("program"), F.when(has, whom).alias("recipient"))

    return let(F.replace(_text(quote), amount, F.lit("\x01")), of)


def legal_kind(reference: Column) -> Column:
    ref = F.trim(reference)
    return (
        F.when(F.lower(ref).rlike(r"^(hb|sb|hr|h\.r\.|s\.)\s*\d+"), "bill_number")
        .when(F.lower(ref).rlike(r"usc|u\.s\.c"), "statute")
        .when(F.startswith(ref, F.lit("§")), "section")
        .when(ref.rlike(r"^\d{2,4}\s*(?:\([a-zA-Z0-9]+\)){1,4}$"), "legal_subsection")
        .otherwise("legal_reference")
    )


def clean_legal(reference: Column) -> Column:
    """Without marks behind it, and without closing brackets that nothing opens."""

    def of(ref: Column) -> Column:
        count = lambda x: F.length(ref) - F.length(F.replace(ref, F.lit(x), F.lit("")))
        extra = F.greatest(F.lit(0), F.least(count(")") - count("("), F.length(F.regexp_extract(ref, r"((?:\)\s*)*)$", 1))))
        # one bracket a time, as many as are too many; references have four at the most
        return let(extra, lambda extra: reduce(lambda r, k: let(r, lambda r: F.when(extra > k, F.rtrim(F.regexp_replace(r, r"\)$", ""))).otherwise(r)), range(5), ref))

    return let(F.regexp_replace(F.trim(_text(reference)), "[.,;]+$", ""), of)


def skips_legal(reference: Column, text: Column) -> Column:
    return _text(reference).rlike(r"(?i)^501\s*\(?c\)?\s*3?$") | F.contains(F.lower(_text(text)), F.lit("501(c)"))


# --- statements


def purpose_statement(text: Column) -> Column:

    def of(quote: Column) -> Column:
        found = (F.length(quote) >= 40) & quote.rlike(p.PURPOSE) & ~quote.rlike(p.ADVICE) & ~is_chart_or_methodology(quote) & ~is_citation_like(quote)
        return F.when(
            found,
            F.struct(
                quote.alias("statement_text"),
                clean_quote(_first(quote, p.PURPOSE_PROBLEM), 140).alias("problem"),
                beneficiaries(quote).alias("audience"),
                clean_quote(_first(quote, p.PURPOSE_STAKES), 140).alias("stakes"),
            ),
        )

    return let(first_sentence(text), of)


def beneficiaries(text: Column) -> Column:
    return clean_quote(_first(text, p.BENEFICIARIES), 100)


def impact_kind(text: Column) -> Column:
    return first_of(
        F.lower(_text(text)),
        ("backlog|need", "need"),
        ("economic impact|touched|served|reached|helped|created|generated", "accomplishment"),
        ("known funding|average grant|funding went|foundation funding", "funding_summary"),
        default="impact",
    )


def impact_value(text: Column) -> Column:
    """The first amount of money, else number, else word of magnitude."""
    return F.coalesce(collapsed(_first(text, p.MONEY)), F.trim(_first(text, p.NUMBER)), _first(text, p.MAGNITUDE))


def impact_statement(text: Column) -> Column:
    actor = F.try_element_at(entities(F.substring(_text(text), 1, 160)), F.lit(1))

    def of(quote: Column) -> Column:
        valued = quote.rlike(p.NUMBER) | quote.rlike(p.MONEY) | quote.rlike(p.MAGNITUDE)
        credited = F.contains(quote, F.lit(",")) & quote.rlike(p.ROLE_HINT)
        found = (F.length(quote) >= 30) & quote.rlike(p.IMPACT) & ~is_chart_or_methodology(quote) & ~is_definition_like_impact(quote) & (valued | (~credited & quote.rlike(p.IMPACT_NEED)))
        return F.when(
            found,
            F.struct(quote.alias("statement_text"), impact_kind(quote).alias("impact_type"), actor.alias("actor"), impact_value(quote).alias("value"), _first(quote, p.DATE).alias("time_period"), beneficiaries(quote).alias("beneficiaries")),
        )

    return let(first_sentence(text), of)


# --- resources


def is_resource_name(text: Column) -> Column:
    return _text(text).rlike(p.RESOURCE_HINT)


def is_resource_only_name(text: Column) -> Column:
    return _text(text).rlike(p.RESOURCE_ONLY)


def resource_kind(name: Column) -> Column:
    return first_of(F.lower(_text(name)), *[(k, "grant_program" if k == "grant" else k) for k in p.RESOURCE_KINDS], default="resource")


def is_plausible_resource(name: Column) -> Column:
    return is_resource_name(name) & let(F.lower(_text(name)), lambda low: F.length(low).between(5, 120) & ~low.rlike(p.RESOURCE_LEADS) & ~low.rlike(p.RESOURCE_PEOPLE))


def resource(text: Column) -> Column:
    """A resource named as a label or, else, as a phrase: resource_name, resource_type, description."""
    as_ = lambda name, about: F.struct(name.alias("resource_name"), resource_kind(name).alias("resource_type"), about.alias("description"))

    def by_label(one: Column, label: Column) -> Column:
        return F.when(is_plausible_resource(label), as_(label, clean_quote(one, 220)))

    def by_phrase(one: Column, phrase: Column) -> Column:
        named = (phrase != "") & ~F.lower(phrase).isin(p.CALLOUT_LABELS) & is_plausible_resource(phrase)
        return F.when(named, as_(phrase, sentence_containing(one, phrase)))

    def of(one: Column) -> Column:
        usable = (F.length(one) >= 5) & ~is_citation_like(one)
        found = let(_first(one, p.LABEL_VALUE), lambda said: F.when(F.coalesce(said.rlike(p.RESOURCE_HINT), F.lit(False)), let(clean_entity(said), lambda label: by_label(one, label))).otherwise(let(clean_entity(_first(one, p.RESOURCE_PHRASE)), lambda phrase: by_phrase(one, phrase))))
        return F.when(usable, found)

    return let(clean_quote(_text(text), 260), of)


# --- definitions


def definition_term(term: Column) -> Column:
    """Without quotes, marks, an article, a heading word in front or a qualifier behind."""
    bare = clean_entity(F.regexp_replace(_text(term), "^[ \"'“”‘’]+|[ \"'“”‘’]+$", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, p.TERM_PREFIX, ""), r"(?i)^(?:a|an|the)\s+", "")
    return clean_entity(F.regexp_replace(bare, p.TERM_QUALIFIER, ""))


def is_definition_term(term: Column) -> Column:

    def of(low: Column, n: Column) -> Column:
        upper = term.rlike("[A-Z]")
        capitals = (F.upper(term) == term) & term.rlike("[A-Za-z]")
        pronoun = low.isin(p.TERM_PRONOUNS + p.TERM_GENERIC) | F.split(low, r"\s+")[0].isin(p.TERM_PRONOUNS)
        return (term != "") & ~pronoun & (n <= 8) & ~(~upper & ((n > 3) | low.rlike(p.TERM_VERBS))) & ~(~capitals & low.rlike(p.TERM_VERBS_CASED))

    return let(F.lower(term), lambda low: let(n_words(term), lambda n: of(low, n)))


def definition(text: Column) -> Column:
    """term and definition: of `which means` where the text has it, else of the other forms."""
    parts = lambda pattern: F.struct(F.regexp_extract(_text(text), pattern, 1).alias("term"), F.regexp_extract(_text(text), pattern, 2).alias("means"))
    take = F.when(_text(text).rlike(p.WHICH_MEANS), parts(p.WHICH_MEANS)).otherwise(parts(p.DEFINITION))

    def of(term: Column, means: Column) -> Column:
        return F.when((means != "") & is_definition_term(term) & ~F.lower(F.trim(means)).rlike(p.DEFINITION_SKIPS), F.struct(term.alias("term"), F.trim(means).alias("definition")))

    return let(take, lambda said: let(definition_term(said["term"]), lambda term: of(term, said["means"])))


# --- numbers


def word_stats(text: Column) -> Column:
    """Worded shares, lower case, where the text says of what and is no idiom."""
    ok = _text(text).rlike(p.WORD_STAT_CONTEXT) & ~_text(text).rlike(p.WORD_STAT_IDIOM)
    return F.when(ok, F.transform(F.regexp_extract_all(_text(text), F.lit(p.WORD_STAT), 1), lambda x: F.lower(collapsed(x)))).otherwise(F.array().cast("array<string>"))


def is_strong_metric(value: Column) -> Column:
    return _text(value).rlike(p.STRONG_METRIC)


def unit_behind(text: Column, end: Column) -> Column:
    return F.lower(_first(F.substring(text, end + 1, F.lit(36)), p.UNITS))


def label_before(text: Column, start: Column) -> Column:
    """What stands before a value, back to the last full stop, 80 characters at the most."""
    from_ = F.greatest(F.lit(0), start - 80)
    prefix = F.regexp_replace(F.substring(text, from_ + 1, start - from_), r"^[ :\-,;]+|[ :\-,;]+$", "")
    return let(prefix, lambda prefix: F.when(prefix != "", clean_quote(F.trim(F.substring_index(prefix, ".", -1)), 80)))


def before(text: Column, start: Column, n: int) -> Column:
    from_ = F.greatest(F.lit(0), start - n)
    return F.substring(text, from_ + 1, start - from_)


def is_embedded_number(text: Column, start: Column, end: Column) -> Column:
    """A letter or dash next to it, or capitals near by that it belongs to."""
    left, right = before(text, start, 12), F.substring(text, end + 1, F.lit(12))
    return left.rlike(r"[\p{L}\-–‑]$") | right.rlike(r"^[\p{L}\-–‑]") | left.rlike("[A-Z]{2,}[-–‑]?$") | right.rlike("^[-–‑]?[A-Z]{2,}")


def is_day_of_month(text: Column, start: Column) -> Column:
    return before(text, start, 16).rlike(rf"(?i)\b{p.MONTH}\s*$")


def is_near_legal(text: Column, start: Column) -> Column:
    from_ = F.greatest(F.lit(0), start - 24)
    return F.substring(text, from_ + 1, start + 48 - from_).rlike(p.LEGAL)


def skips_number(value: Column, text: Column, start: Column) -> Column:
    """Whether a number is none to report: one digit, money, a year, part of a name, a day, a page, a section, a rank."""
    end = start + F.length(value)
    bare = F.regexp_replace(value, "^[ ,.;:]+|[ ,.;:]+$", "")
    prefix, suffix = F.lower(before(text, start, 16)), F.lower(F.substring(text, end + 1, F.lit(16)))
    return (
        value.rlike(r"^\d$")
        | is_money(value)
        | bare.rlike(r"^(?:19|20)\d{2,3}$")
        | is_embedded_number(text, start, end)
        | is_day_of_month(text, start)
        | is_near_legal(text, start)
        | prefix.rlike(r"\bfortune\s*$")
        | prefix.rlike(r"\b(page|p\.|section|§|usc|c\.f\.r\.)\s*$")
        | suffix.rlike(r"^\s*(?:u\.?s\.?c\.?|c\.?f\.?r\.?|usc|cfr)\b")
    )


def label_values(texts: Column) -> Column:
    """(label, value) of the texts `label: value` whose value has a number."""
    fits = F.filter(texts, lambda t: F.regexp_extract(t, p.LABEL_VALUE, 2).rlike(p.NUMBER))
    return F.transform(fits, lambda t: F.struct(clean_quote(F.regexp_extract(t, p.LABEL_VALUE, 1), 80).alias("label"), clean_quote(F.regexp_extract(t, p.LABEL_VALUE, 2), 80).alias("value")))


def overlaps(start: Column, end: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (start < s["end"]) & (end > s["start"]))


# --- questions and quotes


def prompt(text: Column, lead: Column) -> Column:
    """A question without its mark, as the styled lead of a text or the text itself."""

    def of(one: Column, said: Column) -> Column:
        ok = ~F.endswith(one, F.lit(":")) & (said != "") & ~F.contains(said, F.lit("?")) & (F.length(said) <= 150) & ~F.endswith(said, F.lit(".")) & said.rlike(p.QUESTION_PROMPT)
        return F.when(ok, said)

    bare = lambda one: F.regexp_replace(F.when(lead > 8, F.substring(one, F.lit(1), lead)).otherwise(one), "^[ :]+|[ :]+$", "")
    return let(clean_quote(_text(text), 220), lambda one: let(bare(one), lambda said: of(one, said)))


def answer_behind(text: Column, question: Column) -> Column:
    return let(F.instr(text, question), lambda at: F.when(at > 0, _or_null(clean_quote(F.trim(F.substring(text, at + F.length(question), F.length(text))), 180))))


def skips_question(question: Column, text: Column) -> Column:
    behind = F.substring(text, F.instr(text, question) + F.length(question), F.lit(8))
    quoted = (F.instr(text, question) > 0) & F.trim(behind).rlike("^[”\"]")
    return is_chart_or_methodology(question) | F.lower(_text(question)).rlike(p.QUESTION_SKIP_LEADS) | F.lower(_text(text)).rlike(p.QUESTION_SKIP_TEXTS) | quoted


def skips_quote(quote: Column, text: Column) -> Column:
    return F.contains(F.lower(_text(text)), F.lit("example:")) | _low(text).rlike(p.EXAMPLE_TEXTS) | F.lower(_text(quote)).rlike(p.LETTER_PHRASES) | ((n_words(_text(quote)) <= 4) & is_resource_name(quote))


def quotes(text: Column) -> Column:
    """What stands between quotation marks and is no example, letter or title."""
    return F.filter(F.regexp_extract_all(_text(text), F.lit(p.QUOTE), 1), lambda q: ~skips_quote(q, text))


# --- who said it

# Words of roles, and words that may stand beside them.
ROLES = ["secretary", "director", "president", "ceo", "officer", "manager", "chair", "minister", "attorney", "counsel"]
ROLE_MODIFIERS = ["former", "interim", "deputy", "executive", "hud"]


def is_credential(text: Column) -> Column:
    return F.trim(_text(text)).rlike(r"^(?:[A-Z]\.){1,4}$")


def is_role_only(text: Column) -> Column:
    words = F.transform(F.split(collapsed(_text(text)), " "), lambda w: F.lower(F.regexp_replace(w, "^[.,]+|[.,]+$", "")))
    return (collapsed(_text(text)) != "") & F.exists(words, lambda w: w.isin(ROLES)) & F.forall(words, lambda w: w.isin(ROLES + ROLE_MODIFIERS))


def is_person(text: Column) -> Column:
    """Two to four capitalised words that are not only roles."""
    words = F.transform(F.split(collapsed(_text(text)), " "), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.size(words).between(2, 4) & ~is_role_only(text) & F.forall(words, lambda w: w.rlike("^[A-Z][A-Za-z.'’-]+$"))


def is_speaker_line(text: Column) -> Column:
    return (_text(text) != "") & (F.length(text) <= 180) & ((F.contains(text, F.lit(",")) & is_person(F.substring_index(text, ",", 1))) | (is_person(text) & ~is_role_only(text)))


def is_role_line(text: Column) -> Column:
    return (_text(text) != "") & (F.length(text) <= 160) & (text.rlike(p.ROLE_HINT) | (F.contains(text, F.lit(",")) & (F.size(entities(text)) > 0)))


def starts_new_quote(text: Column) -> Column:
    return F.ltrim(_text(text)).rlike("^[“\"]") | (F.length(_text(text)) > 220)


def _parts(text: Column) -> Column:
    return F.filter(F.transform(F.split(_text(text), ","), F.trim), lambda x: x != "")


def role_may_follow(text: Column) -> Column:
    """No comma, or nothing but credentials behind it."""
    parts = _parts(text)
    return ~F.contains(text, F.lit(",")) | ((F.size(parts) >= 2) & F.forall(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts))), is_credential))


def attribution(text: Column, role: Column) -> Column:
    """speaker_name, speaker_title, speaker_affiliation of a speaker's line and, if there is one, the line with the role."""
    parts, roles = _parts(text), _parts(role)
    with_role = _text(role) != ""
    said = F.when(with_role, F.try_element_at(roles, F.lit(1))).otherwise(F.array_join(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts))), ", "))
    split = r"(?i)\b(.+?)\s+(?:of|at|for|with)\s+(.+)$"
    two, of = F.when(with_role, F.size(roles) >= 2).otherwise(F.lit(False)), _text(said).rlike(split)
    three = ~with_role & (F.size(parts) >= 3)
    last = F.when(with_role, said).otherwise(F.try_element_at(parts, F.lit(2)))
    hinted = _text(last).rlike(p.ROLE_HINT)
    title = F.when(two, said).when(of, F.regexp_extract(said, split, 1)).when(three, F.try_element_at(parts, F.lit(2))).when(hinted, last)
    where = F.when(two, F.array_join(F.slice(roles, 2, F.greatest(F.lit(1), F.size(roles))), ", ")).when(of, F.regexp_extract(said, split, 2)).when(three, F.array_join(F.slice(parts, 3, F.greatest(F.lit(1), F.size(parts))), ", ")).when(~hinted, last)
    some = (_text(text) != "") & (with_role | (F.size(parts) >= 2))
    name = F.try_element_at(parts, F.lit(1))
    return F.struct(
        F.when((_text(text) != "") & is_person(name), name).alias("speaker_name"),
        F.when(some, _or_null(clean_quote(title, 90))).alias("speaker_title"),
        F.when(some, _or_null(F.regexp_replace(clean_entity(where), r"^[ .]+|[ .]+$", ""))).alias("speaker_affiliation"),
    )
