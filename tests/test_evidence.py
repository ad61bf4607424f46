"""Evidence rules on texts that meet them and texts that don't."""

from pyspark.sql import functions as F

from leafloom.operators import evidence as e


def ask(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_sentences_around_spans(spark):
    t = F.lit("One is here. Two has 42 in it! Three ends")
    at = F.lit(21)
    r = ask(spark, around=e.sentence_around(t, at, at + 2), last=e.sentence_around(t, F.lit(32), F.lit(35)), before=e.sentence_before(t, F.lit(31)), none=e.sentence_before(t, F.lit(0)), holds=e.sentence_containing(t, F.lit("is here")), first=e.first_sentence(F.lit("One two. Three.")), all=e.first_sentence(F.lit("no end")))
    assert (r.around, r.last, r.before, r.none, r.holds, r.first, r.all) == ("Two has 42 in it!", "Three ends", "Two has 42 in it!", None, "One is here.", "One two.", "no end")
    r = ask(spark, alone=e.reference_context(F.lit("It grew. [3] More."), F.lit(9), F.lit(12), F.lit("[3]")), own=e.reference_context(F.lit("It grew [3]. More."), F.lit(8), F.lit(11), F.lit("[3]")))
    assert r.own == "It grew [3]."


def test_numbers(spark):
    def skips(value, text):
        return e.skips_number(F.lit(value), F.lit(text), F.lit(text.index(value)))

    yes = {"a": skips("5", "has 5 of"), "b": skips("2021", "in 2021 we"), "c": skips("19", "COVID-19 rose"), "d": skips("12", "on May 12 they"), "f": skips("34", "see page 34 there"), "g": skips("500", "a Fortune 500 firm"), "h": skips("$40", "paid $40 for"), "i": skips("552", "under 5 U.S.C. 552, all")}
    no = {"j": skips("250", "served 250 families"), "k": skips("48", "about 48 percent of all")}
    r = ask(spark, **yes, **no)
    assert all(r[k] for k in yes) and not any(r[k] for k in no)
    r = ask(spark, unit=e.unit_behind(F.lit("served 250 Families, 30 students"), F.lit(23)), label=e.label_before(F.lit("Old. Total served: 250"), F.lit(19)), none=e.unit_behind(F.lit("250 x"), F.lit(3)))
    assert (r.unit, r.label, r.none) == ("students", "Total served", None)
    r = ask(spark, lv=e.label_values(F.array(F.lit("Grants: 45 made"), F.lit("Grants: many"), F.lit("none"))), over=e.overlaps(F.lit(3), F.lit(5), F.expr("array(struct(5 as start, 9 as end), struct(0 as start, 4 as end))")))
    assert [(x.label, x.value) for x in r.lv] == [("Grants", "45 made")] and r.over


def test_funding_parties_and_law(spark):
    q = F.lit("Bay Clinic received $5 million last May from Harbor Relief Foundation.")
    by = F.lit("A grant of $5 million to Delta Health Network was funded by Harbor Relief Foundation.")
    new = F.lit("Harbor launched Safe Streets Project, a $5 million program for all.")
    m = F.lit("$5 million")
    r = ask(spark, a=e.funding_parties(q, m), b=e.funding_parties(by, m), c=e.funding_parties(new, m), d=e.funder(q, F.lit(20)), f=e.recipient(by, F.lit(21)), g=e.funding_purpose(F.lit("gave it to build homes. Then")))
    assert (r.a.funder, r.a.recipient) == ("Harbor Relief Foundation", "Bay Clinic")
    assert (r.b.funder, r.b.recipient) == ("Harbor Relief Foundation", "Delta Health Network")
    assert (r.c.program, r.d, r.f, r.g) == ("Safe Streets Project", "Bay Clinic", "Delta Health Network", "build homes")
    r = ask(spark, a=e.clean_legal(F.lit("552(b)(4)).;")), b=e.clean_legal(F.lit("§ 12(a)")), c=e.skips_legal(F.lit("501(c)3"), F.lit("x")), d=e.skips_legal(F.lit("§ 3"), F.lit("see § 3")), money=e.is_money(F.lit("$1,200 million")), not_money=e.is_money(F.lit("1200")))
    assert (r.a, r.b, r.c, r.d, r.money, r.not_money) == ("552(b)(4)", "§ 12(a)", True, False, True, False)


def test_questions_and_quotes(spark):
    r = ask(
        spark,
        a=e.prompt(F.lit("How families find shelter Many ask"), F.lit(25)),
        b=e.prompt(F.lit("How families find shelter."), F.lit(None).cast("int")),
        c=e.answer_behind(F.lit("Who came? Ten people."), F.lit("Who came?")),
        d=e.skips_question(F.lit("Who came?"), F.lit("Figure 2 Who came?")),
        f=e.skips_question(F.lit("Who came?"), F.lit("He said “Who came?” twice")),
        g=e.skips_question(F.lit("Who came?"), F.lit("Who came? Ten.")),
        h=e.quotes(F.lit("She said “we have waited for years to see this day” at last")),
        i=e.quotes(F.lit("Example: “we have waited for years to see this day”")),
    )
    assert (r.a, r.b, r.c, r.d, r.f, r.g, len(r.h), r.i) == ("How families find shelter", None, "Ten people.", True, True, False, 1, [])


def test_attribution(spark):
    def of(text, role=None):
        return e.attribution(F.lit(text), F.lit(role).cast("string"))

    r = ask(spark, a=of("Jane Doe, Director of Bay Clinic"), b=of("Jane Doe, CEO, Bay Clinic, Ohio"), c=of("Jane Doe, CEO"), d=of("Jane Doe, Ohio"), f=of("Jane Doe", "CEO, Bay Clinic"), g=of("Jane Doe", "Director at Bay Clinic"), h=of(""), i=of("somebody else"))
    got = [tuple(r[k]) for k in "abcdfghi"]
    assert got == [("Jane Doe", "Director", "Bay Clinic"), ("Jane Doe", "CEO", "Bay Clinic, Ohio"), ("Jane Doe", "CEO", None), ("Jane Doe", None, "Ohio"), ("Jane Doe", "CEO", "Bay Clinic"), ("Jane Doe", "Director", "Bay Clinic"), (None, None, None), (None, None, None)]
    r = ask(spark, a=e.is_speaker_line(F.lit("Jane Doe, J.D.")), b=e.is_speaker_line(F.lit("Executive Director")), c=e.is_role_line(F.lit("Director, City")), d=e.role_may_follow(F.lit("Jane Doe, J.D.")), f=e.role_may_follow(F.lit("Jane Doe, CEO")), g=e.starts_new_quote(F.lit(" “We")), h=e.is_role_only(F.lit("Former Deputy Secretary")))
    assert tuple(r) == (True, False, True, True, False, True, True)


def test_nulls_and_empty_texts(spark):
    none, empty = F.lit(None).cast("string"), F.lit("")
    for t in (none, empty):
        r = ask(spark, a=e.is_evidence(t), b=e.report_metadata(t), c=e.purpose_statement(t), d=e.impact_statement(t), f=e.resource(t), g=e.definition(t), h=e.entities(t), i=e.places(t), j=e.word_stats(t), k=e.is_url_like(t), m=e.quotes(t))
        assert tuple(r) == (False, None, None, None, None, None, [], [], [], False, [])
