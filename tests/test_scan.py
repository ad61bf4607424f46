"""Candidates of all families: hand-made texts, nulls, repeats, empty tables."""

import re

from pyspark.sql import functions as F

from leafloom.operators import evidence, patterns, scan

LEAVES = "document_id string, nid string, page int, ord int, kind string, level int, text string, lead int, quote_open boolean, refs array<struct<s:int,e:int,v:string>>"
CONTAINERS = "document_id string, nid string, page int, kind string, quote boolean, header boolean, ordered boolean, texts array<string>, open int"


def leaf(nid, text, page=1, kind="paragraph", level=None, refs=None, quote=None, ord_=0):
    return ("d", nid, page, ord_, kind, level, text, None, quote, refs)


def test_places_of_matches(spark):
    texts = ["in 2019, 2020 and May 2021", "none", "", "2019", "é 2019 ü 1999-2001.", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scan.spans(F.coalesce("t", F.lit("")), patterns.DATE).alias("s"))
    for r in df.collect():
        assert [(x.start, x.end, x.v) for x in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer(patterns.DATE, r.t or "")]


def test_families_in_one_line(spark):
    rows = [
        leaf("a", "In 2019, the Ohio Health Foundation awarded $5 million to the Green Valley School Project, and 25% of households in Texas took part for many years of work under HB 120.", refs=[(0, 2, "7")]),
        leaf("b", "The total of $30 million in grants went to schools."),
        leaf("c", "The need to act is urgent because families wait for housing in every county of the state."),
        leaf("d", "The Journal of Housing found 40% in 2010."),
        leaf("e", "Figure 3 shows 40% in 2010."),
        leaf("f", "We find that 40 percent of students and 300 schools gained.", page=2, ord_=1),
        leaf("g", "Nearly two-thirds of students read.", page=2, ord_=2),
        leaf("h", "Green Valley Community Health Center", kind="heading", level=2),
        leaf("i", "Why do we go on with this work", quote=True),
        leaf("a", "In 2019, the Ohio Health Foundation awarded $5 million to the Green Valley School Project, and 25% of households in Texas took part for many years of work under HB 120.", refs=[(0, 2, "7")]),
        leaf("z", None),
        (None, "n", 1, 0, "paragraph", None, "In 2019", None, None, None),
    ]
    got = {(r.nid, r.pattern_type, r.value) for r in scan.candidates(spark.createDataFrame(rows, LEAVES)).collect()}
    assert got == {
        ("a", "legal_reference", "HB 120"), ("a", "funding_event", "$5 million"), ("a", "entity_relationship", "Ohio Health Foundation -> Green Valley School Project"), ("a", "date_time_period", "2019"),
        ("a", "geography_place", "Ohio"), ("a", "geography_place", "Texas"), ("a", "statistic", "25%"), ("a", "source_note_reference", "7"), ("a", "resource", "Green Valley School Project"),
        ("a", "named_entity", "Ohio Health Foundation"), ("a", "named_entity", "Green Valley School Project"),
        ("b", "impact_statement", "$30 million"),
        ("c", "purpose_statement", "The need to act is urgent because families wait for housing in every county of the state."),
        ("f", "key_finding", "We find that 40 percent of students and 300 schools gained."), ("f", "statistic", "40 percent"), ("f", "statistic", "300"), ("g", "statistic", "nearly two-thirds"), ("f", "metric_cluster", "40 percent, 300, nearly two-thirds"),
        ("h", "named_entity", "Green Valley Community Health Center"),
        ("i", "quotation", "Why do we go on with this work"), ("i", "question", "Why do we go on with this work"),
    }


def test_first_find_wins(spark):
    rows = [leaf("h", "North River School Project", kind="heading", level=1)]
    got = {(r.pattern_type, r.confidence) for r in scan.candidates(spark.createDataFrame(rows, LEAVES)).where("pattern_type = 'resource'").collect()}
    assert len(got) == 1 and got == {("resource", 0.68)}  # the leaf's find comes before the heading's


def test_containers(spark):
    rows = [
        ("d", "q", 1, "aside", True, None, None, ["“We did it together.”", "Jane Smith", "Director, Green Valley Foundation"], 0),
        ("d", "s", 1, "aside", None, None, None, ["Plain words beside the text", None], None),
        ("d", "t", 1, "table", None, True, None, ["Jobs: 20", "Homes: 35 units", "No number: here"], None),
        ("d", "l", 1, "list", None, None, None, ["What is it that you do?", "Why do you do it this way?", "An answer"], None),
        ("d", "p", 1, "list", None, None, None, ["Create a plan", "Fund the plan", "Rest"], None),
        ("d", "o", 1, "list", None, None, True, ["a", "b", "c"], None),
        ("d", "n", 1, "list", None, None, None, ["a", "b", "c"], None),
        ("d", "e", 1, "table", None, None, None, None, None),
        (None, "x", 1, "table", None, None, None, ["a"], None),
    ]
    found = scan.first_finds(scan.container_finds(spark.createDataFrame(rows, CONTAINERS)))
    assert {(r.nid, r.pattern_type) for r in found.collect()} == {("q", "callout"), ("q", "quotation"), ("q", "named_entity"), ("q", "entity_relationship"), ("s", "callout"), ("t", "comparison_table"), ("t", "metric_cluster"), ("l", "question_list"), ("p", "process_step_list"), ("o", "process_step_list")}
    said = found.where("nid = 'q' AND pattern_type = 'quotation'").first()
    assert (said.fields["speaker_name"], said.fields["speaker_affiliation"], said.confidence) == ("Jane Smith", "Green Valley Foundation", 0.84)
    assert found.where("nid = 'q' AND pattern_type = 'named_entity'").count() == 2


def test_notes_and_nothing(spark):
    notes = spark.createDataFrame([("d", "f", 1, "3", "See there."), ("d", "f", 1, "4", None), (None, "f", 1, "5", "lost")], "document_id string, nid string, page int, marker string, text string")
    assert [(r.nid, r.value) for r in scan.first_finds(scan.note_finds(notes)).collect()] == [("f:note:3", "3")]
    empty = spark.createDataFrame([], LEAVES)
    assert scan.candidates(empty, spark.createDataFrame([], CONTAINERS), notes.limit(0)).count() == 0


NEEDS = ["HB 12", "42 U.S.C. § 3", "§ a", "12 (b)", "The report was made possible by us", "Core Operating Support of all is provided by us", "GENEROUS data sharing", "writer: me", "graphics and layout by us", "$5 million", "Urgent", "why it matters", "a problem to solve", "our mission is to be", "Improved", "needs", "a Toolkit", "indices", "one-half", "three-quarters", "May 2019", "West Virginia", "“so", '"so', "why?", " \x0b: Which of them", "A means b", "A is known as b", "this shows it", "We find", "Green Valley Clinic", "\u00e9t\u00e9 2019"]


def test_look_lets_through_what_a_candidate_needs(spark):
    rows = [leaf(f"n{k}", t) for k, t in enumerate(NEEDS)] + [leaf("h", "plain", kind="heading"), leaf("q", "plain", quote=True), leaf("r", None, refs=[(0, 1, "1")])]
    rows += [leaf(f"x{k}", t) for k, t in enumerate(["Plain words beside the text", "", None, "ohio", "anyhow, somewhere"])] + [(None, "n", 1, 0, "heading", None, "2019", None, None, None)]
    got = scan.looked(spark.createDataFrame(rows, LEAVES))
    assert sorted(r.nid for r in got.collect()) == sorted([f"n{k}" for k in range(len(NEEDS))] + ["h", "q", "r"])
    # every word that a family begins with is in the look
    for asked in (patterns.IMPACT, patterns.RESOURCE_HINT, patterns.KEY_FINDING):
        for w in asked[asked.index(r"\b(") + 3 : asked.rindex(")")].replace("s?", "").split("|"):
            assert re.search(patterns.LOOK, w)
    for w in [*patterns.STATES, *patterns.ENTITY_SUFFIXES]:
        assert re.search(patterns.LOOK, w)


def test_rules_upon_rules_are_written_out_once(spark):
    df = spark.createDataFrame([("We gave $5 million to it. Then not.", 8)], "t string, s int")
    rule = evidence.is_evidence(evidence.sentence_around(F.col("t"), F.col("s"), F.col("s") + 2))
    plan = df.select(rule.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") < 20  # more than a thousand where each rule repeats its text
    assert df.select(rule.alias("x")).first().x
    # few bytes of leaves and containers are still work for all tasks
    few = spark.createDataFrame([leaf(str(k), "In 2019") for k in range(40)], LEAVES).coalesce(1)
    assert scan.looked(few).rdd.getNumPartitions() == 4
