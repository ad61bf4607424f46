"""Queries that take every row, on fixtures that hold what a filter or a cap would leave out."""

import datetime
import re

import leafloom.catalogue as catalogue


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_checks_are_asked_of_every_document(spark, tmp_path):
    long = "Heading one\n" + "\n".join(f"line {k} of many words" for k in range(60)) + "\n\nThe END, at last."
    rows = [(1, "en", "a", long), (2, "en", "a", "short"), (3, "de", "b", "\nnot first\nother"), (4, None, None, None), (5, "en", "a", ""), (6, "en", "a", "same end\nmiddle\nsame end"), (7, "fr", "a", "a b c\nx a b c y")]
    key = lambda s: re.sub("[^a-z0-9]+", "", s.lower())
    want = set()
    for i, *_, text in rows:
        lines = [(n, s) for n, s in enumerate((text or "").split("\n")) if s.strip(" ")]
        first, last = (key(lines[0][1]), key(lines[-1][1])) if lines else (None, None)
        at = lambda t: min(n for n, s in lines if t in key(s))
        both = any(first in key(s) and last in key(s) for _, s in lines)
        passed = [bool(lines), True, bool(lines) and at(first) < at(last), both, bool(lines) and not both, any(n == 0 and first in key(s) for n, s in lines), any(key(s) == last for _, s in lines)]
        want |= {(10 * i + k, kind, p) for k, (kind, p) in enumerate(zip("in_flow absent order merge split role freeze".split(), passed))}
    found = catalogue.assertion_checks(spark, documents(spark, tmp_path, rows)).collect()
    assert {(r.check_id, r.kind, r.passed) for r in found} == want and len(found) == 7 * len(rows)


def test_acronyms_of_documents_in_any_language(spark, tmp_path):
    rows = [(1, "de", "a", "Die EU, UNO und die NATO EU"), (2, None, "a", "WHO (EU)\nÉEU EUÉ A TOOLONGX EU_ x9EU"), (3, "en", "a", "EU"), (4, "fr", "a", "l'OTAN—UE")]
    found = catalogue.acronym_terms_all(spark, documents(spark, tmp_path, rows)).collect()
    assert {(r.term, r.n, r.n_docs) for r in found} == {("EU", 4, 3), ("UNO", 1, 1), ("NATO", 1, 1), ("WHO", 1, 1), ("OTAN", 1, 1), ("UE", 1, 1)}


def test_natural_order_places_every_row(spark, tmp_path):
    rows = [(k, f"part {k}", f"Brand#{k * 7 % 120}") for k in range(600)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").repartition(5).write.parquet(f"{tmp_path}/part.parquet")
    want = {(k, name, n + 1) for n, (k, name, _) in enumerate(sorted(rows, key=lambda r: (int(r[2][6:]), r[0])))}
    found = catalogue.natural_order(spark, str(tmp_path)).collect()
    assert {(r.p_partkey, r.p_name, r.place) for r in found} == want and len(found) == 600


def test_matrix_counts_every_day(spark, tmp_path):
    rows = [("a", datetime.datetime(2024, 1, d)) for d in range(1, 32)] + [("b", datetime.datetime(2024, 2, 29)), ("b", datetime.datetime(2024, 3, 29)), ("b", None)]
    spark.createDataFrame(rows, "event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    found = {r.event_type: r for r in catalogue.pattern_matrix_days(spark, str(tmp_path)).collect()}
    assert [found["a"][f"d{k}"] for k in range(1, 32)] == [1] * 31 and found["a"].total == 31
    assert (found["b"].d29, found["b"].d1, found["b"].total) == (2, 0, 3)
