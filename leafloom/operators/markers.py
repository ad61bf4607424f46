"""List and note markers, numbers and labels of single lines, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lettered notes count from here, apart from numbered ones.
LETTERS_FROM = 1000
_ONES = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
_TENS = ("", "x", "xx")


def roman(number: Column) -> Column:
    """1 to 29 as lower-case Roman numerals, null beyond."""
    spelled = [tens + ones for tens in _TENS for ones in _ONES][1:]
    return F.when(number.between(1, len(spelled)), F.element_at(F.array(*[F.lit(s) for s in spelled]), number.cast("int")))


def marker_value(raw: Column) -> Column:
    """The number of a note's marker: up to three digits, a Roman numeral to xx, or a letter (a is 1001); null for anything else.

    i, v and x are Roman: a lettered series loses these.
    """
    mark = F.lower(F.trim(F.regexp_replace(F.trim(raw), r"[.)]+$", "")))
    romans = F.array(*[F.lit((_TENS[k // 10] + _ONES[k % 10])) for k in range(1, 20)], F.lit("xx"))
    place = F.array_position(romans, mark)
    return F.when(mark.rlike(r"^[0-9]{1,3}$"), mark.try_cast("int")).when(place > 0, place.cast("int")).when(mark.rlike("^[a-z]$"), F.ascii(mark) - 96 + LETTERS_FROM)


def marker_label(value: Column) -> Column:
    """A note's number as it is shown: its letter for lettered ones."""
    return F.when(value > LETTERS_FROM, F.char((value - LETTERS_FROM + 96).cast("long"))).otherwise(value.cast("string"))


def ordinal_marker(line: Column) -> Column:
    """What a list line begins with: style (decimal, lower-alpha, upper-alpha), n, length of the marker; null where there is none."""
    found = F.regexp_extract(line, r"^(([0-9]{1,2}|[A-Za-z])\s?[.)]\s+)", 1)
    mark = F.regexp_extract(line, r"^([0-9]{1,2}|[A-Za-z])\s?[.)]\s+", 1)
    style = F.when(mark.rlike("[0-9]"), "decimal").when(mark.rlike("[a-z]"), "lower-alpha").otherwise("upper-alpha")
    n = F.when(mark.rlike("[0-9]"), mark.try_cast("int")).otherwise(F.ascii(F.lower(mark)) - 96)
    return F.when(found != "", F.struct(style.alias("style"), n.alias("n"), F.length(found).alias("length")))


def letters(text: Column) -> Column:
    """How many letters and digits a text has."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def all_caps(text: Column) -> Column:
    """Whether there are letters and none is lower case."""
    return text.rlike(r"\p{L}") & (F.upper(text) == text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z'’-]*)"), 1)


def heading_key(text: Column) -> Column:
    """A heading without white space runs and the page number behind it."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.trim(F.regexp_replace(one, r"\s+[0-9]{1,4}$", ""))


def may_repeat(text: Column) -> Column:
    """Whether a block reads like a page's running head: 3 to 12 words, half of them (two at least) capitalised, no end of sentence."""
    key = heading_key(text)
    found = words(key)
    capitals = F.size(F.filter(found, lambda w: w.rlike("^[A-Z]")))
    return ~key.rlike("[.!?]") & F.size(found).between(3, 12) & (capitals >= 2) & (2 * capitals >= F.size(found))


def section_number(text: Column) -> Column:
    """number and title where one or two digits stick to a capitalised word."""
    n = F.regexp_extract(text, r"^([0-9]{1,2})[A-Z]", 1)
    return F.when(n != "", F.struct(n.cast("int").alias("number"), F.substring(text, F.length(n) + 1, F.length(text)).alias("title")))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def usable_colour(colour: Column) -> Column:
    """A #rrggbb colour, null where it is nearly white (every channel over 225)."""
    part = lambda k: F.conv(F.substring(colour, k, 2), 16, 10).cast("int")
    return F.when(F.least(part(2), part(4), part(6)) <= 225, colour)


def font_name(name: Column) -> Column:
    """A font without the tag that marks a subset."""
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "")


def font_weight(name: Column) -> Column:
    """The weight a font's name speaks of; 400 if none."""
    low = F.lower(name)
    return F.when(low.rlike("black|heavy|extrabold"), 800).when(low.rlike("semi|demi"), 600).when(low.rlike("bold"), 700).when(low.rlike("medium"), 500).when(low.rlike("light|thin"), 300).otherwise(400)


def escaped(text: Column) -> Column:
    """Text as HTML shows it literally; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def context(text: Column, term: Column, width: int = 180) -> Column:
    """The part of a text around a term's first place, half the width on both sides, with marks where it was cut; null where the term isn't there."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.position(F.lower(term), F.lower(one))
    first = F.greatest(F.lit(1), at - width // 2)
    last = F.least(F.length(one), at + F.length(term) - 1 + width // 2)
    cut = F.substring(one, first, last - first + 1)
    return F.when(at > 0, F.concat(F.when(first > 1, F.lit("...")).otherwise(""), F.trim(cut), F.when(last < F.length(one), F.lit("...")).otherwise("")))


def number_runs(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Per key the distinct numbers as text, neighbours joined: 3, 8-12."""
    w = Window.partitionBy(*keys).orderBy(number)
    distinct = rows.where(F.col(number).isNotNull()).select(*keys, number).distinct().withColumn("_g", F.col(number) - F.row_number().over(w))
    spans = distinct.groupBy(*keys, "_g").agg(F.min(number).alias("_a"), F.max(number).alias("_b"))
    said = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("string")).otherwise(F.concat_ws("-", F.col("_a").cast("string"), F.col("_b").cast("string")))
    listed = F.array_sort(F.collect_list(F.struct("_a", said.alias("s"))))
    return spans.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["s"]), ", ").alias("runs"))
