"""Column expressions over leaf text: cleaning, extraction and gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE = rf"\b((?:{MONTHS}) [0-9]{{1,2}}, [0-9]{{4}}|(?:{MONTHS}) [0-9]{{4}})\b"
MONEY = r"(\$[0-9][0-9,]*(?:\.[0-9]+)?(?: (?:thousand|million|billion))?)"
NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
ACRONYM = r"\b([A-Z]{2,6})\b"
#: The same between letters and digits of any script, whatever the engine takes for a word's edge.
ACRONYM_ANY = r"(?<![\p{L}\p{N}_])([A-Z]{2,6})(?![\p{L}\p{N}_])"
FUNDING = r"(?i)\b(award|grant|fund|invest|donat)[a-z]*\b"
LABEL_VALUE = r"^([A-Z][A-Za-z ]{1,40}): +(.+)$"
QUESTION = r"\?\s*$"
CAPITALISED = r"([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)+)"


def collapsed(text: Column) -> Column:
    """White space runs, in any script, become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), the value worked out once, however often `of` names it: an expression is else written out, and evaluated, at each place, and rules upon rules multiply."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def clean_quote(text: Column, limit: int = 240) -> Column:
    """Collapsed text, cut behind limit - 1 characters with a mark of the cut."""
    return let(collapsed(text), lambda one: F.when(F.length(one) > limit, F.concat(F.rtrim(F.substring(one, 1, limit - 1)), F.lit("..."))).otherwise(one))


def tokens(text: Column) -> Column:
    """Distinct lower-case letter-digit words of more than two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), lambda x: F.length(x) > 2))


def key_text(text: Column) -> Column:
    """Letters and digits only, lower case: the key that texts are compared by."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def entities(text: Column, most: int = 6) -> Column:
    """Distinct capitalised phrases in order, at most `most`."""
    return F.slice(F.array_distinct(extract_all(text, CAPITALISED)), 1, most)


def first_of(value: Column, *cases: tuple[str, str], default: str) -> Column:
    """The name of the first pattern that matches."""

    def of(value: Column) -> Column:
        out = None
        for pattern, name in cases:
            out = F.when(value.rlike(pattern), name) if out is None else out.when(value.rlike(pattern), name)
        return out.otherwise(default)

    return let(value, of)


def natural_key(text: Column) -> Column:
    """Sorts numbers inside text by value, however long: each is led by how many digits it has."""
    parts = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), 1)
    bare = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 10, "0"), bare(x))).otherwise(x)), "")


PROPER_NAME = r"([A-Z][a-z]+(?: (?:(?:of|the|and|for) )?[A-Z][a-z]+)+)"
MIXED_CASE = r"\b([A-Z][a-z]+[A-Z][A-Za-z]*|[a-z]+[A-Z][A-Za-z]*)\b"


def word_salad(text: Column) -> Column:
    """Whether a text is mostly fragments: at least 5, or 40 % of its sentences, of two words or fewer."""
    parts = F.filter(F.split(text, r"[.!?]+"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(parts, lambda x: F.size(F.split(F.trim(x), r"\s+")) <= 2))
    return (short >= 5) | (short >= 0.4 * F.size(parts))


def luminance(hex_color: Column) -> Column:
    """0 to 255 of a #rrggbb colour."""
    part = lambda k: F.conv(F.substring(hex_color, k, 2), 16, 10).cast("int")
    return part(2) * 0.299 + part(4) * 0.587 + part(6) * 0.114


def sentence_case(text: Column) -> Column:
    """First letter upper, the rest lower, acronyms kept."""
    words = F.transform(F.split(text, " "), lambda w, i: F.when(w.rlike("^[A-Z]{2,}$"), w).when(i == 0, F.initcap(w)).otherwise(F.lower(w)))
    return F.array_join(words, " ")
