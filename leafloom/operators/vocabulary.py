"""What a document itself says about its words: whether a word that a line's end broke is joined.

Nulls: a line without text is empty. Equal rows count as they stand. An empty table
gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grouped import grouped

TOKEN = re.compile(r"[A-Za-z][A-Za-z-]*[A-Za-z]")
LAST, FIRST, CHAIN = re.compile(r"([A-Za-z]+)-$"), re.compile(r"[A-Za-z]+"), re.compile(r"[A-Za-z]+(?:-[A-Za-z]+)+")


def glue(before: str, line: str, words: set[str]) -> str:
    """How a line goes on with one that ends with a hyphen. words: those the document writes within its lines, in lower case."""
    a = LAST.search(before)
    if line[:1].islower():
        chain = CHAIN.match(line)
        return "keep" if a and chain and f"{a[1]}-{chain[0]}".lower() in words else "join"
    b = FIRST.match(line)
    if line[:1].isupper() and a and b and (a[1] + b[0]).lower() in words and f"{a[1]}-{b[0]}".lower() not in words:
        return "join"
    return "space"


def line_glue(lines: DataFrame, key: str, block: str, order: str, text: str) -> DataFrame:
    """key, block, order, glue of the lines that begin with a letter and follow, in their block, one that ends with a hyphen (see inline.flowed).

    Before a small letter the hyphen goes ('join'), unless the line goes on with a
    hyphenated word and the document writes the whole of both with hyphens ('keep').
    Before a capital it goes only where the document has the joined word and not the
    hyphenated one; else the line goes on after a space ('space'). The word before
    the break is that of the line before. Text is shuffled once; a task holds a
    document's lines and its words.
    """
    rows = lines.where(F.col(key).isNotNull()).select(key, block, order, F.coalesce(text, F.lit("")).alias("_t"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("glue", T.StringType())])

    def work(group: list[tuple]) -> list[tuple]:
        broken = [k for k in range(1, len(group)) if group[k][1] == group[k - 1][1] and group[k - 1][3].endswith("-") and group[k][3][:1].isalpha()]
        words = {w.lower() for g in group for w in TOKEN.findall(g[3])} if broken else set()
        return [(*group[k][:3], glue(group[k - 1][3], group[k][3], words)) for k in broken]

    return grouped(rows, [key], [block, order, "_t"], work, schema)
