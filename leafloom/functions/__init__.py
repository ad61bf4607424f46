"""Functions for SQL text: register(spark) makes them known to a session."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FindSpans:
    """Table function: every match of a pattern in a text, with its place. Nulls have none."""

    def eval(self, text: str, pattern: str):
        if text is not None and pattern is not None:
            for n, m in enumerate(re.finditer(pattern, text)):
                yield n, m.start(), m.end(), m.group()


HIDDEN = {"head", "style", "script", "nav", "footer", "template", "noscript"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "blockquote", "div", "article", "section", "figcaption"}
VOID = {"br", "img", "hr", "meta", "link", "input"}


class Blocks(HTMLParser):
    """Visible text by block element; tolerant of tags left open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.tag, self.text, self.found = 0, "", [], []

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.found.append((self.tag, text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.flush()
            self.hidden += 1
        elif tag in BLOCKS:
            self.flush()
            self.tag = tag
        elif tag in VOID:
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.flush()
            self.tag = ""

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


BLOCK_TYPE = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(BLOCK_TYPE)
def html_blocks(html: pd.Series) -> pd.Series:
    """Visible blocks of a page in order; null and empty pages have none."""

    def one(page):
        parser = Blocks()
        parser.feed(page or "")
        parser.close()
        parser.flush()
        return [{"tag": t, "text": x} for t, x in parser.found]

    return html.map(one)


def register(spark: SparkSession) -> None:
    from ..operators.match import similarity

    spark.udtf.register("find_spans", F.udtf(FindSpans, returnType="n int, start int, end int, value string"))
    spark.udf.register("similarity", similarity)
    spark.udf.register("html_blocks", html_blocks)
