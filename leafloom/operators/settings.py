"""Layered settings and texts with names in them.

Nulls: a null text stays null, a null map knows no name. Equal rows count as they
stand. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import patterns

#: Rounds of names within values; what then still has names is told.
ROUNDS = 5


def _filled(text: Column, pattern: str, value) -> Column:
    """Every match of pattern replaced, in one pass; value: from the match's names and its second groups, by place."""
    pieces = F.split(text, pattern, -1)
    names = F.regexp_extract_all(text, F.lit(pattern), 1)
    return F.array_join(F.transform(pieces, lambda piece, k: F.when(k == 0, piece).otherwise(F.concat(value(F.element_at(names, k.cast("int")), k), piece))), "")


def interpolated(text: Column, tokens: Column) -> Column:
    """{name} replaced by the map's value, in one pass; a name that the map doesn't have stays as it is."""
    known = F.coalesce(tokens, F.create_map().cast("map<string,string>"))
    return _filled(text, patterns.TOKEN_NAME, lambda name, _: F.coalesce(F.try_element_at(known, name), F.concat(F.lit("{"), name, F.lit("}"))))


def with_values(df: DataFrame, text: str, values: str, into: str, rounds: int = ROUNDS) -> DataFrame:
    """df with `into`, the text with every var(--name, fallback) replaced by the map's value, its fallback or nothing, again and again; `rounds_` (rounds that changed it) and `open_` (names are left: a circle, or a chain longer than `rounds`)."""
    known = F.coalesce(F.col(values), F.create_map().cast("map<string,string>"))
    out = df.withColumns({"_t0": F.col(text), "_k": known})
    for r in range(rounds):
        before = F.col(f"_t{r}")
        others = F.regexp_extract_all(before, F.lit(patterns.NAMED_VALUE), 2)
        step = _filled(before, patterns.NAMED_VALUE, lambda name, k, others=others: F.coalesce(F.nullif(F.try_element_at("_k", name), F.lit("")), F.trim(F.coalesce(F.element_at(others, k.cast("int")), F.lit("")))))
        out = out.withColumn(f"_t{r + 1}", F.when(before.contains("var("), step).otherwise(before))
    changes = sum((F.when(F.col(f"_t{r}") != F.col(f"_t{r + 1}"), 1).otherwise(0) for r in range(rounds)), F.lit(0))
    last = F.col(f"_t{rounds}")
    return out.withColumns({into: last, "rounds_": changes, "open_": F.coalesce(last.rlike(patterns.NAMED_VALUE), F.lit(False))}).drop("_k", *[f"_t{r}" for r in range(rounds + 1)])


def _laid(node, value, layer):
    """node after value of a layer is laid over it: an object as a dict of nodes with a member at least, anything else as (its JSON, its layer)."""
    if not isinstance(value, dict) or not (value or isinstance(node, dict)):
        return json.dumps(value, ensure_ascii=False, sort_keys=True), layer
    node = node if isinstance(node, dict) else {}
    for k, v in value.items():
        node[k] = _laid(node.get(k), v, layer)
    return node


def _leaves(node, path: tuple = ()) -> Iterator[tuple]:
    """(path, JSON, layer) of everything below a node."""
    if isinstance(node, dict):
        for k, v in node.items():
            yield from _leaves(v, (*path, k))
    elif node:
        yield "/".join(path), *node


def _object(text):
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return None
    return value if isinstance(value, dict) else None


def laid_over(layers: DataFrame, key: str, layer: str, text: str) -> DataFrame:
    """Settings (key, path, value, layer) of JSON objects laid over each other, higher layers over lower ones; a layer that is no JSON object is a row without value, its path empty.

    Objects are merged member by member; anything else replaces what lies at its
    place and below, and an object replaces what is none. An empty object is a
    setting where nothing lies below it. Equal layers follow by text.

    One shuffle by key and one sort: a task lays a key's layers over each other as
    they come, and holds that key's settings and one batch.
    """
    rows = layers.where(F.col(key).isNotNull() & F.col(layer).isNotNull()).select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"), F.col(layer).alias(layer))
    fields = rows.schema
    out = T.StructType([fields[0], T.StructField("path", T.StringType()), T.StructField("value", T.StringType()), fields[2]])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def ready():
            columns = list(zip(*found)) if found else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

        last, root, bad, begun = None, None, None, False
        for batch in batches:
            for k, t, n in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or (k != last and (k == k or last == last)):  # a key that isn't equal to itself is no number
                    found += [(last, *leaf) for leaf in _leaves(root)]
                    last, root, bad, begun = k, None, None, True
                value = _object(t)
                if value is not None:
                    root = _laid(root, value, n)
                elif bad is None or bad[0] != n:
                    bad = (n,)
                    found.append((k, "", None, n))
                if len(found) > 10_000:
                    yield ready()
                    found.clear()
        found += [(last, *leaf) for leaf in _leaves(root)]
        yield ready()

    parts = int(layers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, F.col(key)).sortWithinPartitions(F.col(key), F.col(layer), F.asc_nulls_first("_text")).mapInArrow(run, out)


def layered(layers: DataFrame, key: str, layer: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Settings as `laid_over` has them, and apart from them the layers that are no JSON object (key, layer)."""
    laid = laid_over(layers, key, layer, text)
    return laid.where("value IS NOT NULL"), laid.where("value IS NULL").select(key, layer)
