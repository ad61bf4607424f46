"""Sources and sinks: append-only JSON-lines logs, document listings, sidecar files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """A folder of JSON-lines files as (rows, errors).

    Rows carry file and line order (position in the file's read); a missing
    document_id becomes the file's stem. Blank lines are skipped; a line that
    isn't JSON of the schema is an error row with its file and text, not a failure.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    parsed = lines.where(F.trim("value") != "").withColumn("row", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    names = [x.strip().split()[0] for x in schema.split(",")]
    rows = parsed.where(~bad).select(*[F.coalesce("row.document_id", stem).alias(n) if n == "document_id" else F.col("row")[n].alias(n) for n in names], "file", "block", "line")
    return rows, parsed.where(bad).select("file", "line", F.col("value").alias("text"))


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines; files there are never rewritten."""
    rows.write.mode("append").json(path)


def slug(name):
    """Lower-case key with single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def list_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder as documents: slug, name, path, bytes, modified. Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return found.select(slug(name).alias("slug"), name.alias("name"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


NODES = "doc string, nid string, parent string, ord long, place int, depth int, kind string, level int, page int, text string, attrs map<string,string>, error string"


def flat(doc: str | None, tree: str | None) -> Iterator[tuple]:
    """Nodes of one document's JSON ({"body": [...]}, children under "children") in reading order, as NODES has them."""
    try:
        body = json.loads(tree)["body"] or []
        if not isinstance(body, list):
            raise TypeError("body is no list")
    except (TypeError, ValueError, KeyError, RecursionError) as wrong:
        yield (doc, *[None] * 10, f"{type(wrong).__name__}: {wrong}"[:200])
        return
    todo = [(node, None, "", k, 0) for k, node in reversed(list(enumerate(body)))]
    count = 0
    while todo:
        node, parent, above, place, depth = todo.pop()
        if not isinstance(node, dict):
            yield (doc, None, parent, count, place, depth, None, None, None, None, None, "a node is no object")
            count += 1
            continue
        path = f"{above}.{place}" if above else str(place)
        nid = str(node.get("nid") or f"@{path}")
        whole = {name: node[name] if isinstance(node.get(name), int) and -(2**31) <= node[name] < 2**31 else None for name in ("level", "page")}
        attrs = {k: v if isinstance(v, str) else json.dumps(v, sort_keys=True) for k, v in node.items() if k not in ("nid", "type", "text", "children", "level", "page") and v is not None}
        text, kind = node.get("text"), node.get("type")
        yield (doc, nid, parent, count, place, depth, kind if kind is None else str(kind), whole["level"], whole["page"], text if text is None else str(text), attrs, None)
        count += 1
        below = node.get("children")
        for k in range(len(below) - 1, -1, -1) if isinstance(below, list) else ():
            todo.append((below[k], nid, path, k, depth + 1))


def nodes(docs: DataFrame, doc: Column, tree: Column) -> tuple[DataFrame, DataFrame]:
    """A column of documents' JSON trees as (nodes, errors), one row a node: doc, nid, parent, ord, place, depth, kind, level, page, text, attrs.

    ord counts in reading order; a node without an id gets @ and its path of
    places; other keys go to attrs. A tree that can't be read, or has no body, is
    an error row (doc, error) and not a failure, as is a node that is no object.
    Trees are walked where their rows lie, without a shuffle, whatever their depth.
    """
    names = T.StructType.fromDDL(NODES)
    arrow = to_arrow_schema(names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def ready():
            columns = list(zip(*held)) if held else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                for row in flat(name, text):
                    held.append((*row[:10], None if row[10] is None else list(row[10].items()), row[11]))
                    if len(held) >= 10_000:
                        yield ready()
                        held.clear()
        yield ready()

    found = docs.select(doc.cast("string").alias("doc"), tree.alias("tree")).mapInArrow(walk, names)
    return found.where("error IS NULL").drop("error"), found.where("error IS NOT NULL").select("doc", "error")


def node_errors(found: DataFrame) -> DataFrame:
    """Ids that several nodes of a document share: doc, nid, n."""
    return found.groupBy("doc", "nid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def included(documents: DataFrame, sidecars: DataFrame, flag: str = "batch_excluded") -> DataFrame:
    """Documents (slug) without those whose sidecar (slug, value: JSON) excludes them; a sidecar that is missing or can't be read excludes nothing."""
    out = sidecars.where(F.try_variant_get(F.try_parse_json("value"), f"$.{flag}", "boolean")).select("slug").distinct()
    return documents.join(out, "slug", "left_anti")


def resolved(arguments: DataFrame, documents: DataFrame, argument: str = "argument") -> DataFrame:
    """arguments with slug: of the document whose slug, name or path it is, or whose path ends in it behind a slash (in this order, ties by slug); what nothing meets stays as it is.

    Each document offers its names and path endings, so this is an equality join.
    """
    parts = F.split("path", "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    offers = F.concat(
        F.array(*[F.struct(F.lit(rank).alias("rank"), F.col(c).alias("key")) for rank, c in enumerate(("slug", "name", "path"))]),
        F.transform(endings, lambda e: F.struct(F.lit(3).alias("rank"), e.alias("key"))),
    )
    keys = documents.select("slug", F.explode(offers).alias("o")).select("slug", "o.rank", F.col("o.key").alias("_key")).where("_key <> ''")
    best = keys.groupBy("_key").agg(F.min_by("slug", F.struct("rank", "slug")).alias("slug"))
    return arguments.join(best, arguments[argument] == best["_key"], "left").select(*[arguments[c] for c in arguments.columns], F.coalesce("slug", arguments[argument]).alias("slug"))
