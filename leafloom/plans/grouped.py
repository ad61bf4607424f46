"""Sequential work on small groups, streamed: no task holds more than one group and one batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def grouped(df: DataFrame, keys: list[str], order: list[str], work: Callable[[list[tuple]], list[tuple]], schema: T.StructType) -> DataFrame:
    """work on the rows of each group (tuples in df's column order, sorted by `order`).

    One shuffle by key and one sort; groups pass one after another, without a
    data frame for each, which for thousands of small groups is most of the cost.
    """
    n_keys = len(keys)
    rows = df.select(*keys, *[c for c in df.columns if c not in keys])
    names = rows.columns
    out_schema = to_arrow_schema(schema)
    place = [names.index(c) for c in df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ready(found):
            columns = list(zip(*found)) if found else [()] * len(out_schema)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

        held: list[tuple] = []
        found: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:n_keys] != held[-1][:n_keys]:
                    found += work([tuple(r[k] for k in place) for r in held])
                    held = []
                held.append(row)
            if len(found) > 10_000:
                yield ready(found)
                found = []
        if held:
            found += work([tuple(r[k] for k in place) for r in held])
        yield ready(found)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
