"""What the operators share: tables, scratch space on shared storage, and text batches as numpy buffers.

Defined edge cases, for every operator: null text counts as empty unless the
operator says otherwise, an empty table gives an empty result with the full
schema, and columns other than those named are ignored or carried along
untouched (see each operator).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship
from ..plans.storage import new_folder, remove

#: Bytes of text that one numpy pass takes at a time; bounds a Python worker's memory.
PASS_BYTES = 2 << 20


#: Bytes of an Arrow batch, where the session allows more: long documents then can't add up to a worker's memory.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """What every operator needs of a session: the package on the executors, and bounded Arrow batches."""
    ship(spark)
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(BATCH_SETTING).lower()).groups()
    held = int(number) << (10 * " kmgtp".index(unit or " "))
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table made by `written` that nothing reads any more."""
    remove(df.sparkSession, df.scratch_path)


def wide_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, text: int, most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most` bytes of text each (a longer text stands alone)."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < n:
        before = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (nulls empty) and the n + 1 offsets into them."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def learn(doc_id: str = "doc_id"):
    """True for the rows a model may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 != 2


def held_out(doc_id: str = "doc_id"):
    """A null id has no remainder: it is not held out, and no model learns from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


#: crc32 of an ASCII text column, in SQL.
CRC32_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda s, k: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295)"
