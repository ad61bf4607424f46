"""Document fingerprints (5): quartile bucket digests.

Every three consecutive bytes of a text's UTF-8 form are hashed to one of
`BUCKETS` buckets and counted. A bucket is coded by the quartile of its
document's counts that it falls in (2 bits), and the digest is the length, on a
logarithmic scale, followed by the codes. Two digests are compared by the sum of
their codes' differences and of their lengths', bounded by `BOUND`; likeness is
1 less the bounded difference over the bound. Equal texts have equal digests.

Texts under three bytes count no triplet and differ by length alone. Null text
counts as empty. The next document follows by ascending id (nulls first; rows
that repeat an id by the hash of their text, then the text), the first follows
the last, and a document alone follows itself. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, wide_shuffle

BUCKETS = 256
#: Differences at or above this are all the same to the likeness.
BOUND = 320
#: A step of the length code is a tenth more bytes; each step apart costs this much, up to the cap.
LENGTH_COST = 2
LENGTH_CAP = 64


def digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length codes (n) and quartile codes (n x BUCKETS) of a batch."""
    n, size = len(offsets) - 1, np.diff(offsets)
    counts = np.zeros((n, BUCKETS), np.int64)
    if len(data) >= 3:
        v = data[:-2].astype(np.uint32) | (data[1:-1].astype(np.uint32) << np.uint32(8)) | (data[2:].astype(np.uint32) << np.uint32(16))
        bucket = (v * np.uint32(0x9E3779B1)) >> np.uint32(24)
        doc = np.repeat(np.arange(n, dtype=np.int32), size)[: len(bucket)]
        whole = np.repeat(offsets[1:], size)[: len(bucket)] - np.arange(len(bucket)) >= 3
        key = doc[whole].astype(np.int64) * BUCKETS + bucket[whole]
        counts = np.bincount(key, minlength=n * BUCKETS).reshape(n, BUCKETS)
    ranked = np.sort(counts, axis=1)
    quarter = BUCKETS // 4
    codes = sum((counts > ranked[:, k * quarter - 1 : k * quarter]).astype(np.uint8) for k in (1, 2, 3))
    length = np.minimum(255, np.floor(np.log(size + 1) / np.log(1.1))).astype(np.uint8)
    return length, codes


def text_of(length: np.ndarray, codes: np.ndarray) -> list[str]:
    four = codes.reshape(len(codes), -1, 4)
    packed = (four[:, :, 0] << 6) | (four[:, :, 1] << 4) | (four[:, :, 2] << 2) | four[:, :, 3]
    rows = np.hstack([length[:, None], packed]).astype(np.uint8)
    return [r.tobytes().hex() for r in rows]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, 0 to 1."""
    apart = np.abs(a[1].astype(np.int16) - b[1].astype(np.int16)).sum(axis=1)
    longer = np.abs(a[0].astype(np.int16) - b[0].astype(np.int16))
    return 1 - np.minimum(BOUND, apart + np.minimum(LENGTH_CAP, LENGTH_COST * longer)) / BOUND


def digest_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
    return digests(np.frombuffer(b"".join(texts), np.uint8), offsets)


def fingerprint(text: str | None) -> str:
    return text_of(*digest_texts([(text or "").encode()]))[0]


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by the following text's beginning."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; the last row of a partition (ghost) is only the follower of the one before."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    waiting: tuple[int | None, str] | None = None
    ended = False
    for whole in batches:
        for batch in slices(whole, 1):
            ids, texts, ghosts = (batch.column(k).to_pylist() for k in range(3))
            rows = [] if waiting is None else [waiting]
            for i, t, g in zip(ids, texts, ghosts):
                if not ended:
                    rows.append((i, t or ""))
                    ended = bool(g)
            if len(rows) > 1:
                own = [t for _, t in rows[:-1]]
                changed = [edited(t, u).encode() for t, (_, u) in zip(own, rows[1:])]
                plain = digest_texts([t.encode() for _, t in rows])
                new = digest_texts(changed)
                a, b = tuple(x[:-1] for x in plain), tuple(x[1:] for x in plain)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in rows[:-1]], pa.int64()),
                        pa.array([len(t) for t in own], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in changed], pa.string()),
                        pa.array(text_of(*a), pa.string()),
                        pa.array(text_of(*new), pa.string()),
                        pa.array(likeness(a, new)),
                        pa.array(likeness(a, b)),
                    ],
                    names=names,
                )
            waiting = rows[-1]


def range_of(cuts: np.ndarray):
    """The range of an id, by binary search, so that the number of ranges costs next to nothing. cuts: ascending first ids of the ranges but the first."""

    @F.pandas_udf("int")
    def range_(i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, i.to_numpy(np.int64), "right").astype(np.int32))

    return range_


def places_of(cuts: np.ndarray, heads: np.ndarray, before: np.ndarray):
    """Where a row goes: `own`, its range, and as its range's first row (head) also `back`, the range before, else -1. Rows without an id are in the first range and may be its first row."""

    @F.pandas_udf("own int, back int")
    def places(i: pd.Series, null: pd.Series) -> pd.DataFrame:
        ids, null = i.to_numpy(np.int64), null.to_numpy(bool)
        own = np.where(null, 0, np.searchsorted(cuts, ids, "right"))
        return pd.DataFrame({"own": own.astype(np.int32), "back": np.where(null | (ids == heads[own]), before[own], -1).astype(np.int32)})

    return places


def with_followers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs dealt by ranges of ids in order, each range with the next one's first row behind it (ghost 1).

    The driver sees one id for each partition and no more. Text is shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    parts = wide_shuffle(spark)
    least, nulls = rows.agg(F.min("i"), F.count_if(F.col("i").isNull())).first()
    quantiles = rows.select("i").approxQuantile("i", [k / parts for k in range(1, parts)], 1 / (20 * parts)) if least is not None and parts > 1 else []
    # quantiles come as doubles; the ids themselves may need more digits, so the first id at or after each is taken
    cuts = np.array(sorted({int(c) for c in quantiles if int(c) > least}), np.int64)
    bucket = range_of(cuts)
    held = {r["b"]: r["i"] for r in rows.where("i IS NOT NULL").groupBy(bucket("i").alias("b")).agg(F.min("i").alias("i")).collect()}
    used = sorted(set(held) | ({0} if nulls else set()))
    heads, before = np.full(len(cuts) + 1, np.iinfo(np.int64).min), np.zeros(len(cuts) + 1, np.int64)
    for k, b in enumerate(used):
        before[b] = used[k - 1]
        heads[b] = held.get(b, heads[b])
    if nulls:  # rows without an id come first of all
        heads[0] = np.iinfo(np.int64).min
    at = rows.withColumn("at", places_of(cuts, heads, before)(F.coalesce("i", F.lit(0)), F.col("i").isNull()))  # nulls among numbers would make them doubles
    place = lambda to, ghost: F.struct(F.col(to).alias("to"), F.lit(ghost).alias("ghost"))
    both = F.when(F.col("at.back") >= 0, F.array(place("at.own", 0), place("at.back", 1))).otherwise(F.array(place("at.own", 0)))
    dealt = at.select("i", "t", F.explode(both).alias("p")).select("i", "t", "p.ghost", "p.to", F.xxhash64("t").alias("h"))
    return dealt.repartitionById(parts, F.col("to")).sortWithinPartitions("ghost", F.asc_nulls_first("i"), "h", F.asc_nulls_first("t")).select("i", "t", "ghost")


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return with_followers(docs, doc_id, text).mapInArrow(_pairs, SCHEMA)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
