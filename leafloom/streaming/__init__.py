"""Live logs by Structured Streaming: windowed counts, dedupe, latest per key.

Each function takes a streaming DataFrame and returns one; `drained` runs a query
over what there is and gives its result as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import new_folder


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files that a glob matches, event time in ts. (A path without a glob must be a folder.)"""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, key: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling windows by event time; what comes later than the watermark is dropped, and state with it."""
    found = stream.withWatermark("ts", late).groupBy(F.window("ts", every), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("window.start").alias("start"), key, "n")


def sessions(stream: DataFrame, key: str, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    found = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def deduplicated(stream: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def latest(stream: DataFrame, keys: list[str], line: str, values: list[str]) -> DataFrame:
    """The last row of each key so far; state holds one row per key."""
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("ts", line)).alias("r")).select(*keys, *[F.col("r")[v].alias(v) for v in values])


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs the query over all that is there, then stops. The result goes to the shared folder, batch by batch.

    In complete mode each batch replaces the one before; the last is the result.
    """
    spark = stream.sparkSession
    out = new_folder(spark, "stream")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data" if mode == "complete" else f"{out}/data/batch={n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{out}/data")
    return found.select(*stream.columns)
