"""Scratch space on storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where it names none (tests), a temporary one.

    On a cluster a temporary folder would be another one on each machine, so there the setting must be made.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafloom-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder of this application's own, not made yet."""
    return f"{top(spark)}/{what}-{uuid.uuid4().hex}"


def top(spark: SparkSession) -> str:
    return f"{scratch(spark)}/leafloom/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in scratch space, for a result that several branches of a plan read."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the scratch space; nothing that still reads from it may be used afterwards."""
    if not path.startswith(top(spark)):
        raise ValueError(f"{path} is not scratch space of this application")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; to be called when its results have been used."""
    remove(spark, top(spark))
