"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Null ids, null and empty texts, repeated rows and empty
tables are as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import language_id, line_dedup, packing, simhash, substring_dedup
from leafloom.llm.common import learn, prepare, written

#: A document whose average word gives its best language less than this share of the likelihood is rejected, as is one without letters.
LEAST_SHARE = 0.4


def _as_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return docs.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = language_id.fit(docs.where(learn()))
    found = language_id.predict(docs, model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _as_documents(line_dedup.without_boilerplate(docs), docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in at least 0.8 of their five-word shingles the smallest id stays; rows that repeat an id share its fate, rows without one stay.

    Pairs come from BK-trees over SimHash fingerprints of those shingles; what the trees find is checked, near the threshold by the shingles themselves.
    """
    prepare(spark)
    gone = written(simhash.similar_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")), "near-copies")
    return docs.join(gone, docs.doc_id == gone.gone, "left_anti")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _as_documents(substring_dedup.deduplicated(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.packed_documents(docs, packing.vocabulary())


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_boilerplate_lines),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("packing", pack),
]

#: Tokens, language models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
