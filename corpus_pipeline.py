"""A training corpus out of documents: five stages, each a table that the next one reads.

Quality, line dedup, near-duplicates, benchmark leaks, packing. No SQL expresses the first, third and fifth stage, so
ORACLE_SQL is None; tests/llm/test_pipeline.py holds every stage against a plain version of itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.llm.common import cut
from lodemark.llm.decontamination import drop_leaks
from lodemark.llm.linededup import dedup_lines
from lodemark.llm.packing import pack, vocabulary, with_digests
from lodemark.llm.quality import keep_good
from lodemark.llm.simhash import keep_one

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained scorer keeps."""
    return keep_good(docs).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that came before go, n_chars follows the text, and documents of which nothing is left go."""
    kept = dedup_lines(docs).where("n_dropped < n_lines or n_dropped = 0")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return keep_one(docs).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token ids of all documents left, in sequences of 1024."""
    return with_digests(pack(docs, vocabulary()))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
