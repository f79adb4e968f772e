"""The corpus pipeline: five stages, each one of the operators, each on all that the one before kept.

Defined results: a null or empty text has no letter, so language ID takes its
document out; texts of any length pass whole. Rows that repeat others are
documents of their own until near-dedup: of different ids the least stays, rows
that share that id all stay, as do rows without an id. Of ties, the line stage
keeps the line in the largest id and the near-dedup stage the least id. Null
``lang`` or ``source`` change nothing; further columns of the table travel along
as they are, whatever their names, up to the last stage, which returns pieces. An
empty table gives an empty table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import language_id, line_dedup, packing, simhash, suffix_dedup
from kinfold.llm._shared import written

#: A document whose words, by mean probability, belong to no language this likely is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter or without a likely language go."""
    found = language_id.identify(docs, keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def _recounted(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents again, with ``n_chars`` of the text as it is now."""
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(line_dedup.dedup_lines(docs), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup_near(docs)


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(suffix_dedup.dedup_substrings(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_substrings),
    ("best-fit packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
