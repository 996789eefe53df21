"""Corpus pipeline over the documents table: five stages, each over all rows its predecessor kept.

Quality rules clean texts line by line and reject documents; toxicity rejects documents; of each class of
near-copies one document stays; secrets are masked; the rest is packed into token windows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk.llm import packing, quality, secret_scan, set_join, toxicity
from statewalk.llm.common import fresh, table
from statewalk.session import shared_dir

TOXIC = 0.3
PACK_END = 2
TOKENIZER = "word_bpe_49k.json"
#: Columns of documents that follow from the text.
LENGTH = "n_chars"


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the length of its texts brought up to date, where it has that column."""
    if LENGTH not in docs.columns:
        return docs
    kind = docs.schema[LENGTH].dataType
    return docs.withColumn(LENGTH, F.length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failing lines."""
    return _measured(quality.clean(docs))


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    into = fresh(docs, "_toxicity")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), into=into)
    return scored.where(F.col(into)["score"] < TOXIC).select(*[f"`{c}`" for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies: five-word shingles, similarity of 0.8 or more."""
    return set_join.keep_one(docs, join=set_join.SetJoin(5, 80))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret of their texts masked."""
    into = fresh(docs, "_secrets")
    out = secret_scan.redact(secret_scan.scan(docs, into=into), spans=into)
    return _measured(out.select(*[f"`{c}`" for c in docs.columns]))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), PACK_END)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", non_toxic),
    ("near duplicates", one_of_each),
    ("secrets", masked),
    ("packing", packed),
]

# Scores, ids of tokens and the packing have no SQL; each stage is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
