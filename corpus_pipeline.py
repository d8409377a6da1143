"""Corpus pipeline: from raw documents to packed training sequences.

Stages hand on what they keep.  All but the last return the columns of documents:

1. language: documents without a recognisable language go;
2. near_duplicates: of every group of documents linked at Jaccard 0.8 on five-word n-grams one stays;
3. decontamination: documents that hold a passage of the benchmark go;
4. secrets: secrets are replaced by a mark, n_chars follows;
5. packing: token pieces with their places in sequences of 1024 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ndlattice.llm import decontamination, language_id, ngram_join, packing, secrets
from ndlattice.llm.common import settled, table


#: Rows and bytes in one Arrow batch: whole texts can be long, and a batch of them lies in memory on both sides.
BATCH_ROWS, BATCH_BYTES = 2000, 4_000_000


def _narrow(spark: SparkSession) -> None:
    """Keep Arrow batches of this session to BATCH_ROWS rows and about BATCH_BYTES bytes at most; a text goes whole into one."""
    in_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most, number in (("maxRecordsPerBatch", BATCH_ROWS, int), ("maxBytesPerBatch", BATCH_BYTES, in_bytes)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _narrow(spark)
    return language_id.keep_identified(docs, language_id.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _narrow(spark)
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _narrow(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _narrow(spark)
    return secrets.redact(docs, secrets.train())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _narrow(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack),
]
#: Stages 1, 2, 4 and 5 have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage keeps is written once, to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
