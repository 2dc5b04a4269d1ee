"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing, in this order.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
``documents``; the result of each is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evidara.llm import exact_dedup, mixing, packing, simhash, toxicity
from evidara.llm.queries import vocabulary_path
from evidara.session import scratch_folder, table

#: Packing and the learnt classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels`` on these documents, predicts to be toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return simhash.drop_near_duplicates(docs, similarity=0.8, shingle_words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; a source's last document is cut to the words still missing."""
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 2048, a row for each piece."""
    return packing.pack(docs, vocabulary_path(), added=packing.added_tokens(vocabulary_path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents lie as Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
