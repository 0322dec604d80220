"""A training corpus from ``documents``: no toxic texts, no copies, no near copies, mixed to target weights, in tokens.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of ``documents``; the last returns tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bpe, exact_dedup, minhash, mixing, toxicity
from marlstone.llm.common import cut, learns
from marlstone.llm.queries import VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model, trained on the labelled ones of two crc32 thirds, scores below .7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(learns("doc_id", 3, 1)))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at .8 or more, the document with the least id."""
    return minhash.drop_near_copies(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, sampled so that the expected ones have the target shares of source, language and topic as far as the documents suffice."""
    return mixing.sample(docs, share=mixing.SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to."""
    return bpe.encode_texts(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("encode", encode),
]

#: SQL can express neither the trained model nor the encoding; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
