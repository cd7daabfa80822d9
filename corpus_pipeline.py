"""Documents to packed training sequences, in stages that are each written and read again.

Every stage works on all that its predecessor kept. Toxic documents, all but one of each group of near duplicates, and
documents that leak a test item go; personal numbers become pseudonyms; what is left is packed.

Defined results. A null or empty text has the machine's bias as its score, which is below the threshold unless toxic labels
are the rule; it has no near duplicates, leaks nothing, stays as it is, and is packed as its end token alone. Rows that repeat id and text stay or go together; of near duplicates the one with the smallest id, and of
equal ids the one with the smallest set's hash, stays; rows with a null id are no duplicates of one another. Texts are
taken whole in every stage, however long. All columns of the documents are carried up to the last stage, whatever their
names, which packs ``doc_id`` and ``text`` alone. No documents give no rows; no labels, no toxic documents; no test items, no
leaks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontaminate, minhash, packing, pseudonyms, scratch, toxicity
from lodestar.llm.queries import learnable


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.not_toxic(docs, toxicity.fit(docs, labels), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, shingle_words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(docs, key="lodestar")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pseudonyms", pseudonymise),
    ("packing", pack),
]
#: SQL can express neither the factorization machine nor greedy string tiling; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
