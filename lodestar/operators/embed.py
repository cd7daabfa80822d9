"""Text vectors without a model: hashed words and character n-grams, weighted by rarity, under a signed random projection.

A term is known by bits: those of digests of the word, and those of the least digest of its character trigrams, which two
terms share as often as they share trigrams. Each bit is the sign of one dimension. A text's vector is the sum of its
terms' signs, weighted by frequency in the text and rarity in the corpus, brought to length one; so texts that share rare
words, or words of like spelling, have a large cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import Index

WORD_LANES, LANE = 4, 64  # words take so many lanes of 64 dimensions, trigrams one
SIZE = LANE * (WORD_LANES + 1)
TRIGRAMS = 0.5  # weight of the trigrams' lane


def signature(term: Column) -> Column:
    digests = F.concat(*(F.md5(F.concat(F.lit(f"{i}:"), term).cast("binary")) for i in range(WORD_LANES // 2)))
    framed = F.concat(F.lit("#"), term, F.lit("#"))
    grams = F.transform(F.sequence(F.lit(1), F.length(term)), lambda i: F.md5(F.concat(F.lit("~"), F.substring(framed, i, F.lit(3))).cast("binary")))
    return F.unhex(F.concat(digests, F.substring(F.array_min(grams), 17, 16)))


def signatures(terms: DataFrame) -> DataFrame:
    """``term`` and ``signature``, a bit a dimension, of the distinct terms in ``terms``."""
    return terms.select("term", signature(F.col("term")).alias("signature"))


def weights(held: Index) -> DataFrame:
    """``term`` and ``rarity`` of the corpus's terms; ``unseen`` terms are as rare as can be."""
    return held.frequencies.crossJoin(F.broadcast(held.stats)).select("term", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("rarity"))  # one row


def vectors(postings: DataFrame, held: Index, key: str) -> DataFrame:
    """``key`` and ``embedding`` of the texts whose terms are ``postings`` (``key``, ``term``, ``tf``); rarity is the corpus's. A text
    without terms has no vector. Rows are shuffled once by text; a task holds some batches of them."""
    known = postings.select("term").distinct().join(weights(held), "term", "left").crossJoin(F.broadcast(held.stats.select("n")))  # one row
    signed = signatures(known.select("term")).join(known.select("term", F.coalesce("rarity", F.log(1 + F.col("n"))).alias("rarity")), "term")
    rows = postings.join(signed, "term").select(key, "signature", ((1 + F.log("tf")) * F.col("rarity")).alias("weight"))
    kind = dict(postings.dtypes)[key]

    def unit(names: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        flat = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0).ravel()
        return pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * SIZE, pa.int32()), pa.array(flat))], [key, "embedding"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rest = None, None  # the text that may go on in the next batch, and its sum so far
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                names = batch.column(key)
                signs = np.unpackbits(np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)
                scaled = (1.0 - 2.0 * signs) * batch.column("weight").to_numpy()[:, None]
                scaled[:, WORD_LANES * LANE :] *= TRIGRAMS
                own = names.to_pylist()
                first = [i for i in range(len(own)) if i == 0 or own[i] != own[i - 1]]
                sums = np.add.reduceat(scaled, first, axis=0)
                if last is not None and last.as_py() == own[0]:
                    sums[0] += rest
                elif last is not None:
                    yield unit(pa.array([last.as_py()], names.type), rest[None, :])
                last, rest = names[first[-1]], sums[-1]
                if len(first) > 1:
                    yield unit(names.take(pa.array(first[:-1])), sums[:-1])
        if last is not None:
            yield unit(pa.array([last.as_py()], last.type), rest[None, :])

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, f"{key} {kind}, embedding array<double>")


def asked_vectors(terms: DataFrame, held: Index, query_key: str) -> DataFrame:
    """Vectors of questions from their terms (see :func:`search.asked_terms`)."""
    return vectors(terms.withColumnRenamed("qtf", "tf"), held, query_key)
