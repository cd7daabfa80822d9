"""Substring search by trigrams: postings of a corpus's trigrams, candidates by a pattern's rarest ones, and verification.

A text that holds a pattern holds all of the pattern's trigrams, so the documents that the rarest of them share are all that
can match; their texts alone are read and looked through. A pattern of one or two letters begins a trigram wherever it
stands, as texts are closed by two marks, so it is looked up by the trigrams that begin with it. Letters are compared small,
and the caller's condition decides.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRAM = 3
RAREST = 8  # trigrams of a pattern that are looked up
END = "\x01\x01"


class GramIndex(NamedTuple):
    """``postings`` (``gram``, key) and ``frequencies`` (``gram``, ``df``) of a corpus."""

    postings: DataFrame
    frequencies: DataFrame


def _grams(text: Column) -> Column:
    """Distinct trigrams. Signs are taken from an array, so a long text costs time in proportion to its length."""
    signs = F.split(text, "")
    each = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - GRAM), lambda i: F.concat(*(F.get(s, i + k) for k in range(GRAM))))
    whole = F.get(F.transform(F.array(signs), each), F.lit(0))  # the signs are split once
    return F.when(F.length(text) >= GRAM, F.array_distinct(whole)).otherwise(F.array().cast("array<string>"))


def index(documents: DataFrame, key: str, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> GramIndex:
    """The index of ``documents`` (``key``, ``text``); ``keep(table, name)`` stores a table. Postings are stored in order of
    their grams, so a search reads few row groups, and dealt by ranges that also cut a gram which every text holds. A null text is in no posting."""
    store = keep or (lambda df, name: df)
    closed = F.concat(F.lower("text"), F.lit(END))
    postings = documents.where("text is not null").select(F.explode(_grams(closed)).alias("gram"), key)
    postings = store(postings.repartitionByRange("gram", F.xxhash64(key)).sortWithinPartitions("gram") if keep else postings, "grams")
    return GramIndex(postings, store(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "gram-frequencies"))


def candidates(held: GramIndex, patterns: DataFrame, pattern_key: str, pattern: str, key: str) -> DataFrame:
    """``pattern_key`` and ``key`` of every document that can hold the pattern. An empty or null pattern is held by none."""
    small = patterns.select(pattern_key, F.lower(pattern).alias("p")).where(F.length("p") > 0)
    own = small.where(F.length("p") >= GRAM).select(pattern_key, F.explode(_grams(F.col("p"))).alias("gram"))
    known = own.join(held.frequencies, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    place = F.row_number().over(W.partitionBy(pattern_key).orderBy("df", "gram"))
    rarest = known.withColumn("place", place).where(F.col("place") <= RAREST).select(pattern_key, "gram")
    long = rarest.join(rarest.groupBy(pattern_key).agg(F.count(F.lit(1)).alias("needed")), pattern_key).select(pattern_key, "gram", "needed")
    for n in range(1, GRAM):
        begins = held.frequencies.select("gram", F.left("gram", F.lit(n)).alias("p"))
        long = long.union(small.where(F.length("p") == n).join(begins, "p").select(pattern_key, "gram", F.lit(1).cast("long").alias("needed")))
    met = held.postings.join(long, "gram").groupBy(pattern_key, key).agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed"))
    return met.where("n >= needed").select(pattern_key, key)


def holding(held: GramIndex, documents: DataFrame, patterns: DataFrame, pattern_key: str, pattern: str, key: str, condition: Column) -> DataFrame:
    """Rows of ``documents`` beside the rows of ``patterns`` for which the condition holds, which must imply that the text, in
    small letters, holds the pattern."""
    pairs = candidates(held, patterns.select(pattern_key, pattern).distinct(), pattern_key, pattern, key)
    return pairs.join(patterns, pattern_key).join(documents, key).where(condition)
