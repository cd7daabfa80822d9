"""BM25 top k with score bounds, for many questions at once.

A term's greatest possible part of a score is stored with the index. The rarest terms of a question give some documents and
with them a score that the k-th best reaches at least. Terms whose greatest parts together stay below it cannot bring a
document into the list by themselves: only the postings of the other, essential terms are scored, documents that could not
reach the threshold with all the rest are dropped, and what the other terms add is looked up for those that are left. The
rows are those of :func:`search.bm25`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .search import Index, top

SLACK = 2e-6  # scores are compared as they are rounded
SEEDS = 20  # documents of seeds for each one of the list, about


def part(qtf: Column, idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return qtf * idf * tf / (tf + k1 * (1 - b + b * dl / avgdl))


def weighed(held: Index, asked: DataFrame) -> DataFrame:
    """``asked`` (a question's key, ``term``, ``qtf``) with ``idf``, ``df``, ``most`` (the term's greatest part) and ``avgdl``."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(held.frequencies, "term").crossJoin(F.broadcast(held.stats)).withColumn("idf", idf)  # one row
    return known.withColumn("most", F.col("qtf") * F.col("idf") * F.col("top"))


def _scored(held: Index, terms: DataFrame, query_key: str, key: str) -> DataFrame:
    own = part(F.col("qtf"), F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return terms.join(held.postings, "term").groupBy(query_key, key).agg(F.sum(own).alias("part"), F.count(F.lit(1)).alias("postings"))


def _split(held: Index, asked: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """The weighed terms with ``threshold``, ``essential``, and ``rest``: what all terms that are not can add together."""
    terms = weighed(held, asked)
    before = F.sum("df").over(W.partitionBy(query_key).orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1))
    seeds = terms.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SEEDS * k)
    place = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("part"), key))
    reached = _scored(held, seeds, query_key, key).withColumn("place", place).where(F.col("place") == k).select(query_key, F.col("part").alias("threshold"))
    upto = F.sum("most").over(W.partitionBy(query_key).orderBy("most", "term").rowsBetween(W.unboundedPreceding, 0))
    told = terms.join(reached, query_key, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0))).withColumn("upto", upto)
    told = told.withColumn("essential", F.col("upto") >= F.col("threshold") - SLACK)
    return told.withColumn("rest", F.sum(F.when(~F.col("essential"), F.col("most")).otherwise(0.0)).over(W.partitionBy(query_key)))


def bm25(held: Index, asked: DataFrame, key: str, query_key: str, k: int, keep=None) -> tuple[DataFrame, DataFrame]:
    """Top ``k`` of each question of ``asked`` (:func:`search.asked_terms`): ``query_key``, ``key``, ``score``, ``rank``; and what was
    scored of it: ``query_key``, ``postings`` (of all its terms), ``scored`` (of the essential ones) and ``looked_up``."""
    store = keep or (lambda df, name: df)
    terms = store(_split(held, asked, query_key, key, k), "terms")
    limits = terms.select(query_key, "threshold", "rest").distinct()
    first = _scored(held, terms.where("essential"), query_key, key).join(limits, query_key)
    left = store(first.where(F.col("part") + F.col("rest") >= F.col("threshold") - SLACK).select(query_key, key, "part"), "left")
    others = terms.where("not essential")
    # what the other terms add, looked up by term and document
    pairs = left.select(query_key, key).join(others, query_key)
    own = part(F.col("qtf"), F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    more = store(pairs.join(held.postings, ["term", key]).groupBy(query_key, key).agg(F.sum(own).alias("more"), F.count(F.lit(1)).alias("n")), "more")
    whole = left.join(more, [query_key, key], "left").select(query_key, key, F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), 6).alias("score"))
    counts = terms.groupBy(query_key).agg(F.sum("df").alias("postings"), F.sum(F.when(F.col("essential"), F.col("df")).otherwise(0)).alias("scored"))
    looked = more.groupBy(query_key).agg(F.sum("n").alias("looked_up"))
    return top(whole.where("score > 0"), query_key, "score", key, k), counts.join(looked, query_key, "left").withColumn("looked_up", F.coalesce("looked_up", F.lit(0)))
