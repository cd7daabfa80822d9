"""Entity search and retrieval: full-text scores, BM25, exact vector search, fusion, rerank order and traces."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.text import contains_any, raw_tokens, tokens


@dataclass
class SearchPlan:
    """What a request asks for; an empty part does not restrict."""

    sectors: list[str] = field(default_factory=list)
    stages: list[str] = field(default_factory=list)
    places: list[str] = field(default_factory=list)
    size_min: int | None = None
    size_max: int | None = None
    keywords: list[str] = field(default_factory=list)
    priorities: list[str] = field(default_factory=list)
    wants_ai: bool = False
    limit: int = 5
    strategy: str = ""

    def discriminates(self) -> bool:
        return bool(self.sectors or self.stages or self.places or self.keywords) or self.size_min is not None or self.size_max is not None


def like_any(column: Column, values: list[str]) -> Column:
    """Literal, case-insensitive containment of any value; true without values."""
    return contains_any(F.lower(column), [v.lower() for v in values]) if values else F.lit(True)


def between(column: Column, low: float | None, high: float | None) -> Column:
    """A bound that is None does not restrict; a null value fails a bound that is there."""
    out = F.lit(True)
    if low is not None:
        out = out & (column >= low)
    if high is not None:
        out = out & (column <= high)
    return out


def document_scores(documents: DataFrame, terms: list[str], entity: str, text: str = "text") -> DataFrame:
    """``score`` 0.1 for each occurrence of a term, of documents with one; without terms, all match with 0."""
    if not terms:
        return documents.select(entity, F.lit(0.0).alias("score"))
    wanted = F.array(*(F.lit(t) for t in dict.fromkeys(terms)))
    hits = F.size(F.filter(raw_tokens(F.col(text)), lambda t: F.array_contains(wanted, t)))
    return documents.select(entity, hits.alias("hits")).where("hits > 0").select(entity, (F.col("hits") * 0.1).alias("score"))


def search_entities(entities: DataFrame, documents: DataFrame, terms: list[str], entity: str, limit: int, where: Column | None = None) -> DataFrame:
    """Best entities by their best document: ``entity``, ``score``, ``matched``; by score, then name. Only narrow columns
    are ranked; join the wide ones to the result."""
    kept = entities if where is None else entities.where(where)
    return ranked_entities(kept, document_scores(documents, terms, entity), entity, limit, with_terms=bool(terms))


def ranked_entities(entities: DataFrame, hits: DataFrame, entity: str, limit: int, with_terms: bool) -> DataFrame:
    """Entities by the best ``score`` of their rows in ``hits``; without terms, all of them with a score of 0."""
    scored = hits.groupBy(entity).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("matched"))
    joined = entities.join(scored, entity, "inner" if with_terms else "left")
    matched = F.coalesce("matched", F.lit(0)) if with_terms else F.lit(0)
    ranked = joined.select(entity, F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), matched.cast("long").alias("matched"))
    return ranked.orderBy(F.desc("score"), entity).limit(limit)


class Index(NamedTuple):
    """What BM25 needs of a corpus: ``postings`` (``term``, key, ``tf``, ``dl``), ``frequencies`` (``term``, ``df``, ``top``) and
    ``stats`` (one row: ``n``, ``avgdl``)."""

    postings: DataFrame
    frequencies: DataFrame
    stats: DataFrame


def index(documents: DataFrame, key: str, stopwords: tuple[str, ...] = (), keep: Callable[[DataFrame, str], DataFrame] | None = None, stem: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """The index of ``documents`` (``key``, ``text``). ``keep(table, name)`` stores a table and reads it back, so that the
    corpus is tokenized once; postings are stored in order of their terms, so a search reads few row groups. ``stem`` (``term``
    to ``term``, ``stem``) sees each distinct term once; postings are then those of stems, and so must be a query's terms."""
    store = keep or (lambda df, name: df)
    own = store(documents.select(key, tokens(F.col("text"), stopwords).alias("tokens")), "tokens")
    stats = own.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens").cast("long")).alias("avgdl"))
    each = own.select(key, F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    postings = each.groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))
    if stem:
        plain = store(postings, "plain-postings")
        of = store(stem(plain.select("term").distinct()), "stems")
        postings = plain.join(of, "term").groupBy(F.col("stem").alias("term"), key, "dl").agg(F.sum("tf").alias("tf"))
    postings = store(postings.sortWithinPartitions("term") if keep else postings, "postings")
    stats = store(stats, "stats")
    share = F.col("tf") / (F.col("tf") + 1.2 * (1 - 0.75 + 0.75 * F.col("dl") / F.col("avgdl")))  # of a score at the usual parameters
    counted = postings.crossJoin(F.broadcast(stats)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(share).alias("top"))  # one row
    return Index(postings, store(counted, "frequencies"), stats)


def asked_terms(queries: DataFrame, query_key: str, stopwords: tuple[str, ...] = (), stem: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``query_key``, ``term`` and ``qtf`` of the tokens of ``text``."""
    each = queries.select(query_key, F.explode(tokens(F.col("text"), stopwords)).alias("term"))
    if stem:
        each = each.join(stem(each.select("term").distinct()), "term").select(query_key, F.col("stem").alias("term"))
    return each.groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("qtf"))


def document_hits(held: Index, terms: DataFrame, key: str) -> DataFrame:
    """``key`` and ``score``, 0.1 for each occurrence of a term (``term``), of documents with one; from postings alone."""
    return held.postings.join(terms.select("term").distinct(), "term").groupBy(key).agg(F.round(F.sum("tf") * 0.1, 6).alias("score"))


def bm25(
    corpus: DataFrame | Index, queries: DataFrame, key: str, query_key: str, k: int, stopwords: tuple[str, ...] = (), k1: float = 1.2, b: float = 0.75, stem: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Top ``k`` documents of each query: ``query_key``, ``key``, ``score``, ``rank``. A repeated query token counts again;
    scores of zero are left out; a query without tokens has no rows. Only postings of the queries' terms are shuffled."""
    held = corpus if isinstance(corpus, Index) else index(corpus, key, stopwords, stem=stem)
    asked = asked_terms(queries, query_key, stopwords, stem)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("qtf") * F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighed = asked.join(held.frequencies, "term").crossJoin(F.broadcast(held.stats)).withColumn("idf", idf)  # one row
    scored = weighed.join(held.postings, "term").groupBy(query_key, key).agg(F.round(F.sum(weight), 6).alias("score")).where("score > 0")
    return top(scored, query_key, "score", key, k)


def top(scored: DataFrame, partition: str, score: str, tie: str, k: int) -> DataFrame:
    """The best ``k`` rows of each partition with their 1-based ``rank``."""
    order = W.partitionBy(partition).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length that occurs, the rows of that length brought to length one in double precision, and where they stand.
    Left out are nulls, zeros, and vectors with a value that is null or not finite."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        m = pc.list_flatten(vectors.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        good = np.isfinite(norm[:, 0]) & (norm[:, 0] > 0)
        yield m[good] / norm[good], at[good]


def packed(vectors: DataFrame, key: str, vector: str, rows: int, *carried: str) -> DataFrame:
    """Vectors in blocks of at most ``rows`` of one length: ``size``, ``ids``, ``matrix`` (bytes of doubles, a vector a row) and
    the columns that are ``carried`` along, which must be equal within a partition's batch: blocks don't mix their values."""
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in carried]
            groups: dict[tuple, list[int]] = {}
            for i, own in enumerate(zip(*keys, strict=True) if carried else [()] * batch.num_rows):
                groups.setdefault(own, []).append(i)
            for own, places in groups.items():
                part = batch.take(pa.array(places)) if carried else batch
                for at in range(0, part.num_rows, rows):
                    some = part.slice(at, rows)
                    for m, found in _by_length(some.column(vector)):
                        if len(found):
                            ids = some.column(key).take(pa.array(found))
                            columns = [pa.array([m.shape[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([m.tobytes()])]
                            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).take(pa.array(places[:1])) for c in carried)], ["size", "ids", "matrix", *carried])

    schema = f"size int, ids array<{kinds[key]}>, matrix binary" + "".join(f", {c} {kinds[c]}" for c in carried)
    return vectors.select(key, vector, *carried).mapInArrow(run, schema)


def _best_of_pairs(pairs: DataFrame, key: str, query_key: str, key_kind: str, query_kind: str, k: int, not_own: bool) -> DataFrame:
    """The best ``k`` of each block of vectors for each query of a block: rows of ``ids``, ``matrix``, ``asked``, ``asking``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size, ids, names = batch.column("size")[i].as_py(), batch.column("ids")[i].values, batch.column("asked")[i].values
                own, asked = ids.to_numpy(zero_copy_only=False), names.to_numpy(zero_copy_only=False)
                m, q = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(-1, size) for c in ("matrix", "asking"))
                scores = np.round(q @ m.T, 6)
                if not_own:
                    scores[asked[:, None] == own[None, :]] = -2
                found = [np.lexsort((own, -line))[:k] for line in scores]
                at = np.repeat(np.arange(len(q)), [len(f) for f in found])
                best = np.concatenate(found) if found else np.zeros(0, np.int64)
                value = scores[at, best]
                at, best, value = at[value > -2], best[value > -2], value[value > -2]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), ids.take(pa.array(best)), pa.array(value)], [query_key, key, "score"])

    return pairs.select("size", "ids", "matrix", "asked", "asking").mapInArrow(run, f"{query_key} {query_kind}, {key} {key_kind}, score double")


def dense(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, k: int, vector: str = "embedding", block: int = 1024, not_own: bool = True) -> DataFrame:
    """Exact top ``k`` by cosine of each query against all rows of its length, but the one of its own id if ``not_own``. Both sides are
    packed into blocks, and every block of a stated query set meets every block of vectors; a pair keeps its ``k`` best, so few
    rows are shuffled. Nothing passes the driver but what the planner chooses to broadcast by its size; otherwise the blocks
    of vectors are dealt over as many parts as there are shuffle partitions, and the queries' blocks to each of them."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = packed(vectors, key, vector, 4 * block).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
    asked = packed(queries, query_key, vector, block).select("size", F.col("ids").alias("asked"), F.col("matrix").alias("asking"), F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"))
    kinds = dict(vectors.dtypes)[key], dict(queries.dtypes)[query_key]
    return top(_best_of_pairs(held.join(asked, ["size", "part"]), key, query_key, *kinds, k, not_own), query_key, "score", key, k)


def fuse_rrf(arms: list[tuple[DataFrame, float]], key: str, query_key: str, k: int) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank); an absent arm adds nothing. Ties go to the arm that comes
    first, then to the better rank in it."""
    return _fuse([(a.withColumn("part", F.lit(w) / (F.lit(float(k)) + F.col("rank"))), w) for a, w in arms], key, query_key)


def fuse_scores(arms: list[tuple[DataFrame, float]], key: str, query_key: str, how: str) -> DataFrame:
    """Weighted sum of scores brought to one scale within each list: ``minmax`` (a range of zero gives 0.5) or ``sum``."""
    w = W.partitionBy(query_key)
    if how == "minmax":
        low, high = F.min("score").over(w), F.max("score").over(w)
        scaled = F.when(high - low < 1e-12, 0.5).otherwise((F.col("score") - low) / (high - low))
    else:
        total = F.sum("score").over(w)
        scaled = F.when(total == 0, 0.0).otherwise(F.col("score") / total)
    return _fuse([(a.withColumn("part", F.lit(weight) * scaled), weight) for a, weight in arms], key, query_key)


def _fuse(arms: list[tuple[DataFrame, float]], key: str, query_key: str) -> DataFrame:
    rows = None
    for i, (arm, _) in enumerate(arms):
        own = arm.select(query_key, key, "part", F.struct(F.lit(i).alias("arm"), "rank").alias("seen"), "score", F.lit(i).alias("arm"))
        rows = own if rows is None else rows.unionByName(own)
    each = [F.max(F.when(F.col("arm") == i, F.col("score"))).alias(f"score_{i}") for i in range(len(arms))]
    fused = rows.groupBy(query_key, key).agg(F.round(F.sum("part"), 6).alias("fused"), F.min("seen").alias("seen"), *each)
    order = W.partitionBy(query_key).orderBy(F.desc("fused"), "seen")
    return fused.withColumn("position", F.row_number().over(order)).drop("seen")


def overlap(pairs: DataFrame, key: str, query_key: str) -> DataFrame:
    """A stand-in for a rerank model: the share of a question's distinct tokens that the text has. ``pairs``: ``question``, ``text``."""
    asked = F.array_distinct(tokens(F.col("question")))
    share = F.try_divide(F.size(F.array_intersect(asked, tokens(F.col("text")))).cast("double"), F.size(asked))
    return pairs.select(query_key, key, F.round(F.coalesce(share, F.lit(0.0)), 6).alias("rerank_score"))


def rerank(fused: DataFrame, key: str, query_key: str, scores: DataFrame | None, k: int) -> DataFrame:
    """The whole union in the order of ``scores`` (``query_key``, ``key``, ``rerank_score``), then cut to ``k``; ties keep
    the fused order. Without scores the fused order stays and ``rerank_score`` is null."""
    joined = fused.withColumn("rerank_score", F.lit(None).cast("double")) if scores is None else fused.join(scores, [query_key, key], "left")
    order = W.partitionBy(query_key).orderBy(F.desc_nulls_last("rerank_score"), "position")
    return joined.withColumn("final_position", F.row_number().over(order)).where(F.col("final_position") <= k)
