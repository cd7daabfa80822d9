"""Approximate nearest neighbours by an inverted file: vectors stored by their nearest coarse centre, queries sent to few.

Centres come from k-means over a bounded sample; every vector is then indexed. The table is partitioned by cell, so a search
reads the folders of the cells that its queries probe, and no others. How many cells a query needs for a recall is measured
against exact search. Vectors of another length than the commonest are in a cell of their own, which is always searched
whole; with ``probes=None`` every cell is, which is exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.shared import keep, shared_dir

from .search import _best_of_pairs, _by_length, dense, packed, top

OTHERS = -1  # the cell of vectors of another length
SPREAD = 8  # tasks that write a cell, so that a hot one is no single task's


class VectorIndex(NamedTuple):
    path: str
    schema: str
    key: str
    size: int
    centres: np.ndarray  # a unit vector a row: ``cells`` of them at most

    def table(self, spark) -> DataFrame:
        """``key``, ``embedding`` and ``cell``, the partition."""
        return spark.read.schema(self.schema).parquet(self.path)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _assigned(vectors: DataFrame, key: str, vector: str, size: int, centres: np.ndarray, nearest: int, kind: str) -> DataFrame:
    """``key``, ``vector`` and ``cell``: a row for each of the ``nearest`` cells, the nearest first (``place`` from 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                for m, rows in _by_length(batch.column(vector)):
                    if m.shape[1] == size:
                        far = -(m @ centres.T)
                        cells = np.argsort(far, axis=1, kind="stable")[:, :nearest] if nearest > 1 else far.argmin(axis=1)[:, None]
                    else:
                        cells = np.full((len(rows), 1), OTHERS)
                    own = batch.take(pa.array(np.repeat(rows, cells.shape[1])))
                    place = np.tile(np.arange(1, cells.shape[1] + 1), len(rows))
                    yield pa.RecordBatch.from_arrays([own.column(key), own.column(vector), pa.array(cells.ravel().astype(np.int32)), pa.array(place.astype(np.int32))], [key, vector, "cell", "place"])

    return vectors.select(key, vector).mapInArrow(run, f"{key} {kind}, {vector} array<double>, cell int, place int")


def _centres(sample: DataFrame, key: str, kind: str, size: int, cells: int, rounds: int) -> np.ndarray:
    """K-means on unit vectors. A round assigns the sample to the centres and sums each cell by Spark; the driver gets
    ``cells`` x ``size`` sums."""
    first = sample.orderBy(F.xxhash64(F.lit(17), key), key).limit(cells).select("v").toArrow().column("v").combine_chunks()
    centres = np.concatenate([m for m, _ in _by_length(first)])
    for _ in range(rounds):
        told = _assigned(sample, key, "v", size, centres, 1, kind).select("cell", F.posexplode("v").alias("i", "x"))
        rows = told.groupBy("cell", "i").agg(F.sum("x").alias("x")).toArrow()
        sums = np.zeros_like(centres)
        sums[rows.column("cell").to_numpy(), rows.column("i").to_numpy()] = rows.column("x").to_numpy()
        after = _unit(sums)
        after[~after.any(axis=1)] = centres[~after.any(axis=1)]  # an empty cell keeps its centre
        if np.allclose(after, centres):
            break
        centres = after
    return centres


def build(vectors: DataFrame, key: str, vector: str = "embedding", cells: int = 64, sample: int = 65_536, rounds: int = 8, path: str | None = None) -> VectorIndex:
    """The stored index of ``vectors``. ``sample`` bounds the rows that the centres are fitted on, in order of a hash of the
    key; nulls, zeros and vectors with values that are null or not finite are in no cell. No vectors, no cells."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[key]
    double = vectors.select(key, F.col(vector).cast("array<double>").alias("v"))
    good = double.where(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)))
    common = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    size = common.d if common else 0
    some = good.where(F.size("v") == size)
    if common and common.n > sample:
        some = some.orderBy(F.xxhash64(F.lit(5), key), key).limit(sample)
    unit = some.withColumn("v", F.expr("transform(v, x -> x / sqrt(aggregate(v, 0D, (s, y) -> s + y * y)))"))
    centres = _centres(keep(unit, "sample"), key, kind, size, cells, rounds) if common else np.zeros((0, 0))
    path = path or f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    placed = _assigned(double, key, "v", size, centres, 1, kind).select(key, F.col("v").alias("embedding"), "cell")
    placed.repartition("cell", F.pmod(F.xxhash64(key), F.lit(SPREAD))).write.partitionBy("cell").parquet(path)
    return VectorIndex(path, f"{key} {kind}, embedding array<double>, cell int", key, size, centres)


def search(held: VectorIndex, queries: DataFrame, query_key: str, k: int, probes: int | None, vector: str = "embedding", block: int = 1024, not_own: bool = True) -> DataFrame:
    """Top ``k`` by cosine of each query among the vectors of its ``probes`` nearest cells, all cells if None. With all cells a query
    is sent once, not once a cell; otherwise a cell's vectors are dealt over its share of the shuffle partitions, and a query
    goes to these alone, so that what is sent does not grow with cells times partitions."""
    spark, kind = queries.sparkSession, dict(queries.dtypes)[query_key]
    if probes is None or probes >= len(held.centres):
        asked = queries.select(query_key, F.col(vector).cast("array<double>").alias("embedding"))
        return dense(held.table(spark).select(held.key, "embedding"), asked, held.key, query_key, k, block=block, not_own=not_own)
    asked = _assigned(queries.select(query_key, F.col(vector).cast("array<double>").alias("v")), query_key, "v", held.size, held.centres, max(1, probes), kind)
    wanted = [r.cell for r in asked.select("cell").distinct().collect()]  # cells + 1 rows at most
    rows = held.table(spark).where(F.col("cell").isin(wanted)) if wanted else held.table(spark).where("false")
    parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(held.centres)))
    own = packed(rows, held.key, "embedding", 4 * block, "cell").withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
    near = packed(asked.repartition("cell"), query_key, "v", block, "cell").select("size", "cell", F.col("ids").alias("asked"), F.col("matrix").alias("asking"), F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"))
    kinds = dict(rows.dtypes)[held.key], kind
    return top(_best_of_pairs(own.join(near, ["size", "cell", "part"]), held.key, query_key, *kinds, k, not_own), query_key, "score", held.key, k)


def recalls(held: VectorIndex, exact: DataFrame, queries: DataFrame, query_key: str, vector: str = "embedding") -> DataFrame:
    """``probes`` and ``recall``: the share of the ``exact`` neighbours (``query_key``, key) that lie in the nearest ``probes`` cells
    of their query, for every number of cells. One pass: no search is repeated."""
    kind = dict(queries.dtypes)[query_key]
    asked = _assigned(queries.select(query_key, F.col(vector).cast("array<double>").alias("v")), query_key, "v", held.size, held.centres, max(1, len(held.centres)), kind).select(query_key, "cell", "place")
    found = exact.select(query_key, held.key).join(held.table(queries.sparkSession).select(held.key, "cell"), held.key).join(asked, [query_key, "cell"])
    counts = found.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    every = queries.sparkSession.range(1, max(1, len(held.centres)) + 1).select(F.col("id").alias("probes"))
    total = exact.agg(F.count(F.lit(1)).alias("total"))
    upto = every.join(counts, F.col("place") <= F.col("probes"), "left").groupBy("probes").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))  # cells x cells rows at most
    return upto.crossJoin(F.broadcast(total)).select("probes", F.try_divide("n", "total").alias("recall"))  # one row


def probes_for(held: VectorIndex, exact: DataFrame, queries: DataFrame, query_key: str, recall: float, vector: str = "embedding") -> int:
    """Fewest cells with which the recall is reached."""
    enough = recalls(held, exact, queries, query_key, vector).where(F.col("recall") >= recall).agg(F.min("probes").alias("p")).first().p
    return int(enough or max(1, len(held.centres)))
