"""Work on all rows of a key in one Arrow task, with large keys dealt out as pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by it; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and last != k[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)


def together(rows: DataFrame, key: list[Column], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, payload: DataFrame | None = None, active: Column | None = None, whole: bool = True, block: int | None = None) -> DataFrame:
    """Run ``fn`` over the rows (``id``, ...) of each key. Of a key of over ``block`` (``BLOCK``) rows every two half blocks meet in
    one group; ``a`` and ``b`` are true for rows of the first and of the second, and both where a block meets itself.
    Where ``active`` is given, two rows of which neither is active need not meet: a block of such rows is dealt out to
    the blocks of active ones only. Where ``whole`` is false, a large key is only cut into blocks, so that each row is in
    one group and not all pairs meet. ``payload`` (``id``, ...) has the wide columns; they are joined once the narrow rows
    are dealt."""
    block = block or BLOCK
    asks = F.lit(True) if active is None else F.coalesce(active, F.lit(False))
    keyed = rows.withColumn("key", F.xxhash64(*key)).withColumn("__asks", asks)
    blocks = lambda n: F.ceil(n / (block / 2)).cast("int")
    asking = F.sum(F.col("__asks").cast("int"))
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("__n"), blocks(asking).alias("__p"), blocks(F.count(F.lit(1)) - asking).alias("__q")).where(F.col("__n") > block)
    spread = F.xxhash64(F.lit(3), "id")
    if not whole:
        n = F.count(F.lit(1))
        large = keyed.groupBy("key").agg(n.alias("__n"), F.ceil(n / block).cast("int").alias("__p")).where(F.col("__n") > block)
        part = F.coalesce(F.pmod(spread, F.col("__p")).cast("int"), F.lit(0))
        dealt = keyed.join(large, "key", "left").withColumn("key", F.xxhash64("key", part)).withColumns({"a": F.lit(True), "b": F.lit(True)}).drop("__n", "__p", "__asks")
        return _run(dealt, fn, schema, payload)
    own = F.when(F.col("__asks"), F.pmod(spread, F.col("__p"))).otherwise(F.col("__p") + F.pmod(spread, F.col("__q"))).cast("int")
    dealt = (
        keyed.join(large, "key", "left")
        .where("__p is null or __p > 0")
        .withColumn("parts", F.when(F.col("__p").isNull(), 1).when(F.col("__asks"), F.col("__p") + F.col("__q")).otherwise(F.col("__p")))
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("a", F.col("own") <= F.col("other"))
        .withColumn("b", F.col("own") >= F.col("other"))
        .withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
        .drop("__n", "__p", "__q", "__asks", "parts", "own", "other")
    )
    return _run(dealt, fn, schema, payload)


def _run(dealt: DataFrame, fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, payload: DataFrame | None) -> DataFrame:
    if payload is not None:
        dealt = dealt.join(payload, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for group in _groups(batches, "key"):
            if group.num_rows > 1 and (made := fn(group)) is not None and made.num_rows:
                out.append(made)
                n += made.num_rows
                if n > 20_000:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, n = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    partitions = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(run, schema)
