"""Connected components as repeated joins over saved tables; nothing of the graph passes through the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop
from .scratch import save as _save

EDGES_A_TASK = 200_000


def stars(edges: DataFrame) -> tuple[DataFrame, int]:
    """``a``, ``b``: every node that ``edges`` (``a``, ``b``) names, but the smallest of its component, with that
    smallest one; and the number of rounds.

    A round hangs first the larger neighbours of each node and then the smaller ones below the smallest of them, so whole
    subtrees move at once and the rounds grow with the logarithm of the longest path: on paths of any numbering at most
    ``2 * log2(n) + 3``. The number of edges never grows. A hub's edges meet only in joins, which adaptive execution can
    split, and in minima, which are combined before the shuffle.
    """
    down = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    held = _save(down.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n = held.count()
    parts = n // EDGES_A_TASK + 1
    save = lambda df, name: _save(df.coalesce(parts), name)  # noqa: E731  small graphs in few files
    rounds = 0
    while n:
        ends = held.select(F.col("a").alias("node"), F.col("b").alias("other")).union(held.select("b", "a"))
        low = save(ends.groupBy("node").agg(F.min("other").alias("low"), F.count(F.lit(1)).alias("n")).where("low < node"), "low")
        # stars: a node with a smaller neighbour has no other one
        if not low.where("n > 1").limit(1).count():
            drop(low)
            break
        rounds += 1
        large = save(held.join(low, F.col("b") == F.col("node"), "left").select("a", F.coalesce("low", "b").alias("b")), "large")
        least = save(large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")), "least")
        moved = large.join(least, F.col("a") == F.col("node")).where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = save(least.select(F.col("node").alias("a"), F.col("low").alias("b")).union(moved).distinct(), "edges")
        for old in (held, low, large, least):
            drop(old)
        held = after
    return held, rounds


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (its smallest reachable id) of each node that ``edges`` (``a``, ``b``) names. Edges with a
    null end or two equal ends are left out; no edges, no rows."""
    told, _ = stars(edges)
    return told.select(F.col("a").alias("id"), F.col("b").alias("component")).union(told.select("b", "b").distinct())
