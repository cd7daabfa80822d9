"""Buckets of classes that share a band, and exact links between them without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import together
from .scratch import save


def shared_buckets(rows: DataFrame) -> DataFrame:
    """``band``, ``id`` and ``leader`` (the bucket's smallest id), from ``band``, ``id``, of bands that two ids or more share."""
    shared = save(rows.groupBy("band").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").select("band", "leader"), "bands")
    return rows.join(shared, "band").distinct()


def star_pairs(buckets: DataFrame) -> DataFrame:
    """``a``, ``b``: every id with the smallest of its buckets' leaders; one pair an id at most."""
    return buckets.groupBy(F.col("id").alias("b")).agg(F.min("leader").alias("a")).where("a < b").select("a", "b")


def open_rows(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """``band``, ``id``, ``component``, ``main`` and ``outside`` of the buckets that hold several components; ``main`` is
    the bucket's largest one, and ``outside`` says that a row is not of it. Two rows of which neither is outside are of one component."""
    placed = save(buckets.select("band", "id").join(found, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component")), "placed")
    sizes = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("band", "main")
    return placed.join(save(mixed, "bands"), "band").select("band", "id", "component", "main", (F.col("component") != F.col("main")).alias("outside"))


def sized(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets' sizes (``id``, ``n``) allow the similarity."""
    a, b = (sizes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")


def exact_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with ``100 * intersection >= percent * union``; ``sets``: ``id``, ``shingles`` without repeats."""
    a, b = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", (F.size("sa") + F.size("sb")).alias("sum"), both.alias("both"))
    return joined.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def exact_links(rows: DataFrame, sets: DataFrame, key: list[Column], percent: int, kind: str) -> DataFrame:
    """``a``, ``b``: for each row that is ``outside`` (``id``, ``component``, ``outside``), one link to each other component
    among the rows of its key that it links to; ``sets``: ``id``, ``shingles``."""

    def fn(group: pa.Table) -> pa.RecordBatch:
        ids, component = (group.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component"))
        sets = group.column("shingles").combine_chunks()
        flat, size = sets.flatten().to_numpy(), np.array([len(x) for x in sets])
        at = np.cumsum(size) - size
        values, code = np.unique(flat, return_inverse=True)
        a, b = [], []
        for i in np.flatnonzero(group.column("outside").to_numpy(zero_copy_only=False)):
            member = np.zeros(len(values), bool)
            member[code[at[i] : at[i] + size[i]]] = True
            both = np.add.reduceat(member[code].astype(np.int64), at)
            linked = np.flatnonzero((100 * both >= percent * (size + size[i] - both)) & (component != component[i]))
            for k in linked[np.unique(component[linked], return_index=True)[1]]:
                a.append(min(ids[i], ids[k]))
                b.append(max(ids[i], ids[k]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if a else None

    return together(rows, key, fn, f"a {kind}, b {kind}", sets, F.col("outside")).distinct()


def linked_sets(classes: DataFrame, buckets: DataFrame, percent: int, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components of classes with small sets (``id``, ``shingles``): stars first, then blocks of what is still open."""
    kind = dict(classes.dtypes)["id"]
    links = save(exact_pairs(star_pairs(buckets), classes, percent), "links")
    found = components(links)
    more = save(exact_links(open_rows(buckets, found), classes, [F.col("band")], percent, kind), "links")
    return components(links.union(more)) if more.limit(1).count() else found
