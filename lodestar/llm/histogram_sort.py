"""Shards of near-equal bytes by histogram sort, with DataFrame operations only.

Rows are ordered by a key of three hashes: of the text, of ``doc_id`` and of the row's place in the input. Equal texts
are thus neighbours, and a text or id that a third of all rows share is still cut where its bytes demand it.

A histogram counts exact bytes below candidate boundaries: first of all keys by 12 bits, then only of the keys between
the two candidates that enclose a splitter, by the next 12 bits, until the bytes below each splitter are within
``tolerance`` of a shard's size or the interval holds one row. What comes to the driver is the cells around the
``shards`` - 1 splitters, whatever the number of rows. Rows find their shard from their first 12 bits and the few
splitters inside that cell, so the full rows are exchanged once, when the shards are written.

Defined results. A null text has no bytes, only the fixed size of a row; its checksum is 0. Rows with equal keys are in
any order, each with a slot of its own. Fewer rows than shards leave shards empty; an empty table gives an empty result.
The columns of the input are carried by :func:`assign`, but for any called ``size``, ``shard`` or ``slot``, which are
replaced; names that begin with ``__`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import own_columns, save

ROW_BYTES = 16
STEP, PER_HASH = 12, 5  # bits a level, and levels a hash: the upper 60 bits
LEVELS = 3 * PER_HASH


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text and a fixed part."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _keys(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    keyed = documents.withColumn("__row", F.monotonically_increasing_id())
    return keyed.withColumns({"__k0": F.xxhash64(F.lit(0), text), "__k1": F.xxhash64(F.lit(1), "doc_id"), "__k2": F.xxhash64(F.lit(2), "__row"), "__size": row_size(text)})


def _digit(level: int) -> Column:
    """Bits of the key at a level; the hashes are taken as unsigned."""
    hash_no, at = divmod(level, PER_HASH)
    return F.shiftrightunsigned(F.col(f"__k{hash_no}"), 64 - STEP * (at + 1)).bitwiseAND(F.lit((1 << STEP) - 1))


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, ...]]:
    """Lower boundaries of shards 1 to ``shards`` - 1, as digits of the key; a boundary that has fewer digits than
    ``LEVELS`` is the smallest key that begins with them."""
    narrow = keys.select(*(f"__k{i}" for i in range(3)), "__size")
    cells = {r.digit: (r.bytes, r.rows) for r in _histogram(narrow, 0).collect()}
    total = sum(b for b, _ in cells.values())
    if not total:
        return [()] * (shards - 1)
    allowed = tolerance * total / shards
    # each open interval: the digits that its keys begin with, the bytes below it, and the targets inside
    open_at: dict[tuple[int, ...], tuple[int, list[int]]] = {(): (0, list(range(1, shards)))}
    done: dict[int, tuple[int, ...]] = {}
    for level in range(LEVELS):
        inside = {(): cells} if level == 0 else _cells_within(narrow, list(open_at), level)
        following: dict[tuple[int, ...], tuple[int, list[int]]] = {}
        for prefix, (below, targets) in open_at.items():
            edges, run = [], below
            for digit in sorted(inside[prefix]):
                size, rows = inside[prefix][digit]
                edges.append((run, run + size, digit, rows))
                run += size
            for target in targets:
                goal = total * target / shards
                low, high, digit, rows = next((e for e in edges if e[1] >= goal), edges[-1])
                if goal - low <= allowed and goal - low <= high - goal:
                    done[target] = (*prefix, digit)
                elif high - goal <= allowed or rows == 1 or level == LEVELS - 1:
                    done[target] = (*prefix, digit + 1) if high - goal <= goal - low else (*prefix, digit)
                else:
                    following.setdefault((*prefix, digit), (low, []))[1].append(target)
        open_at = following
        if not open_at:
            break
    return [done[t] for t in range(1, shards)]


def _histogram(narrow: DataFrame, level: int) -> DataFrame:
    return narrow.groupBy(_digit(level).cast("int").alias("digit")).agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _cells_within(narrow: DataFrame, prefixes: list[tuple[int, ...]], level: int) -> dict:
    """Histograms of the next digit of the keys with one of the prefixes: fewer than ``shards`` of them."""
    digits = F.array(*(_digit(i).cast("int") for i in range(level)))
    wanted = narrow.sparkSession.createDataFrame([(list(p),) for p in prefixes], "prefix array<int>")
    kept = narrow.withColumn("prefix", digits).join(F.broadcast(wanted), "prefix")  # at most shards - 1 rows
    found: dict = {p: {} for p in prefixes}
    for r in kept.groupBy("prefix", _digit(level).cast("int").alias("digit")).agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect():
        found[tuple(r.prefix)][r.digit] = (r.bytes, r.rows)
    return found


def _place(cuts: list[tuple[int, ...]]) -> Column:
    """The shard of a key: shards that begin in an earlier cell of the first digit, and those of this cell at or below
    the key."""
    first = [c[0] if c else 0 for c in cuts]
    inside: dict[int, list[tuple[int, ...]]] = {}
    for c in cuts:
        if len(c) > 1:
            inside.setdefault(c[0], []).append(c)
    # a cut of one digit counts for every key of its cell and the later ones
    whole = sorted(c for c, full in zip(first, cuts, strict=True) if len(full) <= 1)
    whole_set = F.array(*(F.lit(c) for c in whole)).cast("array<int>")
    part_set = F.array(*(F.lit(c[0]) for c in cuts if len(c) > 1)).cast("array<int>")
    digit = _digit(0).cast("int")
    shard = F.size(F.filter(whole_set, lambda c: c <= digit)) + F.size(F.filter(part_set, lambda c: c < digit))
    digits = F.array(*(_digit(i).cast("int") for i in range(LEVELS)))
    for cell, own in inside.items():
        reached = sum((F.when(digits >= F.array(*(F.lit(d) for d in c)).cast("array<int>"), 1).otherwise(0) for c in own), F.lit(0))
        shard = shard + F.when(digit == cell, reached).otherwise(0)
    return shard


def assign(documents: DataFrame, shards: int, tolerance: float = 0.001, carry: list[str] | None = None) -> DataFrame:
    """``documents`` (the columns in ``carry``, or all) with ``size``, ``shard`` and ``slot``, which has no gaps within a
    shard. What is carried is saved once with its keys, so that histogram, counts and rows are of one table even where the
    input's rows come in another order when a task is run again."""
    kept = set(documents.columns if carry is None else carry) - {"size", "shard", "slot"}
    own = [c for c, name in zip(own_columns(documents), documents.columns, strict=True) if name in kept]
    keys = save(_keys(documents).select(*own, "__k0", "__k1", "__k2", "__size"), "keys")
    cuts = splitters(keys, shards, tolerance)
    # slots are counted by shard and cell, so that no task sorts a whole shard; a text that many rows share spreads over 16
    # cells by the ids beside it, and rows that share the id as well by their places
    spread = F.shiftrightunsigned("__k1", 60).bitwiseXOR(F.shiftrightunsigned("__k2", 60))
    placed = keys.withColumns({"shard": _place(cuts).cast("int"), "__cell": (_digit(0) * 16 + spread).cast("int")})
    filled = placed.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = filled.select(F.col("shard").alias("__shard"), F.col("__cell").alias("__of"), (F.sum("__n").over(W.partitionBy("shard").orderBy("__cell")) - F.col("__n")).alias("__before"))
    # at most 16 * (shards + 4096) rows
    in_cell = F.row_number().over(W.partitionBy("shard", "__cell").orderBy("__k0", "__k1", "__k2"))
    slotted = placed.withColumn("__in_cell", in_cell).join(F.broadcast(before), (F.col("shard") == F.col("__shard")) & (F.col("__cell") == F.col("__of")))
    return slotted.select(*own, F.col("__size").alias("size"), "shard", (F.col("__before") + F.col("__in_cell") - 1).cast("long").alias("slot"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder a shard, in order of the slots; a shard's cells may be files of several tasks."""
    assigned.write.partitionBy("shard").parquet(path)
