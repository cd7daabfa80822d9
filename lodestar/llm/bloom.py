"""A Bloom filter of fixed size over 64-bit keys, so that a scan drops rows before they are shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26  # 8 MB, whatever the input's size
SHIFTS = (0, 64 - BITS)


def build(keys: DataFrame, column: str) -> np.ndarray:
    """Two bits a key. What reaches the driver is bounded by the filter's size."""
    place = lambda shift: F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << BITS) - 1))
    bit = keys.select(F.explode(F.array(*(place(s) for s in SHIFTS))).alias("place"))
    filled = bit.groupBy(F.shiftright("place", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 31 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 5), np.uint32)
    out[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    return out


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(keys.shape, bool)
    for shift in SHIFTS:
        place = (keys >> np.uint64(shift)) & np.uint64((1 << BITS) - 1)
        hit &= (table[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return hit
