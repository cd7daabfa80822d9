import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm.blocks import BLOCK, together


def _pairs(rows, **more):
    """Pairs of different rows that met in some group."""

    def met(group: pa.Table) -> pa.RecordBatch:
        ids = np.sort(group.column("id").to_numpy())
        x, y = np.triu_indices(len(ids), 1)
        return pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], ["x", "y"])

    return {(r.x, r.y) for r in together(rows, [F.col("k")], met, "x long, y long", **more).distinct().collect()}


def test_every_active_row_of_a_large_key_meets_all_rows(spark):
    n = 2 * BLOCK + 30
    rows = spark.range(n).select("id", F.lit(1).alias("k"), (F.col("id") % 100 == 7).alias("asks"))
    found = _pairs(rows, active=F.col("asks"))
    asking = set(range(7, n, 100))
    assert {(min(i, j), max(i, j)) for i in asking for j in range(n) if i != j} <= found
    assert len(found) < n * (n - 1) // 2


def test_all_rows_meet_without_roles_and_none_without_an_active_row(spark):
    n = BLOCK + 8
    rows = spark.range(n).select("id", F.lit(1).alias("k"))
    assert len(_pairs(rows)) == n * (n - 1) // 2
    assert _pairs(rows, active=F.lit(True)) == _pairs(rows)
    assert _pairs(rows, active=F.lit(False)) == set()
