import math

import numpy as np
import pytest

from lodestar.operators import search, vector_index

SCHEMA = "id long, embedding array<float>"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    heads = rng.normal(size=(12, 16))
    many = [(i, (heads[i % 12] + 0.6 * rng.normal(size=16)).tolist()) for i in range(1200)]
    many += [(2000 + i, heads[0].tolist()) for i in range(400)]  # a hot cell of copies
    many += [(3000, None), (3001, [0.0] * 16), (3002, [1.0, None] * 8), (3003, [math.nan] * 16), (3004, []), (3005, [1.0, 2.0]), (3006, [2.0, 1.0])]
    return many


def asked(spark, rows):
    return spark.createDataFrame([r for r in rows if r[0] % 25 == 0 or r[0] >= 3000], "q long, embedding array<float>")


def lists(df):
    out: dict = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r.q, []).append((r.id, r.score))
    return out


def test_recall_is_what_is_told_and_few_folders_are_read(spark, rows):
    vectors, queries = spark.createDataFrame(rows, SCHEMA).repartition(4), asked(spark, rows)
    held = vector_index.build(vectors, "id", cells=12, sample=500)
    assert held.table(spark).count() == 1200 + 400 + 2
    exact = search.dense(vectors, queries, "id", "q", 10)
    probes = vector_index.probes_for(held, exact, queries, "q", 0.95)
    assert probes < 12
    got, want = lists(vector_index.search(held, queries, "q", 10, probes)), lists(exact)
    told = {r.probes: r.recall for r in vector_index.recalls(held, exact, queries, "q").collect()}
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want)
    assert hits / sum(map(len, want.values())) >= told[probes] - 1e-9 >= 0.95 - 1e-9 and told[12] > 0.999
    one = queries.where("q = 0")
    plan = vector_index.search(held, one, "q", 10, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "cell#" in plan.split("PartitionFilters")[1][:200]


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_all_cells_are_exact(spark, rows, threshold):
    vectors, queries = spark.createDataFrame(rows, SCHEMA), asked(spark, rows)
    held = vector_index.build(vectors, "id", cells=5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert lists(vector_index.search(held, queries, "q", 7, None)) == lists(search.dense(vectors, queries, "id", "q", 7))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    held = vector_index.build(none, "id")
    asks = spark.createDataFrame([(1, [1.0, 2.0])], "q long, embedding array<float>")
    assert vector_index.search(held, asks, "q", 3, 2).count() == 0
    few = vector_index.build(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], SCHEMA), "id", cells=64)
    assert lists(vector_index.search(few, asks, "q", 3, None)) == {1: [(2, 0.8)]}


def test_what_is_sent_does_not_grow_with_cells_times_partitions(spark, rows, monkeypatch):
    """With all cells a query block is sent once a partition, with some once a cell and share of the partitions."""
    vectors, queries = spark.createDataFrame(rows, SCHEMA), asked(spark, rows).coalesce(1)
    held = vector_index.build(vectors, "id", cells=8)
    sent = []
    pairs = search._best_of_pairs

    def counted(met, *args):
        sent.append(met.select("asked", "part", *(c for c in met.columns if c == "cell")).distinct().count())
        return pairs(met, *args)

    monkeypatch.setattr(search, "_best_of_pairs", counted)
    monkeypatch.setattr(vector_index, "_best_of_pairs", counted)
    vector_index.search(held, queries, "q", 7, None)
    vector_index.search(held, queries, "q", 7, 4)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sent[0] <= 2 * parts and sent[1] <= 2 * 9 * -(-parts // 8)
