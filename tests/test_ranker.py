import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import ranker, search

SCHEMA = "query_id long, doc_id long, position int, " + ", ".join(f"{n} double" for n in ranker.NAMES) + ", right boolean"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = []
    for q in range(60):
        for d in range(8):
            x = rng.normal(size=len(ranker.NAMES))
            out.append((q, d, d + 1, *map(float, x), bool(x[2] - 0.5 * x[0] + rng.normal() > 1.2)))
    return out


def test_weights_equal_a_plain_minimum(spark, rows):
    examples = spark.createDataFrame(rows, SCHEMA).repartition(4)
    fold = {r.q: r.f for r in spark.range(60).select(F.col("id").alias("q"), ranker.fold_of("id", 3).alias("f")).collect()}
    got = ranker.fit(examples, "query_id", folds=3, penalty=2.0, rounds=30)
    assert len(set(fold.values())) == 3 and sorted(got) == [0, 1, 2]
    for f, w in got.items():
        pairs = []
        for q in range(60):
            own = [(np.array(r[3:-1]), r[-1]) for r in rows if r[0] == q]
            if fold[q] != f:
                pairs += [x - y for x, a in own if a for y, b in own if not b]
        d = np.array(pairs)
        slope = -(d / (1 + np.exp(d @ np.array(w)))[:, None]).sum(axis=0) + 2.0 * np.array(w)
        assert np.abs(slope).max() < 1e-4 * len(d)
        assert np.argmax(w) == 2 and w[0] < 0


def test_scores_take_the_weights_of_their_fold(spark, rows):
    found = spark.createDataFrame(rows, SCHEMA)
    weights = {0: [1.0] + [0.0] * 6, 1: [0.0] * 6 + [2.0]}
    told = {(r.query_id, r.doc_id): r.rerank_score for r in ranker.scores(found, weights, "doc_id", "query_id").collect()}
    fold = {r.q: r.f for r in spark.range(60).select(F.col("id").alias("q"), ranker.fold_of("id", 2).alias("f")).collect()}
    assert all(abs(told[r[0], r[1]] - (r[3] if fold[r[0]] == 0 else 2 * r[9])) < 1e-6 for r in rows)


def test_nothing_to_learn_keeps_the_order(spark, rows):
    none = ranker.fit(spark.createDataFrame(rows, SCHEMA).where("not right"), "query_id", folds=2)
    assert none == {0: [0.0] * 7, 1: [0.0] * 7}
    fused = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.8, 2)], "query_id long, doc_id long, fused double, position int")
    flat = fused.select("query_id", "doc_id", F.lit(0.0).alias("rerank_score"))
    assert [r.doc_id for r in search.rerank(fused, "doc_id", "query_id", flat, 2).orderBy("final_position").collect()] == [5, 6]


def test_features(spark):
    fused = spark.createDataFrame([(1, 5, 0.5, 2.0, 1), (1, 6, None, None, 2), (2, 5, 0.1, None, 1), (3, 7, 0.2, 1.0, 1)], "query_id long, doc_id long, score_0 double, score_1 double, position int")
    asked = spark.createDataFrame([(1, "red green blue"), (2, None), (3, "red")], "query_id long, question string")
    texts = spark.createDataFrame([(5, "xx red green yy blue"), (6, ""), (7, None)], "doc_id long, text string")
    got = {(r.query_id, r.doc_id): r for r in ranker.features(fused, asked, texts, "doc_id", "query_id").collect()}
    r = got[1, 5]
    assert (r.words, r.pairs, r.triples, r.early) == (1.0, 0.5, 0.0, 0.5) and abs(r.length - np.log(6)) < 1e-12 and r.cosine == 0.5
    assert got[1, 6].words == got[2, 5].words == 0.0 and got[1, 6].cosine == 0.0
