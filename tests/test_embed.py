import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from lodestar.operators import embed, search

DOCS = [(1, "Zürich zurich ab ab ab"), (2, "the quick brown fox"), (3, ""), (4, None), (5, "fox"), (6, "quickly browner foxes")]


def plain(texts, asked):
    """Vectors with plain loops: (of the texts, of the questions)."""
    tok = lambda t: [x for x in (t or "").lower().replace("ü", "u").split() if len(x) > 1]
    bags = {k: Counter(tok(t)) for k, t in texts}
    df = Counter(t for b in bags.values() for t in b)
    n = len(texts)

    def signs(term):
        framed = f"#{term}#"
        hexes = "".join(hashlib.md5(f"{i}:{term}".encode()).hexdigest() for i in range(2)) + min(hashlib.md5(("~" + framed[i : i + 3]).encode()).hexdigest() for i in range(len(term)))[16:32]
        s = np.array([-1.0 if b == "1" else 1.0 for b in bin(int("1" + hexes, 16))[3:]])
        s[256:] *= 0.5
        return s

    def vector(bag):
        v = sum((1 + math.log(tf)) * math.log(1 + n / (1 + df[t])) * signs(t) for t, tf in bag.items())
        return v / np.linalg.norm(v)

    return {k: vector(b) for k, b in bags.items() if b}, {k: vector(Counter(tok(t))) for k, t in asked if tok(t)}


def test_vectors_equal_plain_loops(spark):
    asked = [(1, "quick unseen unseen"), (2, None), (3, "zurich")]
    held = search.index(spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3), "doc_id")
    own, questions = plain(DOCS, asked)
    got = {r.doc_id: r.embedding for r in embed.vectors(held.postings, held, "doc_id").collect()}
    told = {r.query_id: r.embedding for r in embed.asked_vectors(search.asked_terms(spark.createDataFrame(asked, "query_id long, text string"), "query_id"), held, "query_id").collect()}
    for want, found in ((own, got), (questions, told)):
        assert want.keys() == found.keys() and all(len(found[k]) == embed.SIZE and np.allclose(found[k], want[k], atol=1e-12) for k in want)
    assert np.dot(own[2], own[6]) > np.dot(own[1], own[6])  # other forms of a word share trigrams


def test_texts_over_several_batches(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(9000))), (2, "w1 w2"), (3, " ".join(f"w{i}" for i in range(5000)))]
    held = search.index(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    own, _ = plain(rows, [])
    got = {r.doc_id: r.embedding for r in embed.vectors(held.postings, held, "doc_id").coalesce(1).collect()}
    assert got.keys() == own.keys() and all(np.allclose(got[k], own[k], atol=1e-9) for k in own)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_dense_of_all_lengths_equals_brute_force(spark, threshold):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(2, 3, 5)[i % 3]).tolist()) for i in range(300)]
    rows += [(900, None), (901, [0.0, 0.0]), (902, [1.0, None]), (903, [math.nan, 1.0]), (904, []), (905, rows[1][1]), (906, rows[1][1])]
    queries = [r for r in rows if r[0] % 20 == 0 or r[0] > 899]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got: dict = {}
        schema = "{} long, embedding array<double>"
        for r in search.dense(spark.createDataFrame(rows, schema.format("id")).repartition(5), spark.createDataFrame(queries, schema.format("q")), "id", "q", 4, block=16).orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append((r.id, r.score))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    good = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    for q, _ in queries:
        if q not in good:
            assert q not in got
            continue
        near = [(-round(float(good[q] @ v / np.linalg.norm(v) / np.linalg.norm(good[q])), 6), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
        assert [i for i, _ in got[q]] == [i for _, i in sorted(near)[:4]]


def test_dense_keeps_the_own_id_where_asked(spark):
    vectors, asked = (spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], f"{k} long, embedding array<float>") for k in ("id", "q"))
    got = search.dense(vectors, asked, "id", "q", 1, not_own=False).collect()
    assert {(r.q, r.id) for r in got} == {(1, 1), (2, 2)}
    assert search.dense(vectors.where("false"), asked, "id", "q", 1).count() == 0


def test_index_and_vectors_follow_the_table(spark, tmp_path):
    from lodestar.plans.retrieval_queries import corpus_index, text_vectors

    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    write(DOCS)
    assert corpus_index(spark, str(tmp_path)).postings.count() > 0 and text_vectors(spark, str(tmp_path)).count() == 4
    write([])
    assert corpus_index(spark, str(tmp_path)).postings.count() == 0 == text_vectors(spark, str(tmp_path)).count()


def test_a_strategy_may_be_read_twice(spark):
    from lodestar.plans import QUERIES

    first = QUERIES["one_strategy"](spark, "/root/testdata/sf0.001")
    n = QUERIES["one_strategy"](spark, "/root/testdata/sf0.001").count()
    assert n == first.count() > 0
