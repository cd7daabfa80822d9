import pytest
from pyspark.sql import functions as F

from lodestar.functions.vectors import cosine, truncate
from lodestar.operators import planner, providers, search


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank long")


def order(df):
    return [r.doc_id for r in df.orderBy("position").collect()]


def test_rrf_ties_and_absent_arm(spark):
    a, b = ranked(spark, [(1, 1, 9.0, 1), (1, 2, 8.0, 2)]), ranked(spark, [(1, 2, 5.0, 1), (1, 1, 4.0, 2), (1, 3, 1.0, 3)])
    fused = search.fuse_rrf([(a, 1.0), (b, 1.0)], "doc_id", "query_id", 10)
    assert order(fused) == [1, 2, 3]
    row = {r.doc_id: r for r in fused.collect()}
    assert row[3].score_0 is None and row[1].fused == pytest.approx(1 / 11 + 1 / 12, abs=1e-6)
    assert order(search.fuse_rrf([(a, 1.0), (b.where("false"), 1.0)], "doc_id", "query_id", 10)) == [1, 2]


def test_minmax_of_equal_scores_is_half(spark):
    a = ranked(spark, [(1, 1, 2.0, 1), (1, 2, 2.0, 2)])
    assert {r.fused for r in search.fuse_scores([(a, 1.0)], "doc_id", "query_id", "minmax").collect()} == {0.5}
    zero = ranked(spark, [(1, 1, 0.0, 1)])
    assert search.fuse_scores([(zero, 1.0)], "doc_id", "query_id", "sum").first().fused == 0


def test_rerank_keeps_union_order_without_scores(spark):
    fused = search.fuse_rrf([(ranked(spark, [(1, i, 1.0, i) for i in range(1, 9)]), 1.0)], "doc_id", "query_id", 10)
    same = search.rerank(fused, "doc_id", "query_id", None, 5)
    assert [(r.position, r.final_position, r.rerank_score) for r in same.orderBy("final_position").collect()] == [(i, i, None) for i in range(1, 6)]
    scores = spark.createDataFrame([(1, 8, 3.0), (1, 2, 1.0), (1, 3, 1.0)], "query_id long, doc_id long, rerank_score double")
    assert [r.doc_id for r in search.rerank(fused, "doc_id", "query_id", scores, 3).orderBy("final_position").collect()] == [8, 2, 3]


def test_bm25_prefers_rare_terms_and_drops_empty_queries(spark):
    docs = spark.createDataFrame([(1, "common common rare"), (2, "common words here"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "rare common"), (2, "absent"), (3, "")], "query_id long, text string")
    assert [(r.query_id, r.doc_id, r.rank) for r in search.bm25(docs, q, "doc_id", "query_id", 5).orderBy("query_id", "rank").collect()] == [(1, 1, 1), (1, 2, 2)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r.x for r in df.select(cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == pytest.approx(0.96) and got[1] is None
    assert df.select(truncate(F.col("a"), 1).alias("x")).first().x == [1.0]


def test_entity_search(spark):
    docs = spark.createDataFrame([("b", "gpu gpu"), ("a", "gpu"), ("c", "none")], "name string, text string")
    names = docs.select("name")
    assert [(r.name, r.score, r.matched) for r in search.search_entities(names, docs, ["gpu"], "name", 5).collect()] == [("b", 0.2, 1), ("a", 0.1, 1)]
    assert [r.name for r in search.search_entities(names, docs, [], "name", 2).collect()] == ["a", "b"]
    assert [r.name for r in search.search_entities(names, docs, ["gpu"], "name", 5, F.col("name") != "b").collect()] == ["a"]


def test_plan():
    made = planner.plan("Startups de saúde em série A com voz e latência", {"saude": ["saúde"], "voz": ["voz"]}, ["série a"], {"latencia": ["latência"], "custo": ["custo"], "atendimento": ["voz"]}, {"de", "em", "com", "startups"}, ["ia"], 0)
    assert made.sectors == ["saude", "voz"] and made.stages == ["série a"] and made.priorities == ["atendimento", "latencia"] and made.limit == 5 and made.discriminates()
    assert "voz" in planner.plan("agricultura", {"voz": ["ura"]}, [], {}, set(), [], match="substring").sectors
    assert not planner.plan("agricultura", {"voz": ["ura"]}, [], {}, set(), []).sectors
    assert planner.outcome(None, 0) == "no plan" and planner.outcome(made, 0) == "nothing matches"


def test_providers(spark):
    q = spark.createDataFrame([(1, "q"), (2, "q")], "item_id long, question string")
    p = spark.createDataFrame([(1, 7, "text"), (1, 8, "more")], "item_id long, doc_id long, text string")
    assert all(r.abstained for r in providers.answer(q, p, "item_id", providers.generator("none")).collect())
    got = {r.item_id: r for r in providers.answer(q, p, "item_id", lambda question, found: ("yes", [0, 5, -1])).collect()}
    assert got[1].cited == [0] and not got[1].abstained and got[1].reason is None and got[2].abstained
    with pytest.raises(ValueError):
        providers.reranker("unknown")
    pairs = p.withColumn("question", F.lit("q"))
    assert providers.rerank_scores(pairs, "doc_id", "item_id", None) is None
    assert {r.doc_id: r.rerank_score for r in providers.rerank_scores(pairs, "doc_id", "item_id", lambda q, t: [float(len(x)) for x in t]).collect()} == {7: 4.0, 8: 4.0}
    assert providers.embed(p, "doc_id", lambda texts: [[1.0]] * len(texts)).count() == 2
