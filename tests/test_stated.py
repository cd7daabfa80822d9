import random

import pytest

from lodestar.operators import search, stated
from lodestar.plans import retrieval_queries as rq
from lodestar.sources.shared import keep


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.choice([1, 5, 60]))) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, None), (2001, ""), (2002, "...")]
    asks = [(i, text(rng.choice([1, 4, 12]))) for i in range(40)] + [(100, "absent"), (101, ""), (102, None), (103, "w1 w1 W2")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(asks, "q long, text string")


def rows(df):
    return sorted((r.q, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("block", [200_000, 50])
def test_rows_of_the_plain_search(spark, corpus, monkeypatch, block):
    documents, asks = corpus
    monkeypatch.setattr(stated, "BLOCK_TERMS", block)
    monkeypatch.setattr(stated, "QUESTIONS", 7)
    got, want = (rows(x) for x in (stated.bm25(documents, asks, "doc_id", "q", 9, keep), search.bm25(documents, asks, "doc_id", "q", 9)))
    assert len(got) > 100 and got == want
    assert stated.bm25(documents, asks.where("q > 99 and q < 103"), "doc_id", "q", 9, keep).count() == 0
    assert stated.bm25(documents.where("false"), asks, "doc_id", "q", 9, keep).count() == 0


def test_index_of_asked_terms(spark, corpus):
    documents, asks = corpus
    held, terms = stated.index(documents, search.asked_terms(asks, "q"), "doc_id", keep)
    whole = search.index(documents, "doc_id")
    assert held.stats.first().n == whole.stats.first().n and held.stats.first().avgdl == whole.stats.first().avgdl
    asked = search.asked_terms(asks, "q").select("term").distinct()
    assert held.postings.count() == whole.postings.join(asked, "term").count() and held.frequencies.count() == whole.frequencies.join(asked, "term").count()


def test_lexical_queries_make_no_index_of_all_terms(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("an index of all terms")

    monkeypatch.setattr(search, "index", refused)
    at = "/root/testdata/sf0.001"
    assert rq.bm25_topk(spark, at).count() == 20
    assert rq.bm25_bounded(spark, at).count() > 20
    assert rq.recall_at_k(spark, at).count() == 3
