import random

import pytest

from lodestar.operators import embed, search, textual
from lodestar.plans import retrieval_queries as rq
from lodestar.sources.shared import keep


@pytest.mark.parametrize("common", [100_000, 7])
def test_rows_of_the_plain_search(spark, monkeypatch, common):
    rng = random.Random(8)
    monkeypatch.setattr(textual, "COMMON", common)
    monkeypatch.setattr(textual, "ROWS", 16)
    text = lambda n: " ".join(f"wo{int(rng.paretovariate(0.6)) % 80}" for _ in range(n))
    rows = [(i, text(rng.choice([1, 6, 50]))) for i in range(150)] + [(900, None), (901, ""), (902, "single")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asks = spark.createDataFrame([(i, text(5)) for i in range(9)] + [(50, ""), (51, "unheard"), (52, None)], "q long, text string")
    held = search.index(documents, "doc_id")
    asked = embed.asked_vectors(search.asked_terms(asks, "q"), held, "q")
    want = search.dense(embed.vectors(held.postings, held, "doc_id"), asked, "doc_id", "q", 200, not_own=False)
    got = textual.dense(textual.corpus(documents, "doc_id", keep), asked, "q", 200, keep)
    told = lambda df: {(r.q, r.doc_id): r.score for r in df.collect()}
    a, b = told(got), told(want)
    assert len(a) == 10 * 151 and a.keys() == b.keys() and all(abs(a[x] - b[x]) < 2e-6 for x in a)


def test_queries_store_no_vectors_and_no_postings(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("an index of all terms")

    monkeypatch.setattr(search, "index", refused)
    at = "/root/testdata/sf0.001"
    assert rq.chunk_engines(spark, at).count() == 6
    assert rq.fuse_minmax(spark, at).count() > 20
