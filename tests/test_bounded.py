import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import bounded, search
from lodestar.sources.shared import keep


@pytest.mark.parametrize("stored", [True, False])
def test_rows_equal_the_plain_search_and_fewer_postings_are_scored(spark, stored):
    r = random.Random(3)
    rare = [f"rare{i}" for i in range(400)]
    docs = [(i, " ".join([*(r.choice(["the", "of", "and", "to"]) for _ in range(r.randrange(1, 60))), *r.sample(rare, r.randrange(0, 9))])) for i in range(900)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + [(2000, ""), (2001, None)]
    asked = [(i, " ".join([*r.choices(["the", "of", "and"], k=3), *r.sample(rare, r.randrange(0, 6))])) for i in range(40)] + [(90, docs[5][1]), (91, ""), (92, None), (93, "unknown the"), (94, "rare1 rare1 rare2")]
    held = search.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "doc_id", keep=keep if stored else None)
    questions = spark.createDataFrame(asked, "q long, text string")
    want = sorted(map(tuple, search.bm25(held, questions, "doc_id", "q", 10).select("q", "doc_id", "score", "rank").collect()))
    found, told = bounded.bm25(held, search.asked_terms(questions, "q"), "doc_id", "q", 10, keep if stored else None)
    got = sorted(map(tuple, found.select("q", "doc_id", "score", "rank").collect()))
    assert len(got) == len(want) > 300 and [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want, strict=True))
    read = told.agg(F.sum("postings").alias("p"), (F.sum("scored") + F.sum("looked_up")).alias("s")).first()
    assert read.s < read.p / 2


def test_few_documents_and_none(spark):
    none = search.index(spark.createDataFrame([], "doc_id long, text string"), "doc_id")
    asks = search.asked_terms(spark.createDataFrame([(1, "a thing")], "q long, text string"), "q")
    assert bounded.bm25(none, asks, "doc_id", "q", 3)[0].count() == 0
    two = search.index(spark.createDataFrame([(1, "thing"), (2, "thing thing other")], "doc_id long, text string"), "doc_id")
    assert bounded.bm25(two, asks, "doc_id", "q", 3)[0].count() == 2
