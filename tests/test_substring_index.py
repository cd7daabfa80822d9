import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import substring_index as S
from lodestar.sources.shared import keep

LETTERS = "abcAé \n😀"


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    some = lambda n: "".join(r.choice(LETTERS) for _ in range(n))
    texts = [some(r.randint(0, 40)) for _ in range(150)] + [None, "", "a", "ab", some(30_000)]
    patterns = [some(n) for n in (1, 1, 1, 2, 2, 2, 3, 3, 4, 5, 6, 9)] + [t[3:15] for t in texts[:20] if t] + [None, "", "zq", "zzz", texts[-1][100:900]]
    return list(enumerate(texts)), list(enumerate(patterns))


@pytest.mark.parametrize("stored", [True, False])
def test_equals_looking_everywhere(spark, corpus, stored):
    texts, patterns = corpus
    docs, asked = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(patterns, "q long, pattern string")
    held = S.index(docs, "doc_id", keep if stored else None)
    found = S.holding(held, docs, asked, "q", "pattern", "doc_id", F.lower("text").contains(F.lower("pattern")))
    want = {(q, d) for q, p in patterns for d, t in texts if p and t and p.lower() in t.lower()}
    assert {(r.q, r.doc_id) for r in found.collect()} == want and len(want) > 300


def test_candidates_are_few_and_no_loop_is_planned(spark, corpus):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('the same words everywhere ', id, case when id % 100 = 7 then ' xylophone' else '' end) as text")
    asked = spark.createDataFrame([(1, "words xylophone"), (2, "xylophone"), (3, "where 2999")], "q long, pattern string")
    pairs = S.candidates(S.index(docs, "doc_id", keep), asked, "q", "pattern", "doc_id")
    assert pairs.where("q = 2").count() == 30 and pairs.where("q = 3").count() < 30
    plan = S.holding(S.index(docs, "doc_id", keep), docs, asked, "q", "pattern", "doc_id", F.col("text").contains(F.col("pattern")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty(spark):
    docs, asked = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "q long, pattern string")
    assert S.candidates(S.index(docs, "doc_id"), asked, "q", "pattern", "doc_id").count() == 0
