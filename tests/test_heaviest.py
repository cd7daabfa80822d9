import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import heaviest, prospect, search
from lodestar.plans import prospect_queries as pq
from lodestar.sources.shared import keep

SECTORS = {"x": ["xx"], "y": ["yy"]}
NEEDS = {"one": ["w1", "w30"], "two": ["w2"], "none": ["absent"]}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(5000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"e{rng.randrange(9)}", rng.choice(["x", "y", "z", None]), text(rng.choice([1, 6, 40, 400]))) for i in range(900)]
    rows += [(1000 + i, f"e{i % 12}", "x", rows[3][3]) for i in range(40)] + [(2000, "e1", "y", None), (2001, "e2", "x", ""), (2002, None, "x", text(50))]
    asks = [(i, rng.choice(["", "xx ", "yy ", "xx yy "]) + text(rng.choice([1, 4, 25]))) for i in range(120)]
    asks += [(200, "absent"), (201, ""), (202, None), (203, "xx"), (204, "w1 w1 w1"), (205, "w7 w9"), (205, "xx w11 w7"), (None, "w3 w4")]
    return spark.createDataFrame(rows, "doc_id long, name string, sector string, text string").repartition(3), spark.createDataFrame(asks, "q long, text string")


def rows(df):
    return sorted((r.q, r.entity_place, r.need_place, r.name, r.need, r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize(("limits", "entities"), [({}, 3), ({"BLOCK_TERMS": 200, "TEXTS": 40, "POSTINGS": 300, "PAIRS": 50}, 2), ({"SEEDS": 1, "SECTOR_SEEDS": 2, "PAIRS": 1, "TEXTS": 1}, 3)])
def test_answers_of_all_pairs(spark, corpus, monkeypatch, limits, entities):
    documents, asks = corpus
    plans, held = prospect.planned(asks, "q", SECTORS, NEEDS), search.index(documents, "doc_id")
    # rows of one key are no case of the plain way, which would join each with the other's sectors
    plain = plans.where("q is null or q <> 205")
    for name, value in limits.items():
        monkeypatch.setattr(heaviest, name, value)
    best, few = heaviest.best(documents, plans, [t for n in NEEDS.values() for t in n], "q", "doc_id", "name", "sector", entities, keep)
    got = rows(prospect.answered(plain, few, documents, NEEDS, "q", "doc_id", "name", "sector", entities, best=best.where("q <> 205")))
    assert len(got) > 300 and got == rows(prospect.answered(plain, held, documents, NEEDS, "q", "doc_id", "name", "sector", entities))
    assert best.where("q = 205").count() >= entities and best.where("q is null").count() == 0


def test_few_pairs_are_given_back(spark, corpus):
    documents, asks = corpus
    best, _ = heaviest.best(documents, prospect.planned(asks, "q", SECTORS, NEEDS), ["w1"], "q", "doc_id", "name", "sector", 3, keep)
    assert best.groupBy("q").count().agg({"count": "max"}).first()[0] < 13  # of 12 entities and a null one


def test_nothing_to_do(spark, corpus):
    documents, asks = corpus
    plans = prospect.planned(asks, "q", SECTORS, NEEDS)
    for some, of in ((documents.where("false"), plans), (documents, plans.where("false")), (documents.where("text is null"), plans)):
        best, held = heaviest.best(some, of, ["w1"], "q", "doc_id", "name", "sector", 3, keep)
        assert best.count() == 0 and held.stats.first().n == some.count()


def test_query_scores_no_pair_from_postings(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("an index of all terms")

    monkeypatch.setattr(search, "index", refused)
    assert pq.prospect_run(spark, "/root/testdata/sf0.001").count() == 4


@pytest.mark.parametrize(("limits", "passes"), [({"BLOCK_TERMS": 200}, 1), ({"VOCABULARY": 50, "BLOCK_TERMS": 40}, None)])
def test_blocks_of_requests_share_a_pass_over_the_texts(spark, corpus, monkeypatch, limits, passes):
    documents, asks = corpus
    plans, held = prospect.planned(asks.where("q < 205"), "q", SECTORS, NEEDS), search.index(documents, "doc_id")
    for name, value in limits.items():
        monkeypatch.setattr(heaviest, name, value)
    calls, counted = [], heaviest.counted
    monkeypatch.setattr(heaviest, "counted", lambda *a, **k: calls.append(a) or counted(*a, **k))
    best, few = heaviest.best(documents, plans, [t for n in NEEDS.values() for t in n], "q", "doc_id", "name", "sector", 3, keep)
    assert len(calls) == passes if passes else len(calls) > 1
    args = documents, NEEDS, "q", "doc_id", "name", "sector", 3
    assert rows(prospect.answered(plans, few, *args, best=best)) == rows(prospect.answered(plans, held, *args))


def test_copies_are_scored_once(spark, corpus):
    documents, asks = corpus
    copies = [documents.withColumn("doc_id", F.col("doc_id") + 10_000 * i) for i in range(3)]
    many = copies[0].unionAll(copies[1]).unionAll(copies[2])
    plans = prospect.planned(asks.where("q < 205").unionAll(asks.where("q < 205").withColumn("q", F.col("q") + 1000)), "q", SECTORS, NEEDS)
    best, few = heaviest.best(many, plans, [t for n in NEEDS.values() for t in n], "q", "doc_id", "name", "sector", 3, keep)
    words = plans.select(F.explode("keywords").alias("term")).distinct()
    one, three = (heaviest.block(d, words, "doc_id", "name", "sector", keep) for d in (documents, many))
    assert three.texts.count() == one.texts.count() and three.n == 3 * one.n and (three.df.sum() == 3 * one.df.sum())
    args = many, NEEDS, "q", "doc_id", "name", "sector", 3
    assert rows(prospect.answered(plans, few, *args, best=best)) == rows(prospect.answered(plans, search.index(many, "doc_id"), *args))


def test_bounds_leave_out_no_request(monkeypatch):
    monkeypatch.setattr(heaviest, "REQUESTS", 7)
    rng = np.random.default_rng(3)
    lengths = np.append(rng.integers(0, 40, 300), [300, 77, 1])
    start = np.append(0, np.cumsum(lengths))
    term, floor = rng.integers(0, 50, start[-1]).astype(np.int32), rng.random(len(lengths)) * lengths / 2
    number = np.flatnonzero(lengths > 0)[::2]
    asks = heaviest._requests(number, term, start, floor, 50)
    parts, line = rng.random((31, 5)).astype(np.float32), np.append(rng.integers(0, 31, 50), 0)
    parts[0] = 0
    request, of = heaviest._live(asks, parts, line)
    exact = [[parts[line[term[start[i] : start[i + 1]]], s].astype(float).sum() >= floor[i] for s in range(5)] for i in asks.number]
    assert sorted(asks.number) == sorted(number) and (asks.floor == floor[asks.number]).all()
    assert {*zip(request.tolist(), of.tolist(), strict=True)} == {tuple(x) for x in np.argwhere(exact).tolist()}
    assert 100 < len(request) < 5 * len(number) and (np.diff(of) >= 0).all()
