import random

import pytest

from lodestar.functions import stemming
from lodestar.operators import search, stated
from lodestar.plans import stemmed_queries as sq
from lodestar.sources.shared import keep

ENDS = ["", "o", "os", "a", "as", "ar", "ando", "ado", "amente", "mente", "idade", "ivo", "logia", "logias", "ira", "eiras", "ico", "oso", "ismo", "e", "ue", "ci", "gue", "antes", "avelmente", "abilidade", "ativamente"]


def made(rng, n):
    heads = ["cas", "compr", "gat", "livr", "pens", "tra", "bi", "nac", "fal", "re"]
    return ["".join((rng.choice(heads), rng.choice(["", "t", "ol", "ec"]), rng.choice(ENDS))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(made(rng, rng.choice([1, 6, 70])))) for i in range(700)] + [(2000, None), (2001, ""), (2002, "o de a"), (2003, "Comprando, COMPRADO comprár")]
    asks = [(i, " ".join(made(rng, rng.choice([1, 4, 12])))) for i in range(30)] + [(100, "zzzz"), (101, ""), (102, None), (103, "comprar compra comprado")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(asks, "q long, text string")


def test_a_stem_begins_its_words(spark):
    rng = random.Random(6)
    terms = spark.createDataFrame([(w,) for w in {*made(rng, 3000), *("".join(rng.choices("aeioucglrstv", k=rng.randrange(2, 9))) + rng.choice(ENDS) for _ in range(3000))}], "term string")
    assert stemming.stems(terms).where("not startswith(term, stem)").count() == 0


@pytest.mark.parametrize("block", [200_000, 20])
def test_rows_of_the_plain_search(spark, corpus, monkeypatch, block):
    documents, asks = corpus
    monkeypatch.setattr(stated, "BLOCK_TERMS", block)
    got = stated.bm25(documents, asks, "doc_id", "q", 9, keep, sq.STOPPED, stem=stemming.stems)
    want = search.bm25(documents, asks, "doc_id", "q", 9, sq.STOPPED, stem=stemming.stems)
    rows = lambda df: sorted((r.q, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert len(rows(got)) > 100 and rows(got) == rows(want)


def test_nothing_asked_and_no_texts(spark, corpus):
    documents, asks = corpus
    for some, of in ((documents.where("false"), asks), (documents, asks.where("q in (101, 102)")), (documents, asks.where("false")), (documents, asks.where("q = 100"))):
        assert stated.bm25(some, of, "doc_id", "q", 9, keep, sq.STOPPED, stem=stemming.stems).count() == 0


def test_stemmed_queries_make_no_index_of_all_stems(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("an index of all stems")

    monkeypatch.setattr(search, "index", refused)
    at = "/root/testdata/sf0.001"
    assert sq.bm25_stemmed(spark, at).count() == 20
    assert sq.entity_search_stemmed(spark, at).count() == 2
