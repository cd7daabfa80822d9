import random

import numpy as np
import pyarrow as pa
import pytest

from lodestar.operators import evaluate, occurrences, substring_index
from lodestar.plans import rule_queries
from lodestar.plans import retrieval_queries as rq


def test_equals_plain_search(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(occurrences, "TEXT_BYTES", 300)
    monkeypatch.setattr(occurrences, "_PAIRS", 7)
    for _ in range(60):
        letters = rng.choice(["ab", "abñ ", "abcdefgh"])
        word = lambda n: "".join(rng.choice(letters) for _ in range(n))
        texts = [None if rng.random() < 0.1 else word(rng.choice([0, 3, 20, 200])) for _ in range(12)]
        cut = [t[a : a + rng.choice([1, 7, 8, 9, 40])] for t in texts if t for a in [rng.randrange(len(t))]]
        patterns = sorted({word(rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 24])) for _ in range(15)} | set(cut))
        held, got, at = occurrences.Patterns([p.encode() for p in patterns]), set(), 0
        for part, data, offsets in occurrences._pieces(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"]), "t"):
            rows, which = held.held(data, offsets)
            got |= set(zip((rows + at).tolist(), which.tolist()))
            at += part.num_rows
        assert got == {(i, j) for i, t in enumerate(texts) if t for j, p in enumerate(patterns) if p in t}


def test_many_places_of_one_window():
    held = occurrences.Patterns([b"a" * 9, b"a" * 8 + b"b", b"a" * 300])
    data = np.frombuffer(b"a" * 200 + b"b" + bytes(16), np.uint8)
    assert held.held(data, np.array([0, 200, 201]))[1].tolist() == [0]
    assert held.held(data, np.array([0, 201, 201]))[1].tolist() == [0, 1]


@pytest.mark.parametrize("size", [4 << 20, 8])
def test_holding(spark, monkeypatch, size):
    monkeypatch.setattr(occurrences, "BLOCK_BYTES", size)
    documents = spark.createDataFrame([(1, "one two"), (2, "two"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "two"), (2, "two"), (3, "one two"), (4, ""), (5, None), (6, "o"), (7, "absent")], "id long, p string")
    found = occurrences.holding(documents, asked, "p", "text", "doc_id")
    assert sorted((r.id, r.doc_id) for r in found.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (6, 1), (6, 2)]
    assert occurrences.holding(documents, asked.where("false"), "p", "text", "doc_id").count() == 0


def test_queries_store_no_trigrams(spark, monkeypatch):
    """Anchors, names and substrings are found in one pass; an index of all trigrams grows past the texts."""

    def refused(*_, **__):
        raise AssertionError("an index of all trigrams")

    monkeypatch.setattr(substring_index, "index", refused)
    at = "/root/testdata/sf0.001"
    assert rq.substring_hits(spark, at).count() == 4
    assert rq.truth(spark, at).count() > 0
    assert rq.anchor_validation(spark, at).count() > 0
    rule_queries.cross_mentions(spark, at).collect()
    documents = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert evaluate.anchored(documents, spark.createDataFrame([(7, "two")], "q long, anchor string"), "doc_id", "q").count() == 1
