import math
import random

import pyarrow as pa

from lodestar.llm import toxicity as X


def corpus(n=600):
    r = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        own = [r.choice(words) for _ in range(60)]
        kind = i % 6
        if kind == 0:
            own[5] = "grumble"  # alone harmless
        if kind == 1:
            own[9] = "folk"
        if kind == 2:
            own[5], own[40] = "grumble", "folk"  # only together
        docs.append((i, " ".join(own), 3))
        labels.append((i, int(kind == 2)))
    return docs, labels


def test_learns_pairs(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, label int")
    known = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, label int")
    machine = X.fit(d, known)
    scores = {r.doc_id: r.score for r in X.score(d, machine).collect()}
    held = [(scores[i], y) for i, y in labels if i % 5 == 0]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)
    kept = {r.doc_id for r in X.not_toxic(d, machine).collect()}
    assert all((i in kept) == (not y) for i, y in labels)


def test_learns_a_label_that_only_a_pair_decides(spark):
    r = random.Random(2)
    words = [f"word{i}" for i in range(900)]
    docs, labels = [], []
    for i in range(2000):  # either term is as common among toxic texts as among clean ones
        own = [r.choice(words) for _ in range(40)]
        a, b = r.random() < 0.5, r.random() < 0.5
        own += ["grumble"] * a + ["martians"] * b
        docs.append((i, " ".join(own)))
        labels.append((i, int(a == b)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    machine = X.fit(d, spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, label int"))
    scores = {x.doc_id: x.score for x in X.score(d, machine).collect()}
    held = [(scores[i] >= 0.5) == bool(y) for i, y in labels if i % 4 == 0]
    assert sum(held) / len(held) > 0.9


def test_sample_is_bounded(spark):
    long_text = " ".join(f"w{i}" for i in range(30_000))
    docs = spark.range(4000).selectExpr("cast(1 as long) as doc_id", "concat('text ', id) as text").union(spark.createDataFrame([(2, long_text), (3, "x y")], "doc_id long, text string"))
    known = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, label int")
    lists, y, _ = X._sample(docs, known, 3, 3, 1 << 20)
    assert sorted(y) == [0, 0, 1] and 30_000 <= max(map(len, lists)) < 200_000
    lists, y, _ = X._sample(docs, known, 3, 3, 4096)
    assert 1 in y and sum(map(len, lists)) <= 4096
    machine = X.fit(docs, known)
    assert X.score(docs, machine).where("score between 0 and 1").count() == 4002


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "x")], "doc_id long, text string")
    machine = X.fit(docs, none)
    got = X.score(docs, machine).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    one_kind = spark.createDataFrame([(1, 1), (3, 1), (None, 0), (2, None)], "doc_id long, label int")
    assert len(X.score(docs, X.fit(docs, one_kind)).collect()) == 5
    assert X.score(docs.where("false"), machine).count() == 0


def test_a_text_that_does_not_fit_ends_nothing(spark):
    r = random.Random(3)
    words = [f"word{i}" for i in range(50)]
    docs = [(i, " ".join([r.choice(words) for _ in range(20)] + ["grumble"] * (i % 2)), i % 2) for i in range(200)]
    giants = [(1000 + i, " ".join(f"g{i}x{j}" for j in range(20_000)), i % 2) for i in range(40)]
    fit = lambda rows: X.fit(spark.createDataFrame(rows, "doc_id long, text string, x int"), spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, label int"), sample_terms=60_000)
    alone, beside = fit(docs), fit(docs + giants)
    assert len(alone.terms) > 0 and set(alone.terms) == set(beside.terms)


def test_scores_equal_the_plain_formula(spark):
    docs, labels = corpus(200)
    docs += [(900, None, 0), (901, "", 0), (902, "grumble folk " * 5000, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, x int")
    machine = X.fit(d, spark.createDataFrame(labels, "doc_id long, label int"), least=2, strength=2.0)
    assert len(machine.terms) > 5
    place = {int(t): k for k, t in enumerate(machine.terms)}
    scores = {r.doc_id: r.score for r in X.score(d, machine).collect()}
    for doc, text, _ in docs:
        batch = pa.RecordBatch.from_pydict({"text": pa.array([text], pa.string())})
        own = sorted({place[int(t)] for t in X._terms(batch)[1] if int(t) in place})
        total = machine.bias + sum(machine.weights[i] for i in own)
        total += sum(float(machine.vectors[i] @ machine.vectors[j]) for n, i in enumerate(own) for j in own[n + 1 :])
        assert abs(scores[doc] - 1 / (1 + math.exp(-total))) < 1e-9


def test_all_interacting_terms_may_enter(spark):
    docs, labels = corpus()
    d, known = spark.createDataFrame(docs, "doc_id long, text string, label int"), spark.createDataFrame(labels, "doc_id long, label int")
    sizes = [len(X.fit(d, known, strength=1.5, interacting=n).terms) for n in (0, 3, None)]
    assert sizes[0] < sizes[1] <= sizes[0] + 3 < sizes[2]
