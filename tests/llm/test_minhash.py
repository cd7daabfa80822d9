import itertools
import random

import numpy as np
import pytest

from lodestar.llm import minhash


def brute(texts: dict, size: int, percent: int = 80):
    sets = {}
    for k, t in texts.items():
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(sets[k]), find(k)) for k in texts}


def corpus():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, n = {}, 0
    for length in (3, 6, 12, 60, 200):
        for _ in range(4):
            base = [r.choice(vocabulary) for _ in range(length)]
            for edits in (0, 0, 1, 2, 4, 8, length // 4):
                copy = list(base)
                for _ in range(edits):
                    copy[r.randrange(length)] = r.choice(vocabulary)
                texts[n] = " ".join(copy)
                n += 1
    base = [r.choice(vocabulary) for _ in range(120)]
    for _ in range(150):  # one large group with edits of its own in each copy
        copy = list(base)
        for _ in range(r.randrange(9)):
            copy[r.randrange(120)] = r.choice(vocabulary)
        texts[n] = " ".join(copy)
        n += 1
    for t in (None, "", " \n", "one", "ONE", "one two"):
        texts[n] = t
        n += 1
    return texts


@pytest.mark.parametrize("size", [2, 5])
def test_equals_brute_force(spark, size):
    texts = corpus()
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "doc_id long, text string, component_id long, band string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df.repartition(5), size).collect()}
    assert got == {k: (n, c, c == k) for k, (n, c) in brute(texts, size).items()}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)]
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 2, True)], key=str)


def test_keep_one_carries_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, "x", 9)], "doc_id long, text string, `kept.x` int")
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_keep_one_knows_rows_by_text(spark):
    rows = [(1, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "other words of its own"), (5, None), (7, "k l m n o p q"), (7, "K L M N O P Q"), (7, "k l m n o p q")]
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], rows[3], rows[4], rows[5], rows[6]], key=str)


def test_estimate_is_near():
    r = np.random.default_rng(1)
    shared, a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (4000, 500, 500))
    sets = [np.concatenate([shared, a]), np.concatenate([shared, b])]
    regs = minhash.registers(np.repeat([0, 1], [len(s) for s in sets]), np.concatenate(sets), 2)
    j = minhash.estimate(regs[:1], regs[1:], np.array([4500]), np.array([4500]))[0]
    assert abs(j - 0.8) < minhash.SLACK


def test_very_long_texts(spark):
    r = random.Random(17)
    long = [f"w{r.randrange(30_000)}" for _ in range(300_000)]
    near = list(long)
    for i in range(0, len(near), 300):
        near[i] = "edited"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long)), (4, "w1 " * 400_000), (5, "w1 " * 300_000 + "w2"), (6, " ".join(reversed(long)))]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=5).collect()}
    assert got == brute(dict(rows), 5)
