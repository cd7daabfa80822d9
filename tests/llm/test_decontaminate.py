import time

import numpy as np

from lodestar.llm import decontaminate as D

ITEM = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree"


def seeds(item, text, least):
    windows = lambda x: [tuple(x[i : i + least]) for i in range(len(x) - least + 1)]
    a, b = windows(item.tolist()), windows(text.tolist())
    return np.array([i for i, w in enumerate(a) if w in set(b)], np.int64), np.array([j for j, w in enumerate(b) if w in set(a)], np.int64)


def plain_tiles(item, text, least):
    """The longest open match again and again, first of the item and then of the text."""
    used_item, used_text, out = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and i + n not in used_item and j + n not in used_text:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        used_item.update(range(i, i + n))
        used_text.update(range(j, j + n))


def test_tiles_are_greedy_and_disjoint():
    item, text = np.array([1, 2, 3, 4, 5, 6, 7, 8], np.uint64), np.array([5, 6, 7, 8, 9, 1, 2, 3, 4, 5], np.uint64)
    assert sorted(D.tiles(item, text, *seeds(item, text, 2), 2)) == [(0, 5, 5), (5, 1, 3)]


def test_tiles_equal_a_plain_search():
    r = np.random.default_rng(5)
    for n in range(120):
        item, text = (r.integers(0, 2 + n % 5, r.integers(1, 30), dtype=np.uint64) for _ in range(2))
        least = 1 + n % 4
        assert D.tiles(item, text, *seeds(item, text, least), least) == plain_tiles(item, text, least)


def test_repeated_word_is_no_product():
    item, text = np.full(1000, 7, np.uint64), np.full(1_000_000, 7, np.uint64)
    began = time.time()
    assert D.tiles(item, text, np.arange(996), np.arange(999_996), 5) == [(0, 0, 1000)]
    assert time.time() - began < 10


def coverage(spark, docs, items=((1, ITEM),), **options):
    d = spark.createDataFrame([(i, t, 5) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.leaks(d, b, **options).collect()}


def test_finds_reordered_and_leaves_others(spark):
    halves = ITEM.split(" while ")
    docs = [f"before {ITEM} after", f"x {halves[1].upper()}, y; {halves[0]} z", "nothing of it", None, "", "the quick brown fox jumps", " ".join(reversed(ITEM.split()))]
    found = coverage(spark, docs)
    assert sorted(found) == [(0, 1), (1, 1)]
    whole = found[(0, 1)]
    assert whole.coverage == 1 and [(s.start, s.end) for s in whole.spans] == [(7, 7 + len(ITEM))]
    assert found[(1, 1)].covered == len(ITEM.split()) - 1


def test_blocks_agree(spark):
    items = [(i, f"w{i} " + " ".join(f"q{i}{j}" for j in range(10))) for i in range(20)] + [(99, None), (98, "two words")]
    docs = [items[3][1], items[7][1] + " and " + items[8][1]]
    one, many = coverage(spark, docs, items), coverage(spark, docs, items, block_bytes=50)
    assert sorted(one) == sorted(many) == [(0, 3), (1, 7), (1, 8)]


def test_long_texts(spark):
    docs = ["again " * 200_000, "word " * 300_000 + ITEM + " word" * 300_000]
    found = coverage(spark, docs, [(1, ITEM), (2, "again " * 800), (3, "word " * 50 + ITEM)])
    assert sorted(found) == [(0, 2), (1, 1), (1, 3)] and all(r.coverage == 1 for r in found.values())


def test_empty(spark):
    assert coverage(spark, ["x"], [(1, None)]) == {}
    d = spark.createDataFrame([], "doc_id long, text string")
    assert D.leaks(d, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0


def test_remove(spark):
    d = spark.createDataFrame([(1, ITEM, "a"), (2, "fine", "b"), (2, "fine", "b")], "doc_id long, text string, coverage string")
    kept = D.remove(d, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2, 2]
    reused = spark.createDataFrame([(1, ITEM, "a"), (1, "fine", "b"), (None, ITEM, "c"), (None, None, "d")], d.schema)
    items = spark.createDataFrame([(1, ITEM), (2, "some other words that no text has")], "item_id long, text string")
    assert sorted(r.coverage for r in D.remove(reused, items, block_bytes=50).collect()) == ["b", "d"]
