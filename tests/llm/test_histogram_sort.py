import collections

from pyspark.sql import functions as F

from lodestar.llm import histogram_sort as H


def check(df, shards, near=None):
    rows = H.assign(df, shards).collect()
    by = collections.defaultdict(list)
    size = collections.Counter()
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 16 and 0 <= r.shard < shards
        by[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    if near:
        assert max(size.values()) - min(size[i] for i in range(shards)) <= near
    return rows


def test_near_equal_bytes(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("text"), F.lit(1).alias("size"))
    assert len(check(df, 7, near=400)) == 3000


def test_hot_text_and_hot_row_are_cut(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1200, 5).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 1500, "same").otherwise(F.col("id").cast("string")).alias("text"))
    check(df, 5, near=100)


def test_carries_what_is_asked_after_a_shuffle(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("x").alias("shard"), F.lit(1).alias("a.b")).repartition(7)
    rows = H.assign(df, 3, carry=["doc_id", "a.b"])
    assert rows.columns == ["doc_id", "a.b", "size", "shard", "slot"] and rows.count() == rows.select("shard", "slot").distinct().count() == 400


def test_edges(spark):
    assert H.assign(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0
    rows = check(spark.createDataFrame([(1, None), (None, ""), (None, ""), (2, "x")], "doc_id long, text string"), 4)
    assert len(rows) == 4
    assert "Python" not in H.assign(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 2)._jdf.queryExecution().toString()


def test_write_shards(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    H.write_shards(H.assign(df, 3), f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 50


def test_rows_that_share_text_and_id_and_clashing_names(spark):
    rows = [(7, "same text")] * 3000 + [(i, f"text {i}") for i in range(500)] + [(9, None), (9, None), (10, "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, size int, shard int, slot int").repartition(5)
    got = H.assign(df, shards=7).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((a, b or "") for a, b in rows)
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r["size"] == len((r.text or "").encode()) + 16
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_splitters_equal_a_sorted_list(spark):
    """Boundaries against exact prefix sums over all keys in order."""
    df = spark.createDataFrame([(i % 40, "w" * (i * 37 % 400)) for i in range(700)], "doc_id long, text string").repartition(3)
    keys = H._keys(df).select("__k0", "__k1", "__k2", "__size")
    rows = keys.select(F.array(*(H._digit(i).cast("int") for i in range(H.LEVELS))).alias("digits"), "__size").collect()
    ordered, total = sorted((tuple(r.digits), r["__size"]) for r in rows), sum(r["__size"] for r in rows)
    cuts, shards = H.splitters(keys, 9, 0.001), 9
    largest = max(size for _, size in ordered)
    for target, cut in enumerate(cuts, start=1):
        below = sum(size for digits, size in ordered if digits < cut)
        assert abs(below - total * target / shards) <= max(0.001 * total / shards, largest / 2) + 1
