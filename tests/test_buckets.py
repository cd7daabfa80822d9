import os

import pytest
from pyspark.sql import functions as F

from lodestar.sources import buckets as B

SCHEMA = "doc string, ordinal int, text string, vec array<double>"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


@pytest.fixture
def kept(spark, tmp_path):
    start = [(f"d{i}", k, f"t{i}.{k}", [float(i)]) for i in range(40) for k in range(3)] + [(None, 0, "none", None)]
    path = f"file://{tmp_path}/t"
    B.create(spark.createDataFrame(start, SCHEMA), path, ["doc"], buckets=16)
    return path, start


def test_only_touched_buckets_are_written(spark, tmp_path, kept):
    path, start = kept
    assert rows_of(B.read(spark, path)) == sorted(start, key=repr)
    before = files(tmp_path / "t")
    new = [("d3", 1, "new", [9.0]), ("d99", 0, "fresh", [1.0])]
    at = B.upsert(spark, path, spark.createDataFrame(new, SCHEMA), ["doc", "ordinal"])
    want = [r for r in start if r[:2] != ("d3", 1)] + new
    assert rows_of(B.read(spark, path)) == sorted(want, key=repr)
    after = files(tmp_path / "t")
    assert {f: t for f, t in after.items() if f in before} == before
    buckets = {r.b for r in spark.createDataFrame(new, SCHEMA).select(B._bucket(["doc"], 16).alias("b")).collect()}
    assert {int(f.split(f"{B.BUCKET}=")[1].split("/")[0]) for f in after if f not in before} == buckets and at.version == 2
    assert {b for b, v in at.held.items() if v == 2} == buckets


def test_documents_cut_anew_lose_their_tail(spark, kept):
    path, start = kept
    B.replace_documents(spark, path, spark.createDataFrame([("d5", 0, "whole", [0.0]), (None, 7, "x", None)], SCHEMA))
    left = rows_of(B.read(spark, path))
    assert [r for r in left if r[0] == "d5"] == [("d5", 0, "whole", [0.0])] and len(left) == 121 - 3 + 2
    # null equals no null: the old row of the null document stays beside the new one
    assert sorted(r[1] for r in left if r[0] is None) == [0, 7]


def test_vectors_are_set_in_place(spark, kept):
    path, start = kept
    values = spark.createDataFrame([("d1", 0, [7.0]), ("d1", 9, [8.0])], "doc string, ordinal int, vec array<double>")
    B.set_columns(spark, path, values, ["doc", "ordinal"], ["vec"])
    assert rows_of(B.read(spark, path)) == sorted([(*r[:3], [7.0]) if r[:2] == ("d1", 0) else r for r in start], key=repr)


def test_a_failed_write_leaves_the_old_state(spark, kept):
    path, start = kept
    broken = spark.createDataFrame([("d1", 0, "x", [1.0])], SCHEMA).withColumn("ordinal", F.raise_error("broken").cast("int"))
    with pytest.raises(Exception, match="broken"):
        B.change(spark, path, spark.createDataFrame([("d1",)], "doc string"), lambda old: old.unionByName(broken))
    assert rows_of(B.read(spark, path)) == sorted(start, key=repr) and B.state(spark, path).version == 1
    B.upsert(spark, path, spark.createDataFrame([("d1", 0, "y", [2.0])], SCHEMA), ["doc", "ordinal"])
    assert [r[2] for r in rows_of(B.read(spark, path)) if r[:2] == ("d1", 0)] == ["y"]


def test_readers_keep_their_version_and_writers_of_one_collide(spark, kept):
    path, start = kept
    old, held = B.state(spark, path), B.read(spark, path)
    B.upsert(spark, path, spark.createDataFrame([("d1", 0, "y", [2.0])], SCHEMA), ["doc", "ordinal"])
    assert rows_of(held) == sorted(start, key=repr) == rows_of(B.read(spark, path, old))
    with pytest.raises(B.Conflict):
        B._put(spark, path, old._replace(version=2))
    with pytest.raises(B.Conflict):
        B.create(held, path, ["doc"])
    want = rows_of(B.read(spark, path))
    B.vacuum(spark, path)
    assert rows_of(B.read(spark, path)) == want


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    none = spark.createDataFrame([], SCHEMA)
    B.create(none, path, ["doc"])
    assert B.read(spark, path).count() == 0 and B.upsert(spark, path, none, ["doc"]).version == 1
    with pytest.raises(FileNotFoundError):
        B.read(spark, f"file://{tmp_path}/nowhere")
    B.upsert(spark, path, spark.createDataFrame([("a", 1, "t", None)], SCHEMA), ["doc"])
    B.change(spark, path, spark.createDataFrame([("a",)], "doc string"), lambda old: old.where("false"))
    assert B.read(spark, path).count() == 0
