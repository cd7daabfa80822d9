"""A table that is changed bucket by bucket: rows lie in hash buckets of their document, and a manifest names the files of each.

A change reads and writes only the buckets that its documents fall in, into a folder of its own version; then a manifest is put
in place by one rename. Readers take the newest manifest, so a write that fails, or that has not ended, is not seen, and what
was read before stays readable. Two writers of one version cannot both put theirs: the second one's is refused.

Old versions' files stay until :func:`vacuum`. A null document key is in a bucket like any other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "__bucket"


class State(NamedTuple):
    version: int
    document: list[str]
    buckets: int
    schema: str
    held: dict[int, int]  # bucket: version whose folder has its rows


class Conflict(RuntimeError):
    """Another writer has put the version."""


def _fs(spark: SparkSession, path: str):
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    return of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def _bucket(document: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*document), F.lit(buckets)).cast("int")


def _put(spark: SparkSession, path: str, state: State) -> None:
    text = json.dumps(state._asdict() | {"held": {str(b): v for b, v in state.held.items()}})
    draft, final = f"{path}/manifests/.{uuid.uuid4().hex}", f"{path}/manifests/{state.version:09d}.json"
    fs, at = _fs(spark, draft)
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()
    to = _fs(spark, final)[1]
    if fs.exists(to) or not fs.rename(at, to):
        fs.delete(at, False)
        raise Conflict(f"version {state.version} of {path} is there already")


def state(spark: SparkSession, path: str) -> State | None:
    """The newest state, or None where there is no table."""
    fs, at = _fs(spark, f"{path}/manifests")
    if not fs.exists(at):
        return None
    names = sorted(f.getPath().toString() for f in fs.listStatus(at) if f.getPath().getName().endswith(".json"))
    if not names:
        return None
    told = json.loads("\n".join(r.value for r in spark.read.text(names[-1], wholetext=True).collect()))
    return State(**(told | {"held": {int(b): v for b, v in told["held"].items()}}))


def read(spark: SparkSession, path: str, of: State | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The table's rows, of the newest state or a given one, of all buckets or some."""
    at = of or state(spark, path)
    if at is None:
        raise FileNotFoundError(path)
    files = [f"{path}/data/v{v}/{BUCKET}={b}" for b, v in sorted(at.held.items()) if buckets is None or b in buckets]
    return spark.read.schema(at.schema).parquet(*files) if files else spark.createDataFrame([], at.schema)


def _write(rows: DataFrame, path: str, version: int, document: list[str], buckets: int) -> list[int]:
    """Writes the rows and returns their buckets, of which there are at most ``buckets``."""
    folder = f"{path}/data/v{version}"
    keyed = rows.withColumn(BUCKET, _bucket(document, buckets))
    # a bucket's rows are dealt to some tasks, so that a hot document is no single one's
    keyed.repartition(BUCKET, F.pmod(F.monotonically_increasing_id(), F.lit(4))).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
    fs, at = _fs(rows.sparkSession, folder)
    return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at) if f.getPath().getName().startswith(BUCKET))


def create(rows: DataFrame, path: str, document: list[str], buckets: int = 64) -> State:
    """A table of ``rows``. ``document`` names the columns by which rows are dealt to buckets."""
    spark = rows.sparkSession
    if state(spark, path) is not None:
        raise Conflict(f"{path} is there already")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    made = State(1, document, buckets, schema, {b: 1 for b in _write(rows, path, 1, document, buckets)})
    _put(spark, path, made)
    return made


def change(spark: SparkSession, path: str, documents: DataFrame, made: Callable[[DataFrame], DataFrame]) -> State:
    """``made(old)`` in place of ``old``, the rows of all buckets that ``documents`` (the document columns) fall in; other
    buckets' files are neither read nor written. ``made`` must not move a row to another document."""
    old = state(spark, path)
    if old is None:
        raise FileNotFoundError(path)
    touched = [r.b for r in documents.select(_bucket(old.document, old.buckets).alias("b")).distinct().collect()]  # ``buckets`` rows at most
    if not touched:
        return old
    version = old.version + 1
    rows = made(read(spark, path, old, touched)).selectExpr(*(f"`{c}`" for c in read(spark, path, old, []).columns))
    written = _write(rows, path, version, old.document, old.buckets)
    held = {b: v for b, v in old.held.items() if b not in touched} | {b: version for b in written}
    new = old._replace(version=version, held=held)
    _put(spark, path, new)
    return new


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> State:
    """Rows of ``new`` in place of those with their keys, or beside them."""
    return change(spark, path, new, lambda old: old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new))


def replace_documents(spark: SparkSession, path: str, new: DataFrame) -> State:
    """Documents cut anew: all old rows of the documents in ``new`` go, a longer old tail too, and its rows come."""
    at = state(spark, path)
    return change(spark, path, new, lambda old: old.join(new.select(*at.document).distinct(), at.document, "left_anti").unionByName(new))


def set_columns(spark: SparkSession, path: str, values: DataFrame, keys: list[str], columns: list[str]) -> State:
    """New values of some columns (new vectors) by key; all else stays. ``values`` has the document columns, the keys and the columns."""
    from lodestar.operators.tables import re_embedded

    key = F.struct(*keys)

    def made(old: DataFrame) -> DataFrame:
        keyed, new = old.withColumn("__key", key), values.select(key.alias("__key"), *columns)
        return re_embedded(keyed, new, "__key", columns)

    return change(spark, path, values, made)


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes what only states before the newest one name. No reader of an older state may be left."""
    now = state(spark, path)
    kept = {f"v{v}" for v in now.held.values()}
    fs, at = _fs(spark, f"{path}/data")
    for version in fs.listStatus(at):
        name = version.getPath().getName()
        if name not in kept and int(name[1:]) <= now.version:
            fs.delete(version.getPath(), True)
        elif name in kept:
            for bucket in fs.listStatus(version.getPath()):
                b = bucket.getPath().getName()
                if b.startswith(BUCKET) and now.held.get(int(b.split("=")[1])) != int(name[1:]):
                    fs.delete(bucket.getPath(), True)
    fs, at = _fs(spark, f"{path}/manifests")
    for f in fs.listStatus(at):
        if f.getPath().getName() != f"{now.version:09d}.json":
            fs.delete(f.getPath(), False)
