"""The folder that all nodes share, for tables that a later step reads again."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a temporary one if driver and tasks are one
    process, as in tests; on a cluster that is an error, since no other node would see the files."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="lodestar-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return f"file://{_local[0]}"


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Names, sizes and times of all files under the paths, as a digest: another one as soon as a file is written anew."""
    conf, told = spark.sparkContext._jsc.hadoopConfiguration(), []
    for named in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(named)
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            told.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(told)).encode()).hexdigest()[:32]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: cuts the lineage, and later passes read it instead of computing it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
