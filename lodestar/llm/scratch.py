"""Tables that outlive lost executors: Parquet in the folder that all nodes share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.sources.shared import keep as save
from lodestar.sources.shared import shared_dir

__all__ = ["drop", "own_columns", "save", "shared_dir"]


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by name, also where a name holds a dot."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def drop(saved: DataFrame) -> None:
    """Delete what :func:`save` wrote, once no plan reads it any more."""
    spark = saved.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in saved.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
