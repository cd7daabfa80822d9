"""Runs that can be taken up again: each stage's table is stored under the run's id and all that it depends on.

A stage is known by its name, its parameters, the state of the input files, and the stages before it. What is known so and was
written to its end is read; all else is made. A run that broke between two stages, or within one, thus goes on where it was,
and a changed input or parameter is never served what an earlier state gave.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.operators.tables import run_path

from .shared import fingerprint


class Run:
    """A run in ``folder`` under ``run_id``; ``inputs`` are the files that it reads, ``parameters`` what else decides its rows."""

    def __init__(self, spark: SparkSession, folder: str, run_id: str, inputs: list[str], parameters: dict | None = None):
        self.spark, self.path = spark, run_path(folder, run_id)
        self._of = hashlib.sha256(json.dumps([fingerprint(spark, *inputs), parameters or {}], sort_keys=True).encode()).hexdigest()
        self.made: list[str] = []
        self.read: list[str] = []

    def stage(self, name: str, make: Callable[[], DataFrame], parameters: dict | None = None) -> DataFrame:
        """The stage's table: read if it is there to its end, else made and written. Stages are known by those before them, in
        the order in which they are asked for."""
        self._of = hashlib.sha256(json.dumps([self._of, name, parameters or {}], sort_keys=True).encode()).hexdigest()
        final = f"{self.path}/{name}-{self._of[:32]}"
        jvm = self.spark._jvm.org.apache.hadoop.fs
        fs = jvm.Path(final).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(jvm.Path(final)):
            self.read.append(name)
        else:
            draft = f"{self.path}/.{uuid.uuid4().hex}"
            make().write.parquet(draft)
            # the rename is the mark of completion; who comes second reads the first one's rows
            if not fs.exists(jvm.Path(final)) and fs.rename(jvm.Path(draft), jvm.Path(final)):
                self.made.append(name)
            else:
                fs.delete(jvm.Path(draft), True)
                self.read.append(name)
        return self.spark.read.parquet(final)
