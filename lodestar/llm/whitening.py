"""Whitening of embeddings by Chan merging.

Entries are scaled and floored to whole numbers; equal vectors count once. Each partition computes count, exact sums, local
mean and scatter around that mean, and two such summaries merge by Chan's formula in a tree of reductions, so nothing
is subtracted from large raw moments and the driver gets a few summaries of d x d numbers. The eigenvectors of the
covariance follow on the driver; a second pass over the distinct vectors merges the whitened columns' covariance in the same
way and tells how far it is from the identity.

Defined results. Rows whose vector is null or holds a null or non-finite entry are dropped; all others return. The commonest
length of the distinct vectors is the dimension (of several the longest); vectors of another length, empty ones too, have no
part in the fit and null measures. An entry whose scaled value does not fit in 53 bits is taken as the nearest that does. A
component without variance (copies of one vector, fewer vectors than dimensions) has a null ``whitened``, and ``explained``
is null if no component has any; ``identity_error`` is over components with variance, 0 without them. ``deviation`` is null where it does
not fit in a long. An eigenvector's largest entry is positive; components of equal variance may be any orthogonal ones, the
same for all rows. Repeated rows are returned each. Only the id and vector columns are read. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import save

_LARGEST = (1 << 53) - 1
_ROWS = 4096  # rows of a matrix in a task
_FAN = 8  # summaries that meet in a step of the tree, about


class Summary(NamedTuple):
    """Of a set of vectors: how many, exact sums, mean, and the scatter around the mean."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray


def summary(x: np.ndarray) -> Summary:
    mean = x.mean(axis=0)
    centred = x - mean
    # sums of whole numbers are exact in halves of 32 bits, whatever their size
    whole = x.astype(np.int64)
    low, high = (whole & 0xFFFFFFFF).sum(axis=0), (whole >> 32).sum(axis=0)
    return Summary(len(x), [(int(h) << 32) + int(lo) for h, lo in zip(high, low, strict=True)], mean, centred.T @ centred)


def merge(a: Summary, b: Summary) -> Summary:
    """Chan, Golub and LeVeque: the scatter of a union from the scatters and the difference of the means."""
    n, d = a.n + b.n, b.mean - a.mean
    return Summary(n, [x + y for x, y in zip(a.sums, b.sums, strict=True)], a.mean + d * (b.n / n), a.scatter + b.scatter + np.outer(d, d) * (a.n * b.n / n))


class Whitening(NamedTuple):
    """A fitted transform: ``components`` has a unit eigenvector a row, ``variances`` their eigenvalues, ``total`` the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Whitened columns of the vectors in the rows of ``x``; nan for a component without variance."""
        scale = np.sqrt(np.where(self.variances > 0, self.variances, np.nan))
        return (x - self.mean) @ self.components.T / scale


def _matrix(vectors: pa.Array, d: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), d)


def whole_vectors(embeddings: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """The rows whose vector is whole, with ``x``: floors of the scaled entries."""
    entry = F.col(column)
    fits = entry.isNotNull() & F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    floors = F.transform(entry, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(_LARGEST))), F.lit(float(-_LARGEST)))).cast("long"))
    return embeddings.where(F.coalesce(fits, F.lit(False))).withColumn("x", floors)


def _reduced(vectors: DataFrame, d: int, transform: Whitening | None = None) -> Summary:
    """The merged summary of all rows of ``x``, or of their whitened columns; one row at least."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                x = _matrix(batch.column("x").slice(at, _ROWS), d).astype(np.float64)
                if transform is not None:
                    x = transform(x)[:, transform.variances > 0]
                own = summary(x) if transform is None else summary(x)._replace(sums=[])
                held = own if held is None else merge(held, own)
        if held is not None:
            rows = ([held.n], [[str(s) for s in held.sums]], [held.mean], [held.scatter.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], ["n", "sums", "mean", "scatter"])

    partial = vectors.select("x").mapInArrow(local, "n long, sums array<string>, mean array<double>, scatter array<double>").rdd
    whole = partial.map(lambda r: Summary(r.n, [int(s) for s in r.sums], np.array(r.mean), np.array(r.scatter).reshape(len(r.mean), -1)))
    depth = max(2, ceil(log(max(2, whole.getNumPartitions()), _FAN)))
    return whole.treeReduce(merge, depth)


def fit(vectors: DataFrame, components: int | None = None) -> tuple[Whitening | None, float]:
    """The transform of the distinct rows of ``x`` (see :func:`whole_vectors`) with the first ``components`` components, all
    if None; and its error, the largest entry of the whitened columns' covariance minus the identity. None without vectors."""
    distinct = save(vectors.where(F.size("x") > 0).select("x").distinct(), "distinct")
    common = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return None, 0.0
    chosen = distinct.where(F.size("x") == common.d)
    told = _reduced(chosen, common.d)
    variances, vectors_ = np.linalg.eigh(told.scatter / told.n)
    order = np.argsort(-variances, kind="stable")
    variances, rows = variances[order], vectors_.T[order]
    rows = rows * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])[:, None]
    # what rounding leaves of a variance of nought
    variances = np.where(variances > max(variances[0], 0) * common.d * 1e-13, variances, 0)
    kept = slice(0, components)
    out = Whitening(told.n, told.sums, rows[kept], variances[kept], float(np.trace(told.scatter) / told.n))
    some = int((out.variances > 0).sum())
    if not some:
        return out, 0.0
    after = _reduced(chosen, common.d, out)
    return out, float(np.abs(after.scatter / after.n - np.eye(some)).max())


def _deviations(x: np.ndarray, of: Whitening) -> list[int | None]:
    """Sum over dimensions of ``(n * x - sum) ** 2``, exact."""
    largest = max((abs(s) for s in of.sums), default=0) + of.n * int(np.abs(x).max(initial=0))
    if largest * largest * x.shape[1] < 1 << 63:
        return ((of.n * x - np.array(of.sums, np.int64)) ** 2).sum(axis=1).tolist()
    found = ((of.n * x.astype(object) - np.array(of.sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in found]


def whiten(vectors: DataFrame, transform: Whitening | None, key: str = "vec_id") -> DataFrame:
    """``key``, ``whitened`` (a value a component) and ``deviation`` of every row; null where the length is another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = transform.components.shape[1] if transform else -1
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                fits = np.flatnonzero(batch.column("x").value_lengths().to_numpy(zero_copy_only=False) == d)
                deviation, white = [None] * batch.num_rows, [None] * batch.num_rows
                if len(fits):
                    x = _matrix(batch.column("x").take(pa.array(fits)), d)
                    for i, dev, row in zip(fits.tolist(), _deviations(x, transform), transform(x.astype(np.float64)).tolist(), strict=True):
                        deviation[i], white[i] = dev, [v if v == v else None for v in row]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(white, pa.list_(pa.float64())), pa.array(deviation, pa.int64())], [key, "whitened", "deviation"])

    return vectors.select(key, "x").mapInArrow(run, f"{key} {dict(vectors.dtypes)[key]}, whitened array<double>, deviation long")


def by_component(white: DataFrame, transform: Whitening | None, error: float, components: int, key: str = "vec_id") -> DataFrame:
    """One row a vector and component: ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained`` (share of the
    variance) and ``identity_error``."""
    n, total = (transform.n, transform.total) if transform else (0, 0.0)
    shares = [float(v / total) if total > 0 else None for v in transform.variances] if transform else [None] * components
    explained = F.array(*(F.lit(s).cast("double") for s in shares))
    rows = white.withColumn("component", F.explode(F.sequence(F.lit(1), F.lit(len(shares)))))
    at = lambda values: F.get(values, F.col("component") - 1)
    return rows.select(key, "component", F.lit(n).cast("long").alias("n"), "deviation", at(F.col("whitened")).alias("whitened"), at(explained).alias("explained"), F.lit(error).alias("identity_error"))
