"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and the beginnings of longer ones, hashed. The machine gives each term a weight
and a short vector; two terms that occur in one text add the product of their vectors, so a pair such as an insult beside
a group's name counts where neither does alone.

Learning uses a sample of labelled rows, in order of a hash of their ids; ``positives``, ``negatives`` and ``sample_terms``
bound what comes to the driver: of either label no more rows, nor more distinct terms than half that number in all. A text
that does not fit in what is left of its label's half, or has over an eighth of it, is left out, and those after it are
not. Terms are gathered by Spark over whole texts, so a text is learned from as a whole, as it is scored, or not at all.
A term enters the machine in one of two ways: its shares among toxic and clean texts differ by ``strength`` standard
errors; or it interacts, i.e. what the machine of the former terms leaves unexplained goes along with the term's meeting
others. For that the leading directions of the sample's co-occurrences, weighted by what is left, are found by subspace
iteration on one half of the sample and each term is tested against them on the other half; of those that pass the
``interacting`` clearest enter, which bounds the machine's size, or all where it is None. A term that says nothing by
itself is thus kept if its pairs do. Scores are computed where the texts are.

Defined results. A null or empty text has no terms and gets the machine's bias as score. Labels that are null are left
out; of several labels of one document the highest counts; of several texts of one labelled ``doc_id`` the one with the
smallest hash is learned from. With no labelled rows of both kinds, every score is the share of the positive labels (0
with none). Repeated rows are scored each. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, save
from .textkernel import PUNCT, mix, pieces, prefixes, words

BITS = 24
PREFIXES = (4, 5, 6)
PIECE = 2 << 20  # bytes of text that a task hashes at a time
LARGEST = 8  # a text takes at most this part of its label's terms


class Machine(NamedTuple):
    terms: np.ndarray  # hashed ids, in order
    bias: float
    weights: np.ndarray
    vectors: np.ndarray


def _terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed id of every term, repeats included."""
    w = words(batch.column("text"), PUNCT)
    rows, hashes = [w.row], [w.hash]
    for n in PREFIXES:
        row, h = prefixes(w, n)
        rows.append(row)
        hashes.append(h)
    return np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows << BITS | ids)
    return both >> BITS, both & ((1 << BITS) - 1)


def _sample(documents: DataFrame, labels: DataFrame, positives: int, negatives: int, sample_terms: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Terms of each sampled text, its label, and how many labelled rows it stands for."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    total = {r.label: r.n for r in known.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [known.where(F.col("label") > 0 if y else F.col("label") <= 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", F.lit(y).alias("label")) for y, n in ((1, positives), (0, negatives))]
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(some[0].union(some[1])), "doc_id")  # positives + negatives rows at most
    key = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=PIECE):
            rows, ids = _distinct(*_terms(batch))
            at = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            terms = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), batch.column("label"), terms], ["doc_id", "hash", "label", "terms"])

    found = chosen.withColumn("hash", F.xxhash64("text")).mapInArrow(run, f"doc_id {key}, hash long, label int, terms array<int>")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("label", "terms"), "hash").alias("x")).select("doc_id", "x.*")
    gathered = save(one.withColumn("place", F.xxhash64("doc_id")), "sample")
    sizes = gathered.select("doc_id", "place", "label", F.size("terms").alias("n")).collect()  # positives + negatives rows at most
    left, fits = [sample_terms // 2] * 2, []
    for r in sorted(sizes, key=lambda r: (r.place, r.doc_id)):
        if r.n <= min(left[r.label], sample_terms // 2 // LARGEST):
            left[r.label] -= r.n
            fits.append((r.doc_id,))
    chosen = documents.sparkSession.createDataFrame(fits, f"doc_id {key}")
    table = gathered.join(F.broadcast(chosen), "doc_id").orderBy("place", "doc_id").select("label", "terms").toArrow()
    drop(gathered)
    y = table.column("label").to_numpy().astype(np.int64)
    lists = table.column("terms").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    del table
    seen = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    stands = np.array([total.get(int(k), 0) / seen[int(k)] for k in y], np.float64)
    return [flat[at[i] : at[i + 1]] for i in range(len(y))], y, stands


def fit(documents: DataFrame, labels: DataFrame, positives: int = 3000, negatives: int = 6000, sample_terms: int = 8_000_000, factors: int = 8, rounds: int = 300, least: int = 5, strength: float = 4.0, interacting: int | None = 512) -> Machine:
    """``labels``: ``doc_id``, ``label`` (above 0: toxic), already without the rows that must not be learned from.
    ``interacting``: how many terms may enter by their interactions, None for all that pass. The driver holds at most ``sample_terms`` terms of 4 bytes, and some copies of them."""
    lists, y, stands = _sample(documents, labels, positives, negatives, sample_terms)
    empty = np.zeros(0, np.int64)
    share = float((stands * y).sum() / stands.sum()) if len(y) else 0.0
    bias = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
    machine = Machine(empty, bias, np.zeros(0), np.zeros((0, factors)))
    if not len(y) or y.min() == y.max():
        return machine
    row = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    flat = np.concatenate(lists)
    del lists
    found = np.unique(flat)
    at = flat  # each term's place among those found, written over it part by part
    for part in _parts(len(flat)):
        at[part] = np.searchsorted(found, flat[part])
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    with_label = [np.bincount(at[(y == k)[row]], minlength=len(found)) for k in (0, 1)]
    often = with_label[0] + with_label[1]
    p = often / (n1 + n0)
    z = (with_label[1] / n1 - with_label[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    chosen = (often >= least) & (np.abs(z) >= strength)

    def trained(chosen: np.ndarray, rounds: int) -> tuple[Machine, np.ndarray]:
        place, mine = np.cumsum(chosen) - 1, chosen[at]
        machine = _train(row[mine], place[at[mine]], y, stands, bias, found[chosen].astype(np.int64), factors, rounds)
        score, _ = _forward(row[mine], place[at[mine]], len(y), machine.bias, machine.weights, machine.vectors)
        return machine, 1 / (1 + np.exp(-np.clip(score, -500, 500)))

    # what the terms that differ by themselves explain; a third of the rounds tells that well enough
    chance = trained(chosen, rounds // 3)[1] if chosen.any() else np.full(len(y), n1 / (n1 + n0))
    candidates = ~chosen & (often >= 4 * least) & (p <= 0.8)
    more = _interacting(row, at, candidates, y - chance, strength, interacting)
    return trained(chosen | more, rounds)[0] if (chosen | more).any() else machine


def _parts(n: int) -> list[slice]:
    """Slices that keep what numpy makes on the way small."""
    return [slice(i, i + (1 << 19)) for i in range(0, n, 1 << 19)]


def _sum_at(keys: np.ndarray, of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each key the sum of ``values[of]``."""
    out = np.zeros(n)
    for part in _parts(len(keys)):
        out += np.bincount(keys[part], weights=values[of[part]], minlength=n)
    return out


def _interacting(row: np.ndarray, col: np.ndarray, candidates: np.ndarray, left: np.ndarray, strength: float, most: int | None, directions: int = 4, steps: int = 8) -> np.ndarray:
    """Which of the candidate terms meet others where ``left``, a row's unexplained label, has a sign. One half of the rows
    gives the leading directions of the centred co-occurrences that ``left`` weights, the other half tests each term
    against them."""
    out = np.zeros(len(candidates), bool)
    place, d, n = np.cumsum(candidates, dtype=np.int32) - 1, int(candidates.sum()), len(left)
    if d < 2:
        return out
    second = mix(np.arange(n, dtype=np.uint64)) & np.uint64(1) == 1
    halves = []
    for own in (~second, second):
        mine = candidates[col] & own[row]
        halves.append((own, row[mine], place[col[mine]]))
    mean = sum(np.bincount(c, minlength=d) for _, _, c in halves) / n

    def along(half: tuple, u: np.ndarray) -> np.ndarray:
        own, r, c = half
        return np.stack([np.where(own, _sum_at(r, c, x, n) - mean @ x, 0) for x in u.T], axis=1)

    def across(half: tuple, told: np.ndarray) -> np.ndarray:
        return np.stack([_sum_at(half[2], half[1], x, d) - mean * x.sum() for x in told.T], axis=1)

    clear = np.zeros(d)
    for learn, test in (halves, halves[::-1]):
        weight = np.where(learn[0], left - left[learn[0]].mean(), 0)[:, None]
        u = np.linalg.qr(np.random.default_rng(13).normal(size=(d, min(directions, d))))[0]
        for _ in range(steps):
            u = np.linalg.qr(across(learn, weight * along(learn, u)))[0]
        own = test[0]
        told = np.where(own, left - left[own].mean(), 0)[:, None] * along(test, u)
        told -= np.where(own[:, None], told.sum(axis=0) / max(1, own.sum()), 0)
        squares = np.stack([_sum_at(test[2], test[1], x * x, d) for x in told.T], axis=1)
        spread = np.sqrt(np.maximum(squares * (1 - 2 * mean[:, None]) + mean[:, None] ** 2 * (told * told).sum(axis=0), 1e-12))
        clear = np.maximum(clear, (np.abs(across(test, told)) / spread).max(axis=1))
    best = np.argsort(-clear, kind="stable")[:most]
    out[np.flatnonzero(candidates)[best[clear[best] >= strength]]] = True
    return out


def _train(row: np.ndarray, col: np.ndarray, y: np.ndarray, stands: np.ndarray, bias: float, kept: np.ndarray, factors: int, rounds: int) -> Machine:
    """Adam over the whole sample: log loss, with a penalty on weights and vectors."""
    random = np.random.default_rng(11)
    n, d = len(y), len(kept)
    weight = stands / stands.sum()
    params = [np.array([bias]), np.zeros(d), random.normal(0, 0.05, (d, factors))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    order = np.argsort(col, kind="stable")
    for t in range(1, rounds + 1):
        b, w, v = params
        score, sums = _forward(row, col, n, b[0], w, v)
        g = weight * (1 / (1 + np.exp(-score)) - y)
        by_term = lambda x: _sum_by(col[order], x[order], d)
        gw = by_term(g[row]) + 2e-5 * w
        gv = _sum_by(col[order], g[row[order], None] * sums[row[order]], d) - v * by_term(g[row])[:, None] + 2e-5 * v
        for i, grad in enumerate((np.array([g.sum()]), gw, gv)):
            m, s = moments[i]
            m += 0.1 * (grad - m)
            s += 0.01 * (grad**2 - s)
            params[i] = params[i] - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return Machine(kept, float(params[0][0]), params[1], params[2])


def _sum_by(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by ``keys``, which are in order."""
    out = np.zeros((n, *values.shape[1:]))
    if len(keys):
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
        out[keys[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _forward(row: np.ndarray, col: np.ndarray, n: int, bias: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = _sum_by(row, v[col], n)
    return bias + _sum_by(row, w[col], n) + 0.5 * (sums**2 - _sum_by(row, v[col] ** 2, n)).sum(axis=1), sums


def _scores(batch: pa.RecordBatch, machine: Machine) -> np.ndarray:
    rows, ids = _terms(batch)
    if not len(machine.terms):
        return np.full(batch.num_rows, 1 / (1 + np.exp(-machine.bias)))
    col = np.minimum(np.searchsorted(machine.terms, ids), len(machine.terms) - 1)
    known = machine.terms[col] == ids
    rows, col = _distinct(rows[known], col[known])
    s, _ = _forward(rows, col, batch.num_rows, machine.bias, machine.weights, machine.vectors)
    return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def score(documents: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """``doc_id`` and the chance that label 1 holds, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=PIECE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch, machine))], ["doc_id", column])

    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, {column} double")


def not_toxic(documents: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents`` that score below ``threshold``; all columns, whole rows, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=PIECE):
            yield batch.filter(pa.array(_scores(batch, machine) < threshold))

    return documents.mapInArrow(run, documents.schema)
