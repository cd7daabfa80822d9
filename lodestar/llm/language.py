"""Language identification by error-correcting output codes.

Each language has a codeword of -1 and 1. For every bit a binary classifier over hashed character n-grams (1 to 4 bytes
of the lower-cased text, letters only) predicts that bit. Decoding is loss-weighted: a language's distance is the sum over
the bits of the logistic loss of the margin, weighted by how well that bit's classifier did on the language in training;
the nearest codeword wins. Where the second one is nearly as near, the prediction is flagged ambiguous.

The classifiers are fitted on a bounded sample of labelled rows: of each language the same number, ``sample_rows`` in all,
and of a language with fewer rows all of them; every language that occurs has one at least, so with more languages than
``sample_rows`` the bound is one row a language. The rows' n-grams are counted by Spark over whole texts.

Defined results. A null text or one without a letter is ``und`` with score 0. Without any labelled row every prediction
is ``und``; with one language every lettered text is that language. Ties go to the language that is first in order.
Repeated rows are predicted each. Only ``doc_id`` and ``text`` are read for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textkernel import _flat, pieces

DIM = 4096
#: Bytes that are folded before n-grams are taken: capitals to small letters, other ASCII to one space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


class Codes(NamedTuple):
    languages: list[str]
    words: np.ndarray  # language x bit, -1 or 1
    trust: np.ndarray  # language x bit, rows sum to 1
    weights: np.ndarray  # DIM x bit
    bias: np.ndarray


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """All dichotomies of up to 6 languages; else the random dense code of best least distance among 200 tries."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = np.array([[1 if i == 0 or not b >> (i - 1) & 1 else -1 for b in range(1, 1 << (n - 1))] for i in range(n)])
        return bits.astype(float)
    random, best, far = np.random.default_rng(seed), None, -1
    length = int(np.ceil(12 * np.log2(n)))
    for _ in range(200):
        code = random.choice([-1.0, 1.0], (n, length))
        apart = (length - code @ code.T) / 2 + length * np.eye(n)
        if (np.abs(code.sum(axis=0)) < n).all() and apart.min() > far:
            best, far = code, apart.min()
    return best


def features(texts: pa.Array) -> np.ndarray:
    """A row of square-rooted, normalised n-gram counts for each text."""
    data, offsets = _flat(texts)
    n = len(offsets) - 1
    out = np.zeros(n * DIM)
    at = 0
    while at < n:  # texts of about a million bytes at once; one longer text in windows that overlap
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), "right")) - 1)
        begin, end = int(offsets[at]), int(offsets[to])
        for a in range(begin, max(end, begin + 1), 1 << 20):
            b = min(end, a + (1 << 20))
            if b > a:
                _count(_FOLD[data[a : min(end, b + 3)]].astype(np.uint64), np.searchsorted(offsets, np.arange(a, min(end, b + 3)), "right") - 1, b - a, out)
        at = to
    out = np.sqrt(out.reshape(n, DIM))
    return (out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)


def _count(b: np.ndarray, row: np.ndarray, n: int, out: np.ndarray) -> None:
    code, low = np.zeros(len(b), np.uint64), int(row[0])
    for size in (1, 2, 3, 4):
        code = code[: len(b) - size + 1] * np.uint64(257) + b[size - 1 :]
        k = min(n, len(code))
        slot = ((code[:k] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
        same = row[:k] == row[size - 1 : size - 1 + k]
        place = ((row[:k] - low) * DIM + slot.astype(np.int64))[same]
        counted = np.bincount(place)
        out[low * DIM : low * DIM + len(counted)] += counted


def _sample(documents: DataFrame, rows: int) -> tuple[np.ndarray, list[str]]:
    known = documents.where("lang is not null and text is not null and doc_id is not null").select(F.col("text").cast("string").alias("text"), "lang", F.xxhash64("doc_id", "text").alias("h"))
    total = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # a row a language
    if not total:
        return np.zeros((0, DIM)), []
    each = max(1, rows // len(total))
    # a cut that leaves about four times as many as are wanted; then the first by hash, repeated rows once
    cuts = known.sparkSession.createDataFrame([(lang, min(1.0, 4 * max(each, 25) / n)) for lang, n in total.items()], "lang string, share double")
    chance = F.pmod("h", F.lit(1 << 40)) / (1 << 40)
    some = known.select("lang", "h").join(F.broadcast(cuts), "lang").where(chance <= F.col("share")).select("lang", "h").distinct()
    first = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    wanted = some.withColumn("no", first).where(F.col("no") <= each).select(F.col("lang").alias("of"), F.col("h").alias("wanted"))
    chosen = known.join(F.broadcast(wanted), (F.col("h") == F.col("wanted")) & (F.col("lang") == F.col("of")))  # max(rows, languages) rows at most
    chosen = chosen.groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    table = chosen.mapInArrow(run, "lang string, x binary").toArrow()
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(-1, DIM)
    return x, table.column("lang").to_pylist()


def fit(documents: DataFrame, sample_rows: int = 2000, rounds: int = 150, penalty: float = 1e-5) -> Codes | None:
    """``documents``: ``doc_id``, ``text``, ``lang`` of the rows to learn from. ``sample_rows`` bounds the sample (the
    driver holds 16 KB a row)."""
    x, lang = _sample(documents, sample_rows)
    languages = sorted(set(lang))
    if not languages:
        return None
    code = codewords(len(languages))
    who = np.array([languages.index(v) for v in lang])
    if len(languages) == 1:
        return Codes(languages, code, np.ones((1, 1)), np.zeros((DIM, 1)), np.zeros(1))
    y = code[who].astype(np.float32)
    mean = x.mean(axis=0)
    x = x - mean
    w, b, vw, vb = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), 0.0, 0.0
    balance = (1 / np.bincount(who)[who] / len(languages)).astype(np.float32)[:, None]
    for _ in range(rounds):  # logistic loss, gradient descent with momentum
        g = -y * balance / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        vw = 0.9 * vw + (x.T @ g + penalty * w)
        vb = 0.9 * vb + g.sum(axis=0)
        w, b = w - 8 * vw, b - 8 * vb
    right = (np.sign(x @ w + b) == y).astype(float)
    trust = np.stack([right[who == i].mean(axis=0) for i in range(len(languages))]) + 1e-3
    return Codes(languages, code, trust / trust.sum(axis=1, keepdims=True), w, b - mean @ w)


def decode(margins: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest language, its share of the likelihood, and the second's distance over the nearest's."""
    loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * codes.words[None, :, :], -30, 30)))
    distance = (codes.trust[None, :, :] * loss).sum(axis=2)
    best = distance.argmin(axis=1)
    likely = np.exp(-codes.words.shape[1] * (distance - distance.min(axis=1, keepdims=True)))
    near = np.sort(distance, axis=1)
    second = near[:, 1] if near.shape[1] > 1 else np.full(len(near), np.inf)
    return best, (likely.max(axis=1) / likely.sum(axis=1)), second - near[:, 0]


def predict(documents: DataFrame, codes: Codes | None, ambiguous_within: float = 0.1) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``ambiguous`` for every row."""
    lettered = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"), lettered.alias("lettered"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, known = batch.num_rows, batch.column("lettered").to_numpy(zero_copy_only=False)
            lang, score, close = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            if codes is not None:
                best, share, gap = decode(features(batch.column("text")) @ codes.weights + codes.bias, codes)
                lang[known] = np.array(codes.languages, object)[best[known]]
                score[known], close[known] = share[known], gap[known] < ambiguous_within
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return texts.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, lang_pred string, score double, ambiguous boolean")
