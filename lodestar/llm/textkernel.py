"""Word and shingle hashes of Arrow string columns, vectorised over the UTF-8 bytes.

A word is a run of bytes between separators. Its 64-bit hash is a polynomial over a fixed random table, taken as the
difference of a prefix sum, so a batch costs a few passes over its bytes and no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 21
_RANDOM = np.random.default_rng(20250101)
_TABLE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: ASCII white space: the separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
PUNCT = np.zeros(256, bool)
PUNCT[:128] = [not chr(b).isalnum() for b in range(128)]


class Words(NamedTuple):
    """One entry a word: row in the batch, hash, first byte and end in ``data``."""

    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` text bytes, one row at least, so memory follows that and not the batch."""
    for batch in batches:
        sizes = np.diff(_flat(batch.column(column))[1])
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, _BLOCK) + 1, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers[name]


def words(texts: pa.Array, separators: np.ndarray = SPACE, lower: bool = True) -> Words:
    """All words of all rows, in order. No text is cut short: a long one is hashed block by block at separators."""
    data, offsets = _flat(texts)
    table, out, at, n = _LOWER if lower else _TABLE, [], 0, len(data)
    borders = np.unique(offsets)
    while at < n:
        to = min(n, at + _BLOCK)
        if to < n:
            gap = np.flatnonzero(separators[data[at:to]])
            last = max(int(gap[-1]) + at + 1 if len(gap) else 0, int(borders[np.searchsorted(borders, to, "right") - 1]))
            if last <= at:  # one word longer than a block
                rest = separators[data[to:]]
                step = int(rest.argmax()) if rest.any() else n - to
                last = min(to + step, int(borders[np.searchsorted(borders, at, "right")]))
            to = last
        b = data[at:to]
        sep = separators[b]
        cut = borders[np.searchsorted(borders, at) : np.searchsorted(borders, to)] - at
        first = np.ones(len(b), bool)
        first[1:] = sep[:-1]
        first[cut] = True
        final = np.ones(len(b), bool)
        final[:-1] = sep[1:]
        final[cut[cut > 0] - 1] = True
        s, e = np.flatnonzero(first & ~sep), np.flatnonzero(final & ~sep) + 1
        with np.errstate(over="ignore"):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(table[b] * power("p", _P, len(b))[: len(b)], out=sums[1:])
            h = mix((sums[e] - sums[s]) * power("inverse", _PINV, len(b))[s] + (e - s).astype(np.uint64))
        out.append((h, s + at, e + at))
        at = to
    h, s, e = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, kind) for i, kind in enumerate((np.uint64, np.int64, np.int64)))
    return Words(np.searchsorted(offsets, s, "right") - 1, h, s, e, data, offsets)


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of ``n`` consecutive hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1]
    with np.errstate(over="ignore"):
        for j in range(1, n):
            out = mix(out * _P + h[j : len(h) - n + 1 + j])
    return out


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each window of ``n`` words; a row with fewer words but at least one has all of them as one."""
    h = combine(w.hash, n)
    inside = w.row[: len(h)] == w.row[n - 1 :] if len(h) else np.zeros(0, bool)
    rows, hashes = w.row[: len(h)][inside], h[inside]
    count = np.bincount(w.row, minlength=len(w.offsets) - 1)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        starts = np.searchsorted(w.row, few)
        whole = np.concatenate([combine(w.hash[s : s + c], c) + np.uint64(c) for s, c in zip(starts, count[few], strict=True)])
        order = np.argsort(np.concatenate([rows, few]), kind="stable")
        rows, hashes = np.concatenate([rows, few])[order], np.concatenate([hashes, whole])[order]
    return rows, hashes


def by_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each row's entries begin, for ``rows`` in order; one more for the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def prefixes(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the first ``length`` bytes, lower-cased, of each word that is longer."""
    longer = np.flatnonzero(w.end - w.start > length)
    h = np.full(len(longer), length, np.uint64)
    for j in range(length):
        h = mix(h ^ _LOWER[w.data[w.start[longer] + j]])
    return w.row[longer], h
