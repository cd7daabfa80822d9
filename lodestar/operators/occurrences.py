"""Many patterns looked for in one pass over the texts: nothing is stored or shuffled but what is found.

A pattern of eight bytes or more is known by one window of eight bytes, the one whose letters the other patterns share least;
a shorter one by all its bytes. Every window of a text is looked up in a table of the patterns' windows, and where one is
found, the pattern is compared byte by byte. UTF-8 begins a letter nowhere inside another one, so equal bytes are equal
letters. Patterns are sent to the tasks in blocks of at most ``BLOCK_BYTES``, one pass over the texts a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 8
BLOCK_BYTES = 4 << 20
TEXT_BYTES = 2 << 20  # of text that a task looks through at a time
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIRS = 1 << 22  # of a place and a pattern that are compared at a time


def _windows(data: np.ndarray, n: int) -> np.ndarray:
    """Eight bytes from each of the first ``n`` places; ``data`` goes on for eight more bytes at least."""
    return np.ndarray((n,), np.dtype("<u8"), data, strides=(1,)).copy()


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << (8 * width)) - 1)


class _Class:
    """Patterns that are known by windows of one width: the windows in order, and the patterns of each."""

    def __init__(self, width: int, which: np.ndarray, window: np.ndarray):
        order = np.argsort(window, kind="stable")
        self.width, self.which = width, which[order]
        self.keys, self.first = np.unique(window[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(window)))
        self.bits = np.uint64(64 - min(24, max(16, len(self.keys).bit_length() + 6)))
        self.table = np.zeros(1 << (64 - int(self.bits)), bool)
        self.table[self._place(self.keys)] = True
        self.direct = None
        if width <= 2:
            self.direct = np.full(1 << 16, -1, np.int32)
            self.direct[self.keys.astype(np.int64)] = np.arange(len(self.keys))

    def _place(self, window: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((window * _MIX) >> self.bits).astype(np.int64)

    def found(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose window is a pattern's, and which of ``keys`` it is."""
        own = windows & _mask(self.width) if self.width < WIDTH else windows
        if self.direct is not None:
            key = self.direct[own.astype(np.int64)]
            at = np.flatnonzero(key >= 0)
            return at, key[at]
        at = np.flatnonzero(self.table[self._place(own)])
        key = np.minimum(np.searchsorted(self.keys, own[at]), len(self.keys) - 1)
        same = self.keys[key] == own[at]
        return at[same], key[same]


class Patterns:
    """The patterns of one block (bytes, none empty), ready to be looked for."""

    def __init__(self, patterns: list[bytes]):
        self.sizes = np.array([len(p) for p in patterns], np.int64)
        starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        data = np.frombuffer(b"".join(patterns) + bytes(2 * WIDTH), np.uint8)
        self.starts, self.words = starts, _windows(data, int(starts[-1]) + WIDTH)
        self.offset = np.zeros(len(patterns), np.int64)
        long = np.flatnonzero(self.sizes >= WIDTH)
        if len(long):
            # how often the patterns hold the three bytes from each place, and so how common a window's letters are
            _, inverse, often = np.unique(self.words & _mask(3), return_inverse=True, return_counts=True)
            common = np.concatenate([[0.0], np.cumsum(np.log(often[inverse]))])
            for i in long:
                at = np.arange(starts[i], starts[i + 1] - WIDTH + 1)
                self.offset[i] = np.argmin(common[at + WIDTH - 2] - common[at])
        self.classes = []
        for width in np.unique(np.minimum(self.sizes, WIDTH)):
            which = np.flatnonzero(np.minimum(self.sizes, WIDTH) == width)
            window = self.words[starts[which] + self.offset[which]]
            self.classes.append(_Class(int(width), which, window & _mask(int(width)) if width < WIDTH else window))

    def held(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a text and a pattern that it holds, each once, by text. ``data``: the texts' bytes and eight more."""
        n, texts, many = int(offsets[-1]), len(offsets) - 1, len(self.sizes)
        windows = _windows(data, n)
        row = np.repeat(np.arange(texts), np.diff(offsets))
        out = []
        for own in self.classes:
            places, keys = own.found(windows)
            dense = np.zeros(texts * len(own.which), bool) if texts * len(own.which) <= 16 * TEXT_BYTES else None
            upto = np.cumsum(own.count[keys])
            a = 0
            while a < len(places):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _PAIRS, "right")))
                place, key = places[a:b], keys[a:b]
                a = b
                each = own.count[key]
                nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                local = np.repeat(own.first[key], each) + nth
                which, place = own.which[local], np.repeat(place, each)
                text, start = row[place], place - self.offset[which]
                good = (start >= offsets[text]) & (start + self.sizes[which] <= offsets[text + 1])
                local, which, text, start = local[good], which[good], text[good], start[good]
                if own.width == WIDTH:
                    kept = self._equal(windows, start, which)
                    local, which, text = local[kept], which[kept], text[kept]
                if dense is not None:
                    dense[text * len(own.which) + local] = True
                else:
                    out.append(np.unique(text * many + which))
            if dense is not None:
                at = np.flatnonzero(dense)
                out.append(at // len(own.which) * many + own.which[at % len(own.which)])
        found = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return found // many, found % many

    def _equal(self, windows: np.ndarray, start: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The candidates at which the whole pattern stands, eight bytes a step, the last eight first."""
        left = np.arange(len(start))
        ends = self.sizes[which] - WIDTH
        at = ends.copy()
        step = 0
        while len(left):
            same = windows[start[left] + at[left]] == self.words[self.starts[which[left]] + at[left]]
            left = left[same]
            if step >= (int(ends[left].max()) if len(left) else 0):
                return left
            at = np.minimum(step, ends)
            step += WIDTH
        return left


def _pieces(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``TEXT_BYTES`` of text, one row at least, with their bytes and offsets; a null is empty."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + TEXT_BYTES, "right")) - 1)
        part = batch.slice(a, b - a)
        whole = b"".join(x.as_buffer() for x in part.column(text) if x.is_valid)
        yield part, np.frombuffer(whole + bytes(2 * WIDTH), np.uint8), upto[a : b + 1] - upto[a]
        a = b


def marked(documents: DataFrame, patterns: DataFrame, pattern: str, text: str = "text", *carried: str) -> DataFrame:
    """The ``carried`` columns of each text that holds a pattern, and ``found``: the hashes (:func:`known`) of the patterns that it
    holds. Null and empty patterns are held by none. With several blocks of patterns a text may have several rows."""
    listed = patterns.where(F.length(pattern) > 0).select(F.col(pattern).alias("p")).distinct().select("p", known(F.col("p")).alias("h"))
    total = listed.agg(F.coalesce(F.sum(F.octet_length("p")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-total // BLOCK_BYTES))
    rows = documents.select(*carried, F.col(text).alias("__text"))
    kinds = dict(documents.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "found array<bigint>"])

    def passed(block: int) -> DataFrame:
        own = listed.where(F.pmod(F.col("h"), F.lit(blocks)) == block).toArrow()
        held, hashes = [p.encode() for p in own.column("p").to_pylist()], own.column("h").to_numpy()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ready = Patterns(held)
            for batch in batches:
                for part, data, offsets in _pieces(batch, "__text"):
                    row, which = ready.held(data, offsets)
                    if len(row):
                        at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)), pa.int32()), pa.array(hashes[which]))
                        yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row[at])) for c in carried), lists], [*carried, "found"])

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.union, map(passed, range(blocks)))


def known(pattern: Column) -> Column:
    return F.xxhash64(pattern)


def holding(documents: DataFrame, patterns: DataFrame, pattern: str, text: str = "text", *carried: str) -> DataFrame:
    """The ``carried`` columns of each document beside the rows of ``patterns`` that its ``text`` holds."""
    pairs = marked(documents, patterns, pattern, text, *carried).withColumn("__h", F.explode("found")).drop("found")
    return pairs.join(patterns.where(F.length(pattern) > 0).withColumn("__h", known(F.col(pattern))), "__h").drop("__h")
