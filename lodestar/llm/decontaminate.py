"""Benchmark decontamination by greedy string tiling.

Documents and test items are lower-cased words of letters and digits. Windows of ``seed_words`` words that a document
shares with an item are its seeds. For each document and item with seeds, the longest run of equal words that is not yet
covered on either side is marked again and again, until none has ``seed_words`` words. The longest length is searched by
halving: Karp-Rabin hashes of all open windows of a length tell whether the two sides share one, so a length costs time in
proportion to the words, and a word that both sides repeat a million times is no product. The marked share of the item's
words is its coverage, which a passage in another order reaches as well. A pair whose seeds could not cover ``share`` of
the item is left before that.

Items are sent to the tasks in blocks of at most ``block_bytes`` of text, one pass over the documents a block, so nothing
that is broadcast grows with the benchmark. Each block's pairs are saved
before the next block is read.

Defined results. Null or empty texts, and items with fewer words than a seed, match nothing. Equal items are reported
each; repeated documents are reported each. Of equally long runs the first of the item, and then the first of the text,
is marked. Other columns are carried by :func:`remove`, and not looked at. An item may be far longer or shorter than a
document. Empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import own_columns, save
from .textkernel import PUNCT, by_row, combine, mix, pieces, power, words


_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Side:
    """The open windows of one side: words, starts of shared seeds, and how far a run from each may reach."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, least: int):
        self.starts, self.least, self.used = starts, least, np.zeros(len(words) + 1, bool)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power("tile", _BASE, len(words))[: len(words)], dtype=np.uint64)])
        # a run of seeds ends where the next window is no seed
        last = np.flatnonzero(np.append(np.diff(starts) != 1, True))
        self.end = starts[np.repeat(last, np.diff(np.append(-1, last)))] + least

    def reach(self) -> np.ndarray:
        """Longest open window from each start."""
        used = np.append(np.flatnonzero(self.used), len(self.used))
        return np.minimum(self.end, used[np.searchsorted(used, self.starts)]) - self.starts

    def windows(self, at: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[at + n] - self.sums[at]) * power("back", _BACK, len(self.sums))[at])


def tiles(item: np.ndarray, text: np.ndarray, p: np.ndarray, t: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping (item place, text place, length), longest first; ``p``, ``t``: where shared windows of ``least``
    words begin in the item and in the text, in order."""
    if not len(p) or not len(t):
        return []
    a, b, out, longest = _Side(item, p, least), _Side(text, t, least), [], len(item)
    while True:
        ra, rb = a.reach(), b.reach()
        low, high = least - 1, min(longest, int(ra.max()), int(rb.max()))
        while low < high:  # the greatest length of which both sides have an open window
            n = (low + high + 1) // 2
            shared = np.isin(a.windows(p[ra >= n], n), b.windows(t[rb >= n], n)).any()
            low, high = (n, high) if shared else (low, n - 1)
        if low < least:
            return out
        _mark(a, b, p[ra >= low], t[rb >= low], low, out)
        longest = low - 1


def _mark(a: _Side, b: _Side, p: np.ndarray, t: np.ndarray, n: int, out: list[tuple[int, int, int]]) -> None:
    """Mark the equal windows of ``n`` words in order of the item, each with the first open place of the text."""
    hashes = b.windows(t, n)
    order = np.argsort(hashes, kind="stable")
    hashes, t = hashes[order], t[order]
    mine = a.windows(p, n)
    first, last = np.searchsorted(hashes, mine), np.searchsorted(hashes, mine, "right")
    begin: dict[int, int] = {}
    for i in np.flatnonzero(last > first):
        x = int(p[i])
        if a.used[x] or a.used[x + n - 1]:  # all marks are of n words or more, so an overlap covers an end
            continue
        at, end = begin.get(int(first[i]), int(first[i])), int(last[i])
        while at < end:
            some = t[at : min(end, at + 4096)]
            free = ~(b.used[some] | b.used[some + n - 1])
            if free.any():
                at += int(free.argmax())
                break
            at += len(some)
        begin[int(first[i])] = at
        if at < end:
            y = int(t[at])
            out.append((x, y, n))
            a.used[x : x + n] = b.used[y : y + n] = True


class _Block:
    """The items of one block, ready to be searched for."""

    def __init__(self, ids: list, texts: list[str | None], least: int):
        w = words(pa.array(texts, pa.large_string()), PUNCT)
        at = by_row(w.row, len(ids))
        self.ids, self.words = ids, [w.hash[at[i] : at[i + 1]] for i in range(len(ids))]
        windows = self.windows = [combine(x, least) for x in self.words]
        self.hash = np.concatenate(windows) if windows else np.zeros(0, np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.item = np.repeat(np.arange(len(ids)), [len(x) for x in windows])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in windows])[order] if windows else order


def _leaked(batch: pa.RecordBatch, block: _Block, least: int, share: float) -> dict[str, list]:
    """Columns of the pairs found: row, item, covered, words, coverage, spans."""
    found: dict[str, list] = {k: [] for k in ("row", "item", "covered", "words", "coverage", "spans")}
    w = words(batch.column("text"), PUNCT)
    window = combine(w.hash, least)
    if not len(window) or not len(block.hash):
        return found
    low = np.searchsorted(block.hash, window)
    hit = np.flatnonzero((block.hash[np.minimum(low, len(block.hash) - 1)] == window) & (w.row[: len(window)] == w.row[least - 1 :]))
    at = by_row(w.row, batch.num_rows)
    rows = w.row[hit]
    for row in np.unique(rows):
        seeds = hit[np.searchsorted(rows, row) : np.searchsorted(rows, row, "right")]
        values = np.unique(window[seeds])
        first, last = np.searchsorted(block.hash, values), np.searchsorted(block.hash, values, "right")
        each = last - first
        which = np.repeat(first - np.cumsum(each) + each, each) + np.arange(each.sum())
        # places of the items at which some window of the document begins
        order = np.lexsort((block.place[which], block.item[which]))
        item, place = block.item[which][order], block.place[which][order]
        text = w.hash[at[row] : at[row + 1]]
        for i in np.unique(item):
            own, p = block.words[i], place[item == i]
            reach = np.minimum(np.diff(np.append(p, len(own) + least)), least).sum()
            if reach < share * len(own):
                continue
            mine = np.isin(window[seeds], block.windows[i])
            marks = tiles(own, text, p, seeds[mine] - at[row], least)
            covered = sum(n for _, _, n in marks)
            if covered >= share * len(own):
                span = sorted((int(w.start[at[row] + t] - w.offsets[row]), int(w.end[at[row] + t + n - 1] - w.offsets[row])) for _, t, n in marks)
                for k, v in zip(found, (int(row), block.ids[i], covered, len(own), covered / len(own), [{"start": a, "end": b} for a, b in span]), strict=True):
                    found[k].append(v)
    return found


def leaks(documents: DataFrame, benchmark: DataFrame, seed_words: int = 5, share: float = 0.5, block_bytes: int = 4 << 20) -> DataFrame:
    """Pairs of a document and a test item of which at least ``share`` of the words is tiled: ``doc_id``, ``item_id``,
    ``covered``, ``item_words``, ``coverage`` and ``spans`` (UTF-8 byte places in the document's text)."""
    return _pairs(documents, _blocks(benchmark, block_bytes), dict(benchmark.dtypes)["item_id"], seed_words, share).drop("text_hash")


def _pairs(documents: DataFrame, blocks: Iterator[tuple[list, list[str]]], item_kind: str, seed_words: int, share: float) -> DataFrame:
    """:func:`leaks` with ``text_hash``, which tells apart the rows of one ``doc_id``."""
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text_hash long, item_id {item_kind}, covered long, item_words long, coverage double, spans array<struct<start:long,end:long>>"
    text = F.col("text").cast("string")
    texts = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def search(block: _Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                found = _leaked(batch, block, seed_words, share)
                if found["row"]:
                    row = pa.array(found["row"])
                    columns = [pa.array(found["item"]), pa.array(found["covered"], pa.int64()), pa.array(found["words"], pa.int64()), pa.array(found["coverage"], pa.float64()), pa.array(found["spans"], span)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("text_hash").take(row), *columns], ["doc_id", "text_hash", "item_id", "covered", "item_words", "coverage", "spans"])

        return texts.mapInArrow(run, schema)

    # a block's rows are saved before the next block is read, so the driver holds one block of items at a time
    parts = [save(search(_Block(ids, items, seed_words)), "leaks") for ids, items in blocks]
    return reduce(DataFrame.union, parts, documents.sparkSession.createDataFrame([], schema))


def _blocks(benchmark: DataFrame, most: int) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of bounded bytes."""
    ids, texts, held = [], [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        size = len(row.text.encode())
        if ids and held + size > most:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        held += size
    if ids:
        yield ids, texts


def remove(documents: DataFrame, benchmark: DataFrame, seed_words: int = 5, share: float = 0.5, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``documents`` that leak no test item; all columns. The leaking rows are saved, known by id and text, and
    taken out by a join; as a saved table's size is known, the planner sends a small one to every task."""
    gone = _pairs(documents, _blocks(benchmark, block_bytes), dict(benchmark.dtypes)["item_id"], seed_words, share)
    gone = save(gone.select(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_text")).distinct(), "gone")
    same = documents["doc_id"].eqNullSafe(gone["__gone_id"]) & (F.xxhash64(documents["text"].cast("string")) == gone["__gone_text"])
    return documents.join(gone, same, "left_anti").select(*own_columns(documents))
