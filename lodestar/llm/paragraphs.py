"""Repeated passages by MinHash banding of paragraphs.

A paragraph is a sentence of eight words or more, or the shorter sentences between two such; one of over 64 words is cut
after words whose hash says so. Where a paragraph begins and ends thus depends on its own words only, so a passage has
the same paragraphs wherever it stands, as long as sentences end at its borders. Its shingles of five words are MinHashed.

Beside the paragraphs stand stretches, which need no sentence ends. An anchor is the shingle of the smallest hash among
``ANCHOR`` neighbouring ones, and a stretch goes from the first word of an anchor to the last of the next one: 6 to 13
words, overlapping their neighbours. Two texts that share n words in a row share stretches of n - 2 * ANCHOR + 2 of them,
wherever the words stand and whatever surrounds them; stretches count as repeated only if they are equal.

The bands of all paragraphs and the hashes of all stretches are counted once; those met in two documents or more go into
a Bloom filter of fixed size. A second pass over the texts keeps what the filter lets through, paragraphs with their
shingles. Equal paragraphs form a class; classes that share a band are compared by exact Jaccard similarity, and
components of the links are the groups. What is of a group that reaches two documents is repeated; repeated paragraphs
and stretches with at most ``GAP`` words between them, which is what one edited word may cost, form a passage. It is
reported if they cover ``least_words`` words of it. The first of a group by document and place is kept.

Bands: with one row a band, ``bands`` of them find a pair of similarity s with a chance of 1 - (1 - s) ** bands; three
give 0.992 at 0.8 and 0.9999 at 0.95, and five-word shingles are rare enough that one row does not bring chance pairs.

Paragraphs, stretches and bands are known by 64-bit hashes.

Defined results. Null and empty texts, and paragraphs of fewer than five words, repeat nothing. Repeats inside one document
alone are no finding, and all rows of one ``doc_id`` are one document; each of its texts has places of its own. A null
``doc_id`` is left out. Only ``doc_id`` and ``text`` are read; :func:`remove_repeats` carries all columns, whatever their
names, and cuts a text only at places that were found in that very text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .banding import linked_sets, shared_buckets
from .bloom import build, may_hold
from .graph import components
from .scratch import drop, own_columns, save
from .textkernel import SPACE, Words, combine, mix, pieces, words

SHINGLE = 5
LONG, TOO_LONG = 8, 64
ANCHOR = 8
GAP = 2 * ANCHOR - 1
PIECE = 1 << 20  # bytes of text that a task cuts into units at a time; their arrays take some tens of times as much


def bands_for(similarity: float, recall: float) -> int:
    """Fewest one-row bands that find a pair of that similarity with that chance."""
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - similarity))))


class _Stretches:
    """Stretches from anchor to anchor of a batch: row, first word's number in the row, first byte, end, words, hash."""

    def __init__(self, w: Words, window: np.ndarray):
        reach = ANCHOR + SHINGLE - 1
        a = b = np.zeros(0, np.int64)
        if len(w.hash) >= reach:
            least = sliding_window_view(mix(window ^ np.uint64(0x5EED)), ANCHOR).argmin(axis=1)
            inside = np.flatnonzero(w.row[: len(least)] == w.row[reach - 1 :])
            anchors = np.unique(inside + least[inside])
            a, b = anchors[:-1], anchors[1:]
            same = w.row[a] == w.row[b]
            a, b = a[same], b[same]
        each = b - a + 1
        at = np.cumsum(each) - each
        place = np.arange(each.sum()) - np.repeat(at, each)
        h = window[np.repeat(a, each) + place]
        with np.errstate(over="ignore"):
            self.hash = mix(np.add.reduceat(mix(h * np.uint64(3) + place.astype(np.uint64)), at) + np.uint64(0x57)) if len(at) else h
        self.row, self.words = w.row[a], b + SHINGLE - a
        self.no = a - np.searchsorted(w.row, self.row)
        self.start = w.start[a] - w.offsets[self.row]
        self.end = w.end[b + SHINGLE - 1] - w.offsets[self.row]


class _Units:
    """Paragraphs of a batch: row, first word's number in the row, first byte, end, words, shingle places. And its stretches."""

    def __init__(self, texts: pa.Array):
        w = words(texts, SPACE)
        n = len(w.hash)
        self.window = combine(w.hash, SHINGLE)
        self.stretches = _Stretches(w, self.window)
        if not n:
            self.row = self.no = self.start = self.end = self.words = self.first = np.zeros(0, np.int64)
            return
        lines = np.concatenate([[0], np.cumsum(w.data == 10)])
        stop = np.isin(w.data[w.end - 1], np.frombuffer(b".!?", np.uint8))
        stop[:-1] |= lines[w.start[1:]] > lines[w.end[:-1]]
        new_row = np.concatenate([[True], np.diff(w.row) != 0])
        begin = np.flatnonzero(new_row | np.concatenate([[True], stop[:-1]]))
        is_long = np.diff(np.append(begin, n)) >= LONG
        opens = new_row[begin] | is_long | np.concatenate([[True], is_long[:-1]])
        begin = begin[opens]
        size = np.diff(np.append(begin, n))
        mark = np.zeros(n, bool)
        mark[begin] = True
        inside = np.repeat(size > TOO_LONG, size)
        mark[1:] |= inside[:-1] & inside[1:] & (w.hash[:-1] & np.uint64(31) == 0)
        begin = np.flatnonzero(mark)
        size = np.diff(np.append(begin, n))
        begin, size = begin[size >= SHINGLE], size[size >= SHINGLE]
        self.row, self.words, self.first = w.row[begin], size, begin
        self.no = begin - np.searchsorted(w.row, self.row)
        self.start = w.start[begin] - w.offsets[self.row]
        self.end = w.end[begin + size - 1] - w.offsets[self.row]

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All window hashes of the chosen paragraphs, and where each one's begin."""
        each = self.words[which] - SHINGLE + 1
        at = np.cumsum(each) - each
        return self.window[np.repeat(self.first[which] - at, each) + np.arange(each.sum())], at

    def bands(self, bands: int) -> np.ndarray:
        if not len(self.first):
            return np.zeros((0, bands), np.uint64)
        h, at = self.shingles(np.arange(len(self.first)))
        return np.stack([mix(np.minimum.reduceat(mix(h ^ np.uint64(0x9E37 + 2 * j)), at) + np.uint64(j)) for j in range(bands)], axis=1)


def _texts(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")).where("doc_id is not null and text is not null")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _all_bands(documents: DataFrame, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=PIECE):
            units = _Units(batch.column("text"))
            row = np.concatenate([np.repeat(units.row, bands), units.stretches.row])
            band = np.concatenate([units.bands(bands).ravel(), units.stretches.hash])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), _signed(band)], ["doc_id", "band"])

    return _texts(documents).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, band long")


def _candidates(documents: DataFrame, bands: int, table: np.ndarray) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(table)
    fields = ["doc_id", "text_hash", "no", "start", "end", "words", "id", "bands", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=PIECE):
            units = _Units(batch.column("text"))
            band = units.bands(bands)
            keep = np.flatnonzero(may_hold(held.value, band).any(axis=1))
            h, at = units.shingles(keep) if len(keep) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            place = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
            with np.errstate(over="ignore"):
                ids = mix(np.add.reduceat(mix(h * np.uint64(5) + place.astype(np.uint64)), at)) if len(at) else h
            more = units.stretches
            also = np.flatnonzero(may_hold(held.value, more.hash))
            own = lambda x, which: [*(batch.column(c).take(pa.array(x.row[which])) for c in ("doc_id", "text_hash")), *(pa.array(getattr(x, c)[which], pa.int64()) for c in ("no", "start", "end", "words"))]
            none = pa.array([[]] * len(also), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*own(more, also), _signed(more.hash[also]), none, none], fields)
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(values)) for ends, values in ((np.arange(len(keep) + 1) * bands, np.ascontiguousarray(band[keep]).ravel()), (np.append(at, len(h)), h)))
            yield pa.RecordBatch.from_arrays([*own(units, keep), _signed(ids), *lists], fields)

    return _texts(documents).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, text_hash long, no long, start long, end long, words long, id long, bands array<long>, shingles array<long>")


def repeats(documents: DataFrame, similarity: int = 80, least_words: int = 20, recall: float = 0.99) -> DataFrame:
    """A row for each repeated passage: ``doc_id``, ``start`` and ``end`` (UTF-8 bytes of the text), ``words`` from its first to its
    last one, ``component_doc`` and ``component_start`` (the first unit of the group that its first unit is of), and ``kept``. What
    of a run of repeated units is kept and what is not are passages of their own, which may overlap."""
    units = _repeats(documents, similarity, least_words, recall)
    first = F.min(F.struct("no", "start", "component_doc", "component_start")).alias("first")
    made = units.groupBy("doc_id", "text_hash", "run", "kept").agg(first, F.max("end").alias("end"), F.max(F.col("no") + F.col("words")).alias("reached"))
    return made.select("doc_id", "first.start", "end", (F.col("reached") - F.col("first.no")).alias("words"), "first.component_doc", "first.component_start", "kept")


def _repeats(documents: DataFrame, similarity: int = 80, least_words: int = 20, recall: float = 0.99) -> DataFrame:
    """The repeated units, with ``text_hash``, which tells apart the texts of one ``doc_id``, and the ``run`` that each is of."""
    bands = bands_for(similarity / 100, recall)
    met = _all_bands(documents, bands).groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = save(met.where("low < high").select("band"), "bands")
    some = save(_candidates(documents, bands, build(shared, "band")), "paragraphs")
    drop(shared)
    buckets = save(shared_buckets(some.select("id", F.explode("bands").alias("band"))), "buckets")
    classes = some.join(buckets.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first("shingles").alias("s")).select("id", F.array_distinct("s").alias("shingles"))
    reps = save(classes, "classes")
    found = linked_sets(reps, buckets, similarity, components)
    for old in (buckets, reps):
        drop(old)
    own = ["doc_id", "text_hash", "no", "start", "end", "words"]
    stretches = some.where(F.size("bands") == 0).select(*own, F.col("id").alias("component"))  # equal ones are one group, no links
    linked = some.where(F.size("bands") > 0).select(*own, "id").join(found, "id", "left").select(*own, F.coalesce("component", "id").alias("component"))
    placed = stretches.union(linked)
    first = placed.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("keeper"), F.max("doc_id").alias("last"))
    groups = save(first.where("keeper.doc_id < last").drop("last"), "groups")
    # rows of one text together, repeated ones once; the windows need no other exchange
    repeated = placed.join(groups, "component").repartition("doc_id", "text_hash").dropDuplicates(["doc_id", "text_hash", "no", "start", "words", "component"])
    of = W.partitionBy("doc_id", "text_hash")
    in_order = of.orderBy("no", "start", "words", "component")
    reached = F.coalesce(F.max(F.col("no") + F.col("words")).over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.col("no") - GAP - 1)
    placed_in = repeated.withColumn("reached", reached)
    runs = placed_in.withColumn("run", F.sum((F.col("no") - F.col("reached") > GAP).cast("int")).over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    new = F.greatest(F.lit(0), F.col("no") + F.col("words") - F.greatest("no", "reached"))
    kept = (F.col("keeper.doc_id") == F.col("doc_id")) & (F.col("keeper.text_hash") == F.col("text_hash")) & (F.col("keeper.start") == F.col("start"))
    return (
        runs.withColumn("passage_words", F.sum(new).over(W.partitionBy("doc_id", "text_hash", "run")))
        .where(F.col("passage_words") >= least_words)
        .select("doc_id", "text_hash", "run", "no", "start", "end", "words", F.col("keeper.doc_id").alias("component_doc"), F.col("keeper.start").alias("component_start"), "passage_words", kept.alias("kept"))
    )


def remove_repeats(documents: DataFrame, **options) -> DataFrame:
    """``documents`` without the paragraphs and stretches that :func:`repeats` finds and does not keep; all columns and rows."""
    cut, of, hashed = (f"__{name}{max(map(len, documents.columns)) * '_'}" for name in ("gone", "of", "hash"))  # names that no column has
    gone = _repeats(documents, **options).where("not kept").groupBy(F.col("doc_id").alias(of), F.col("text_hash").alias(hashed)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(cut))
    same = (documents["doc_id"] == gone[of]) & (F.xxhash64(documents["text"].cast("string")) == gone[hashed])
    joined = documents.join(gone, same, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(cut).to_pylist(), strict=True):
                if text and spans:
                    raw, at, left = text.encode(), 0, []
                    for s in spans:
                        left.append(raw[at : max(at, s["start"])])
                        at = max(at, s["end"])
                    text = b"".join([*left, raw[at:]]).decode()
                out.append(text)
            names = [c for c in batch.schema.names if c != cut]
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.column("text").type) if c == "text" else batch.column(c) for c in names], names)

    return joined.select(*own_columns(documents), cut).mapInArrow(run, documents.schema)
