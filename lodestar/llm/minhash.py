"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles. One hash of each shingle chooses a register; the register keeps the
leading zeros of the smallest other part of the hash and a few bits of its mantissa, so a 16-bit register stands for a
64-bit minimum. Compressed registers are banded; pairs that share a band pass a size bound and a Jaccard estimate from
their registers, corrected for chance collisions, and are then verified on the full sets.

In a bucket of near copies all pairs would be too many, so each member is first verified against the smallest member of
its buckets; then a member that stayed outside the main component of any bucket against two rows in all, those with the
highest estimates over its buckets, of which large ones are cut for that; and what an estimate still leaves open is
compared exactly, in blocks that send out no pairs but links. Pairs inside one component need no test.

Defined results. A null text or one without words has an empty set and links with nothing; a text with fewer words than
a shingle is one shingle. Equal sets form a class, known by a 64-bit sum over its members, and only one document of it is
compared. Repeated rows are members of their class. Nulls in other columns are not looked at, and only ``doc_id`` and
``text`` are read, so clashing names of other columns are of no effect. A null ``doc_id`` is kept as a row that links
with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .banding import exact_links, exact_pairs, open_rows, shared_buckets, sized, star_pairs
from .blocks import BLOCK, together
from .bloom import build, may_hold
from .graph import components
from .scratch import drop, own_columns, save
from .textkernel import SPACE, by_row, mix, pieces, shingles, words

REGISTERS, BANDS = 128, 32
MANTISSA = 8
PIECE = 2 << 20  # bytes of text that a task hashes at a time; its arrays take some tens of times as much
SLACK = 0.16  # over four standard errors of an estimate from 128 registers
_PROBES = np.random.default_rng(7).integers(0, REGISTERS, (REGISTERS, 256))


def registers(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """A row of registers for each of ``n`` documents: (leading zeros + 1) << MANTISSA | inverted mantissa; 0 is empty."""
    bucket = (hashes >> np.uint64(57)).astype(np.int64)
    rest = (hashes << np.uint64(7)) | np.uint64(1 << 6)
    zeros = 63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 57)
    mantissa = (mix(hashes ^ np.uint64(0xA5A5A5A5)) & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)
    out = np.zeros(n * REGISTERS, np.int64)
    np.maximum.at(out, rows * REGISTERS + bucket, ((zeros + 1) << MANTISSA) | mantissa)
    return out.reshape(n, REGISTERS)


def bands(regs: np.ndarray) -> np.ndarray:
    """A hash for each band. An empty register first borrows from the first filled one of a fixed random order, so small
    sets do not meet in bands that are all but empty; a band takes registers that are far apart."""
    full = regs.copy()
    row, column = np.nonzero((full == 0) & (full.max(axis=1) > 0)[:, None])
    for t in range(_PROBES.shape[1]):
        if not len(row):
            break
        value = regs[row, _PROBES[column, t]]
        full[row, column] = value
        row, column = row[value == 0], column[value == 0]
    for r in np.unique(row):
        full[r, full[r] == 0] = regs[r].max()
    wide = full.reshape(len(full), REGISTERS // BANDS, BANDS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(full), BANDS)).copy()
    for j in range(wide.shape[1]):
        key = mix(key ^ (wide[:, j, :] + np.uint64(j << 32)))
    return key


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs: equal filled registers, less those that collide by chance, over filled registers."""
    filled = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    ratio = np.maximum(na, nb) / np.maximum(1, np.minimum(na, nb))
    chance = 0.169919 * REGISTERS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0, equal - chance) / np.maximum(1, filled)


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    rows, hashes = shingles(words(batch.column("text"), SPACE), size)
    at = by_row(rows, batch.num_rows)
    return [np.unique(hashes[at[i] : at[i + 1]]) for i in range(batch.num_rows)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def signatures(documents: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n`` (size of the set), ``c1`` (equal for equal sets), ``bands`` and ``registers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=PIECE):
            sets = _sets(batch, size)
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            regs = registers(np.repeat(np.arange(len(sets)), n), flat, len(sets))
            key = bands(regs)
            with np.errstate(over="ignore"):
                c1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(n), _signed(c1),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), _signed(key.ravel())),
                    pa.array([r.tobytes() for r in regs.astype("<u2")], pa.binary()),
                ],
                ["doc_id", "text_hash", "n", "c1", "bands", "registers"],
            )

    key = dict(documents.dtypes)["doc_id"]
    text = F.col("text").cast("string")
    rows = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {key}, text_hash long, n long, c1 long, bands array<long>, registers binary")


class _Group:
    """A group of ``blocks.together`` with registers: estimates of one row against all."""

    def __init__(self, group: pa.Table):
        self.ids, self.component, self.n = (group.column(c).to_numpy() for c in ("id", "component", "n"))
        self.regs = np.frombuffer(b"".join(group.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
        self.outside = np.flatnonzero(group.column("outside").to_numpy(zero_copy_only=False))

    def likely(self, i: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of other components that the estimate does not rule out for row ``i``, and the estimates."""
        other = np.flatnonzero((self.component != self.component[i]) & (100 * np.minimum(self.n, self.n[i]) >= percent * np.maximum(self.n, self.n[i])))
        j = estimate(np.broadcast_to(self.regs[i], (len(other), REGISTERS)), self.regs[other], np.full(len(other), self.n[i]), self.n[other])
        keep = j >= percent / 100 - np.where(np.minimum(self.n[other], self.n[i]) < 2 * REGISTERS, 2 * SLACK, SLACK)
        return other[keep], j[keep]


def _best(percent: int) -> Callable[[pa.Table], pa.RecordBatch]:
    """For each row outside its bucket's main component, the other with the highest estimate."""

    def fn(group: pa.Table) -> pa.RecordBatch:
        g, band, rows, others, estimates = _Group(group), group.column("band").to_numpy(), [], [], []
        for i in g.outside:
            other, j = g.likely(i, percent)
            if len(other):
                rows.append(i)
                others.append(g.ids[other[j.argmax()]])
                estimates.append(j.max())
        rows = np.array(rows, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(band[rows]), pa.array(g.ids[rows]), pa.array(others, pa.int64()), pa.array(estimates, pa.float64())], ["band", "id", "other", "j"])

    return fn


def _open_cases(percent: int) -> Callable[[pa.Table], pa.RecordBatch]:
    """Rows that may still link to another component, each with its bucket's main component."""

    def fn(group: pa.Table) -> pa.RecordBatch:
        g, main = _Group(group), group.column("main").to_numpy()
        rows = np.array([i for i in g.outside if len(g.likely(i, percent)[0])], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(main[rows]), pa.array(g.ids[rows])], ["to", "id"])

    return fn


def near_duplicates(documents: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable over links, or its own) and ``kept``.

    Two documents link if ``100 * intersection >= percent * union`` of their sets.
    """
    placed = _grouped(documents, shingle_words, percent)
    component = F.coalesce("keeper.doc_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def _grouped(documents: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n``, ``class`` and ``keeper`` (id and class of the component's first row; null for a
    row that is alone) of every row."""
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    signed = save(signatures(documents, shingle_words), "signatures")
    known = signed.where("n > 0 and doc_id is not null")
    buckets = save(shared_buckets(known.select(F.col("c1").alias("id"), F.explode("bands").alias("band"))), "buckets")
    # classes that share a band with another one; one document of a class stands for it
    ids = buckets.select("id").distinct()
    some = save(known.withColumnRenamed("c1", "id").join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc_id", "n", "registers")).alias("x")).select("id", "x.*"), "candidates")
    full = save(_full_sets(texts, some.select("doc_id", "id"), shingle_words), "sets")
    small = some.select("id", "n", "registers")
    verify = lambda pairs: exact_pairs(sized(pairs, small.select("id", "n"), percent), full, percent)

    links = save(verify(star_pairs(buckets)), "links")
    found = components(links)
    named = together(open_rows(buckets, found), [F.col("band")], _best(percent), "band long, id long, other long, j double", small, F.col("outside"), whole=False)
    named = save(named, "named")
    # two partners a row over all its buckets, the best of even and of odd ids
    best = named.groupBy("id", F.pmod("other", F.lit(2)).alias("odd")).agg(F.max_by("other", F.struct("j", "other")).alias("other"))
    pairs = save(best.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "best")
    more = save(exact_pairs(pairs, full, percent), "links")
    if more.limit(1).count():
        found = components(links.union(more))
    # of buckets that were compared whole only those that held a likely pair can hold one now, as components only grow together
    large = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("band")
    still = buckets.join(named.select("band").union(large).distinct(), "band", "left_semi")
    cases = save(together(open_rows(still, found), [F.col("band")], _open_cases(percent), "to long, id long", small, F.col("outside")).distinct(), "cases")
    if cases.limit(1).count():
        # all open rows of a main component's buckets meet one another and that component's members
        placed = some.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        outside = cases.join(placed, "id").select("to", "id", "component", F.lit(True).alias("outside"))
        inside = placed.join(cases.select("to").distinct(), F.col("component") == F.col("to")).select("to", "id", "component", F.lit(False).alias("outside"))
        last = save(exact_links(outside.union(inside), full, [F.col("to")], percent, "long"), "links")
        if last.limit(1).count():
            found = components(links.union(more).union(last))

    classes = known.groupBy("c1").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).join(found, F.col("c1") == F.col("id"), "left")
    classes = save(classes.withColumn("keeper", F.struct(F.col("first").alias("doc_id"), F.col("c1").alias("class"))), "classes")
    lowest = classes.where("component is not null").groupBy(F.col("component").alias("group")).agg(F.min("keeper").alias("lowest"))
    of = classes.join(lowest, F.col("component") == F.col("group"), "left").where("copies > 1 or lowest is not null")
    of = save(of.select(F.col("c1").alias("of"), F.coalesce("lowest", "keeper").alias("keeper")), "keepers")
    for old in (buckets, some, full, links, named, pairs, more, cases, classes):
        drop(old)
    rows = signed.select("doc_id", "text_hash", "n", F.col("c1").alias("class"))
    mine = (F.col("class") == F.col("of")) & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return rows.join(of, mine, "left").drop("of")


def _full_sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``id`` and ``shingles`` of the documents in ``wanted`` (``doc_id``, ``id``). A Bloom filter drops the others before
    their sets are made, so no text is shuffled."""
    held = texts.sparkSession.sparkContext.broadcast(build(wanted.select(F.xxhash64("doc_id").alias("key")), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = may_hold(held.value, batch.column("key").to_numpy().view(np.uint64))
            for part in pieces(iter([batch.filter(pa.array(keep))]), most=PIECE):
                sets = _sets(part, size)
                at = np.cumsum([0, *map(len, sets)])
                ids = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([_signed(ids), pa.ListArray.from_arrays(pa.array(at, pa.int32()), _signed(np.concatenate(sets)))], ["id", "shingles"])

    keyed = texts.where("doc_id is not null").withColumn("key", F.xxhash64("doc_id"))
    return keyed.select("key", "text").mapInArrow(run, "id long, shingles array<long>").join(wanted.select("id"), "id").groupBy("id").agg(F.first("shingles").alias("shingles"))


def keep_one(documents: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` less those that near-duplicate the first row, by ``doc_id`` and then by set, of their
    component; all columns. A row is known by its id and its text, so an id that other texts share loses none of them; rows
    that repeat both stay or go together."""
    placed = _grouped(documents, shingle_words, percent)
    other = (F.col("keeper.doc_id") != F.col("doc_id")) | (F.col("keeper.class") != F.col("class"))
    gone = save(placed.where(other).select(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_text")).distinct(), "gone")
    drop(placed)  # the tables that it reads are of this module alone
    # rows that the filter clears stay as they are read; only the others' texts are shuffled, where the planner does so
    key = F.xxhash64("doc_id", F.xxhash64(F.col("text").cast("string")))
    held = documents.sparkSession.sparkContext.broadcast(build(gone.select(F.xxhash64("__gone_id", "__gone_text").alias("key")), "key"))
    # in Arrow the columns have plain names, whatever they are called
    fields = [StructField(f"c{i}", f.dataType) for i, f in enumerate(documents.schema.fields)]
    keyed = documents.select(*(c.alias(f.name) for c, f in zip(own_columns(documents), fields, strict=True)), key.alias("key"))
    plain, names = [f.name for f in fields], documents.columns

    def that(may: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = may_hold(held.value, batch.column("key").to_numpy().view(np.uint64)) == may
                yield batch.filter(pa.array(rows)).select(plain)

        return keyed.mapInArrow(run, StructType(fields)).toDF(*names)

    maybe = that(True)
    same = (maybe["doc_id"] == gone["__gone_id"]) & (F.xxhash64(maybe["text"].cast("string")) == gone["__gone_text"])
    return that(False).union(maybe.join(gone, same, "left_anti").select(*own_columns(documents)))
