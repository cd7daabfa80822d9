"""The best entities of many requests by their best document, without the pairs of a request and a document that cannot matter.

One pass over the texts stores a short row a text, with the terms that any request asks; only if these are more than ``VOCABULARY``
are there more passes. Equal rows of one entity, and requests of equal terms and sectors, are scored once. Requests are then handled
in blocks of at most ``BLOCK_TERMS`` rows of a request and a term, which read the short rows alone. The texts with most asked terms,
``SEEDS`` an entity and ``SECTOR_SEEDS`` a sector at most, give a score that the last entity of a request's list reaches at least. The
rows are read in slices of like length and one sector: of each slice the greatest part of every term is known, so a request's
commonest terms, as long as all their parts together stay below its score, bring no text of the slice into the list. Only postings
of its other terms are added up, and what the common ones add is looked up from the rarest on, as long as the text can still reach
the score. The lists are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .search import Index, top
from .stated import Keep, counted

VOCABULARY = 4_000_000  # terms that are looked up in one pass over the texts
BLOCK_TERMS = 8_000_000  # of a request and a term
SEEDS, SECTOR_SEEDS = 8, 256
TEXTS, POSTINGS = 256, 6_000  # of a slice, at most; of one text any number
SLICES, REQUESTS = 32, 2_048  # that are bounded at a time
FOUND = 100_000  # scores that are given back at a time
PAIRS = 1_000_000  # of a request and a text that are added up at a time
SLACK = 2e-6  # scores are compared as they are rounded


class Block(NamedTuple):
    """The short ``rows`` of the texts (key, ``dl``, ``term``, ``tf``) over ``terms``, with each one's number of texts, the number of all texts, and
    ``texts``, the rows that differ (entity, sector, ``dl``, ``term``, ``tf`` and ``first``, the least key of equal ones)."""

    rows: DataFrame
    texts: DataFrame
    terms: pa.Array
    df: np.ndarray
    n: int


class _Requests(NamedTuple):
    """Requests by number: the terms of request i, from the commonest to the rarest, are ``term[start[i]:start[i + 1]]``. ``alike`` has requests of
    like length: the first and last of them, and a line for each of their terms, filled up with the number that is no term's."""

    number: np.ndarray
    term: np.ndarray
    start: np.ndarray
    floor: np.ndarray
    alike: list[tuple[int, int, np.ndarray]]


class _Scratch(NamedTuple):
    """Arrays that the slices of a task share, all zero between them but for ``column`` and ``last``. By term: greatest part, column, whether
    it is looked up, and its line in the table. By pair of a request and a text: the sum, and the last posting."""

    most: np.ndarray
    column: np.ndarray
    asked: np.ndarray
    line: np.ndarray
    total: np.ndarray
    last: np.ndarray


def _scratch(terms: int, pairs: int) -> _Scratch:
    return _Scratch(np.zeros(terms), np.zeros(terms, np.int64), np.zeros(terms, bool), np.zeros(terms, np.int64), np.zeros(pairs), np.zeros(pairs, np.int64))


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where the lists begin and end in their joined elements, and these; a null is an empty list."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pc.list_flatten(column)


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``first[i]`` to ``first[i] + sizes[i] - 1``, one i after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(first - before, sizes) + np.arange(int(sizes.sum()))


def block(documents: DataFrame, asked: DataFrame, key: str, entity: str, sector: str, keep: Keep) -> Block:
    """The part of the corpus that the ``asked`` terms (``term``, distinct) need. Parts of the rows that differ are in order of sector and
    length."""
    terms = asked.toArrow().column("term").combine_chunks()
    rows = keep(counted(documents, key, terms, carried=(entity, sector)), "asked-rows")
    same = rows.groupBy(entity, sector, "dl", "term", "tf").agg(F.min(key).alias("first"))
    texts = keep(same.sortWithinPartitions(sector, "dl"), "asked-texts")
    many = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(many, np.int64)
        for batch in batches:
            df += np.bincount(pc.list_flatten(batch.column("term")).to_numpy(), minlength=many)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], ["term", "df"])

    found = rows.select("term").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row a term
    df = np.zeros(many, np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return Block(rows, texts, terms, df, rows.count())


def index(held: Block, key: str, terms: list[str]) -> Index:
    """The index of a few of the block's terms, from its rows alone."""
    spark, place = held.rows.sparkSession, pc.index_in(pa.array(terms, pa.string()), value_set=held.terms).to_pylist()
    named = spark.createDataFrame([(p, t, int(held.df[p])) for p, t in zip(place, terms, strict=True)], "place int, term string, df long")
    wanted = pa.array(place, pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, flat = _lists(batch.column("term"))
            there = np.flatnonzero(pc.is_in(flat, value_set=wanted).to_numpy(zero_copy_only=False))
            row = pa.array(np.searchsorted(at, there, "right") - 1)
            own = [flat.take(pa.array(there)), *(batch.column(c).take(row) for c in (key, "dl")), pc.list_flatten(batch.column("tf")).take(pa.array(there)).cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(own, ["place", key, "dl", "tf"])

    each = held.rows.select(key, "dl", "term", "tf").mapInArrow(run, f"place int, {key} {dict(held.rows.dtypes)[key]}, dl long, tf long")
    postings = each.join(F.broadcast(named.select("place", "term")), "place").drop("place")  # the given terms
    return Index(postings, named.where("df > 0").select("term", "df"), spark.createDataFrame([(held.n,)], "n long"))


def _seeds(held: Block, entity: str, sector: str) -> pa.Table:
    size = held.texts.select("first", entity, sector, F.size("term").alias("size")).where("size > 0")
    by = F.desc("size"), "first"
    some = size.withColumn("p", F.row_number().over(W.partitionBy(sector, entity).orderBy(*by))).where(F.col("p") <= SEEDS)
    few = some.withColumn("p", F.row_number().over(W.partitionBy(sector).orderBy(*by))).where(F.col("p") <= SECTOR_SEEDS)
    return held.texts.join(F.broadcast(few.select("first")), "first", "left_semi").select(entity, sector, "term", "tf").toArrow()  # some of a sector


def _floors(held: Block, requests: DataFrame, key: str, entity: str, sector: str, entities: int) -> DataFrame:
    """``key``, ``sectors``, ``places`` of the terms that occur, from the commonest to the rarest, and ``floor``: what the last of the best
    ``entities`` among the seeds has, 0 where there are fewer."""
    told = _seeds(held, entity, sector).combine_chunks()
    # seeds in order of their entities
    owner = told.column(entity).combine_chunks().dictionary_encode().indices if told.num_rows else pa.array([], pa.int32())
    by = np.argsort(pc.fill_null(owner, -1).to_numpy(zero_copy_only=False), kind="stable")
    told, owner = told.take(pa.array(by)), pc.fill_null(owner, -1).to_numpy(zero_copy_only=False)[by]
    firsts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    seeds, many = told.num_rows, len(held.terms)
    where = told.column(sector).combine_chunks() if seeds else pa.array([], pa.string())
    at, flat = _lists(told.column("term").combine_chunks()) if seeds else (np.zeros(1, np.int64), pa.array([], pa.int32()))
    term, seed = flat.to_numpy(), np.repeat(np.arange(seeds), np.diff(at))
    tf = pc.list_flatten(told.column("tf").combine_chunks()).to_numpy() if seeds else np.zeros(0)
    by = np.argsort(term, kind="stable")
    seed, share, begin = seed[by], (tf / (1 + tf))[by], np.searchsorted(term[by], np.arange(many + 1))
    terms, df = held.terms, held.df
    idf = np.log(1 + held.n / np.maximum(df, 1))
    step = max(1, 2**18 // max(1, seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, words = _lists(batch.column("keywords"))
            place = pc.index_in(words, value_set=terms).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            there = df[place] > 0
            row, place = row[there], place[there]
            by = np.lexsort((place, idf[place], row))
            place, at = place[by], np.searchsorted(row[by], np.arange(batch.num_rows + 1))
            wanted, named = _lists(batch.column("sectors"))
            of = np.repeat(np.arange(batch.num_rows), np.diff(wanted))
            names = pc.unique(where).drop_null() if seeds else pa.array([], pa.string())
            code, mine = (pc.fill_null(pc.index_in(x, value_set=names), len(names)).to_numpy(zero_copy_only=False) for x in (where, named))
            may = np.zeros((batch.num_rows, len(names) + 2), bool)  # the last but one: a sector that no seed has; the last: seeds without one
            may[of, np.where(mine < len(names), mine, len(names))] = True
            may[np.diff(wanted) == 0] = True
            code = np.where(code < len(names), code, len(names) + 1)
            floor = np.zeros(batch.num_rows)
            if len(firsts) >= entities:
                for a in range(0, batch.num_rows, step):
                    b = min(batch.num_rows, a + step)
                    own = place[at[a] : at[b]]
                    asks, sizes = np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), begin[own + 1] - begin[own]
                    found = _spread(begin[own], sizes)
                    cell = np.repeat(asks, sizes) * seeds + seed[found]
                    scores = np.bincount(cell, weights=share[found] * np.repeat(idf[own], sizes), minlength=(b - a) * seeds).reshape(b - a, seeds)
                    best = np.maximum.reduceat(np.where(may[a:b][:, code], scores, 0.0), firsts, axis=1)
                    floor[a:b] = np.partition(best, best.shape[1] - entities, axis=1)[:, -entities]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("sectors"), lists, pa.array(floor)], [key, "sectors", "places", "floor"])

    return requests.select(key, "sectors", "keywords").mapInArrow(run, f"{key} {dict(requests.dtypes)[key]}, sectors array<string>, places array<int>, floor double")


def _requests(number: np.ndarray, term: np.ndarray, start: np.ndarray, floor: np.ndarray, none: int) -> _Requests:
    """The requests ``number`` of all, by length."""
    lengths = start[number + 1] - start[number]
    by = np.argsort(lengths, kind="stable")
    number, lengths = number[by], lengths[by]
    # rounded up by an eighth at most
    step = 2 ** np.maximum(0, np.frexp(lengths)[1] - 4)
    rounded = -(-lengths // step) * step
    ends = np.append(np.flatnonzero(rounded[1:] != rounded[:-1]) + 1, len(number)) if len(number) else np.zeros(0, np.int64)
    alike = []
    for a, b in zip(np.append(0, ends), ends, strict=False):
        place = np.arange(int(rounded[a]))[:, None]
        at = np.minimum(start[number[a:b]] + place, start[number[a:b] + 1] - 1)
        alike.append((int(a), int(b), np.where(place < lengths[a:b], term[at], none)))
    return _Requests(number, term[_spread(start[number], lengths)], np.append(0, np.cumsum(lengths)), floor[number], alike)


def _slices(batch: pa.RecordBatch, sector: str, texts: int, postings: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of one sector, and where they are cut into at most ``SLICES`` runs of ``texts`` rows and ``postings`` terms at most, or of one row."""
    code = pc.fill_null(batch.column(sector).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    ends, _ = _lists(batch.column("term"))
    change = np.append(np.flatnonzero(code[1:] != code[:-1]) + 1, batch.num_rows)
    cuts = [0]
    while cuts[0] < batch.num_rows:
        a, end = cuts[-1], int(change[np.searchsorted(change, cuts[0], "right")])
        if a == end or len(cuts) > SLICES:
            yield batch.slice(cuts[0], a - cuts[0]), np.array(cuts) - cuts[0]
            cuts = [a]
        else:
            cuts.append(max(a + 1, min(a + texts, end, int(np.searchsorted(ends, ends[a] + postings, "right")) - 1)))


def _live(asks: _Requests, parts: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Requests and slices of which the greatest ``parts`` together (a line a term, which ``line`` tells by the term's number, and a column a
    slice) reach the floor."""
    slices, out = parts.shape[1], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for first, end, terms in asks.alike:
        for a in range(first, end, REQUESTS):
            b = min(end, a + REQUESTS)
            bound, part = np.zeros((b - a, slices), np.float32), np.empty((b - a, slices), np.float32)
            for own in terms[:, a - first : b - first]:
                parts.take(line[own], axis=0, out=part, mode="clip")
                bound += part
            low = (asks.floor[a:b] - SLACK) * (1 - 1.2e-7 * (len(terms) + 8))  # by as much as single precision may lose
            at = np.flatnonzero((bound >= low.astype(np.float32)[:, None]) & (bound > 0))
            out.append((at // slices + a, at % slices))
    request, of = map(np.concatenate, zip(*out, strict=True))
    by = np.argsort(of, kind="stable")
    return request[by], of[by]


def _of_slices(asks: _Requests, idf: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, cuts: np.ndarray, pairs: int, scratch: _Scratch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Requests, texts and scores of the pairs that reach the requests' floors. The texts are cut into slices of like length."""
    of = np.searchsorted(cuts, row, "right") - 1
    pair = of * len(idf) + term
    by = np.argsort(pair, kind="stable")
    row, term, tf, pair = row[by], term[by], tf[by], pair[by]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    most, own, slices = np.maximum.reduceat(tf, first), term[first], len(cuts) - 1
    held = np.unique(own)
    line = np.zeros(len(idf) + 1, np.int64)  # the first line is that of terms which no text has
    line[held] = 1 + np.arange(len(held))
    parts = np.zeros((len(held) + 1, slices), np.float32)
    parts[line[own], pair[first] // len(idf)] = most / (1 + most) * idf[own]
    live, of = _live(asks, parts, line)
    some, posted = np.searchsorted(of, np.arange(slices + 1)), np.searchsorted(pair, np.arange(slices + 1) * len(idf))
    for i in np.flatnonzero(some[1:] > some[:-1]):
        a, b = posted[i], posted[i + 1]
        for request, text, score in _of_slice(asks, live[some[i] : some[i + 1]], idf, row[a:b] - cuts[i], term[a:b], tf[a:b], int(cuts[i + 1] - cuts[i]), pairs, scratch):
            yield request, text + cuts[i], score


def _of_slice(asks: _Requests, live: np.ndarray, idf: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, texts: int, pairs: int, scratch: _Scratch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of one slice, whose postings are in order of their terms, and the requests ``live``."""
    most, column, asked, line, total, last = scratch
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    own, sizes = term[first], np.diff(np.append(first, len(term)))
    shares = np.arange(tf.max() + 1.0)
    shares /= 1 + shares
    most[own], column[own] = shares[np.maximum.reduceat(tf, first)] * idf[own], np.arange(len(own))
    lengths, low = asks.start[live + 1] - asks.start[live], asks.floor[live] - SLACK
    entry, ends = asks.term[_spread(asks.start[live], lengths)], np.cumsum(lengths)
    begins, part = ends - lengths, most[entry]
    most[own] = 0
    # what a pair must have before this term and all commoner ones are looked up
    upto = np.cumsum(part)
    due = np.repeat(low + upto[begins] - part[begins], lengths) - upto
    # the common terms that cannot reach the floor together, and so bring no text into the list
    needed = due <= 0
    common = lengths - np.add.reduceat(needed, begins, dtype=np.int64)
    next_place, is_first = begins + common - 1, np.zeros(len(entry), bool)
    is_first[begins] = True
    enough = np.where(common > 0, due[next_place], low)
    # a table of the terms that are looked up; its first line is that of terms which no text has
    asked[entry[~needed]] = True
    there = asked[own]
    asked[entry[~needed]] = False
    lines = (1 + np.arange(int(there.sum()))) * texts
    line[own[there]] = lines
    table = np.zeros((len(lines) + 1) * texts, np.min_scalar_type(int(tf.max())))
    posted = np.repeat(there, sizes)
    table[np.repeat(lines, sizes[there]) + row[posted]] = tf[posted]
    share, used = shares[tf], np.flatnonzero(needed & (part > 0))
    of = column[entry[used]]
    times, ask = sizes[of], np.searchsorted(ends, used, "right")
    before, request_at = np.append(0, np.cumsum(times)), np.searchsorted(ask, np.arange(len(live) + 1))
    wide = max(1, pairs // texts)
    x = 0
    while x < len(live):
        # a request's terms stay together
        y = int(np.searchsorted(before[request_at], before[request_at[x]] + pairs, "right")) - 1
        y = min(max(x + 1, y), x + wide, len(live))
        a, b = request_at[x], request_at[y]
        found = _spread(first[of[a:b]], times[a:b])
        cell = np.repeat((ask[a:b] - x) * texts, times[a:b]) + row[found]
        np.add.at(total, cell, share[found] * np.repeat(idf[entry[used[a:b]]], times[a:b]))
        score = total[cell]
        can = score >= np.repeat(enough[ask[a:b]], times[a:b])
        total[cell] = 0
        cell, score = cell[can], score[can]
        number = np.arange(len(cell))
        last[cell] = number
        once = last[cell] == number
        cell, score = cell[once], score[once]
        request, text = cell // texts + x, cell % texts
        done = common[request] == 0
        if done.any():
            yield live[request[done]], text[done], score[done]
            request, text, score = request[~done], text[~done], score[~done]
        place = next_place[request]
        while len(place):
            next_term = entry[place]
            score += shares[table[line[next_term] + text]] * idf[next_term]
            done = is_first[place]
            if done.any():
                request = np.searchsorted(begins, place[done])
                held = score[done] >= low[request]
                yield live[request[held]], text[done][held], score[done][held]
                place, text, score = place[~done], text[~done], score[~done]
            place = place - 1
            can = np.flatnonzero(score >= due[place])
            place, text, score = place[can], text[can], score[can]
        x = y
    line[own] = 0


def _best(held: Block, requests: DataFrame, key: str, entity: str, sector: str, entities: int) -> DataFrame:
    told = _floors(held, requests, key, entity, sector, entities).toArrow().combine_chunks()
    kinds = dict(requests.dtypes)[key], dict(held.texts.dtypes)[entity]
    column = lambda c: told.column(c).combine_chunks() if told.num_rows else pa.array([], told.schema.field(c).type)
    keys, floor = column(key), column("floor").to_numpy()
    start, terms = _lists(column("places"))
    term = terms.to_numpy()
    wanted, named = _lists(column("sectors"))
    names = pc.unique(named)
    of, code = np.repeat(np.arange(len(keys)), np.diff(wanted)), pc.index_in(named, value_set=names).to_numpy(zero_copy_only=False)
    anywhere = np.diff(wanted) == 0
    idf = np.log(1 + held.n / np.maximum(held.df, 1))
    texts, postings, pairs = TEXTS, POSTINGS, PAIRS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_sector: dict[int, _Requests] = {}
        some = np.zeros(len(idf), bool)
        some[term] = True  # other terms are of other blocks
        scratch = _scratch(len(idf), max(pairs, texts))

        def asking(at: int) -> _Requests:
            if at not in of_sector:
                may = anywhere.copy()
                may[of[code == at]] = True
                of_sector[at] = _requests(np.flatnonzero(may & (np.diff(start) > 0)), term, start, floor, len(idf))
            return of_sector[at]

        def scored(batch: pa.RecordBatch, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            at, flat = _lists(batch.column("term"))
            held_terms = flat.to_numpy()
            own = np.flatnonzero(some[held_terms])
            value = batch.column(sector)[0]
            number = pc.index_in(pa.array([value.as_py()], pa.string()), value_set=names)[0].as_py() if value.is_valid else None
            asks = asking(-1 if number is None else number)
            if len(own) and len(asks.number):
                row, tf = np.repeat(np.arange(batch.num_rows), np.diff(at))[own], pc.list_flatten(batch.column("tf")).to_numpy()[own]
                for request, text, score in _of_slices(asks, idf, row, held_terms[own], tf, cuts, pairs, scratch):
                    yield asks.number[request], text, score

        def told_of(batch: pa.RecordBatch, out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            request, text, score = map(np.concatenate, zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([keys.take(pa.array(request)), batch.column(entity).take(pa.array(text)), pa.array(score)], [key, entity, "best"])

        for whole in batches:
            for batch, cuts in _slices(whole, sector, texts, postings):
                out, size = [], 0
                for x in scored(batch, cuts):
                    out.append(x)
                    size += len(x[0])
                    if size >= FOUND:
                        yield told_of(batch, out)
                        out, size = [], 0
                if out:
                    yield told_of(batch, out)

    found = held.texts.select(entity, sector, "term", "tf").mapInArrow(run, f"{key} {kinds[0]}, {entity} {kinds[1]}, best double")
    return top(found.groupBy(key, entity).agg(F.round(F.max("best"), 6).alias("best")), key, "best", entity, entities).drop("rank")


def best(documents: DataFrame, plans: DataFrame, lexicon: list[str], key: str, doc: str, entity: str, sector: str, entities: int, keep: Keep) -> tuple[DataFrame, Index]:
    """``key``, ``entity`` and ``best`` (rounded) of the ``entities`` best of each request of ``plans`` (``key``, ``sectors``, ``keywords``) that has
    keywords, of its sectors if it names any; and the index of the ``lexicon``'s terms. ``documents``: ``doc``, ``entity``, ``sector`` (a string),
    ``text``. ``keep(table, name)`` stores a table and reads it back."""
    said = plans.where((F.size("keywords") > 0) & F.col(key).isNotNull())
    # rows of one key are one request: of any sector, if one of them is
    listed = F.collect_list(F.struct("sectors", "keywords"))
    joined = said.groupBy(key).agg(listed.alias("x"))
    sectors = F.when(F.exists("x", lambda e: F.size(e["sectors"]) == 0), F.array().cast("array<string>")).otherwise(F.array_distinct(F.flatten(F.transform("x", lambda e: e["sectors"]))))
    named = joined.select(key, F.array_sort(sectors).alias("sectors"), F.array_sort(F.flatten(F.transform("x", lambda e: e["keywords"]))).alias("keywords"))
    own = keep(named.withColumn("ask", F.md5(F.to_json(F.struct("sectors", "keywords")).cast("binary"))), "requests")
    requests = keep(own.groupBy("ask").agg(F.first("sectors").alias("sectors"), F.first("keywords").alias("keywords")), "asked")
    always = documents.sparkSession.createDataFrame([(t,) for t in lexicon], "term string")
    vocabulary = keep(requests.select(F.explode("keywords").alias("term")).union(always).distinct(), "asked-terms")
    entries = requests.agg(F.sum(F.size("keywords"))).first()[0] or 0
    passes = 1 if vocabulary.count() <= VOCABULARY else -(-entries // VOCABULARY)
    out, of_lexicon = None, None
    for i in range(passes):
        part = requests.where(F.pmod(F.xxhash64("ask"), F.lit(passes)) == i)
        terms = vocabulary if passes == 1 else part.select(F.explode("keywords").alias("term")).union(always).distinct()
        held = block(documents, terms, doc, entity, sector, keep)
        of_lexicon = of_lexicon or index(held, doc, lexicon)
        blocks = max(1, -(-entries // (passes * BLOCK_TERMS)))
        for j in range(blocks):
            some = part.where(F.pmod(F.xxhash64(F.lit("block"), "ask"), F.lit(blocks)) == j)
            found = keep(_best(held, some, "ask", entity, sector, entities), "best-entities")
            out = found if out is None else out.union(found)
    return own.select(key, "ask").join(out, "ask").drop("ask"), of_lexicon
