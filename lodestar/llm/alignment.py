"""Alignment of two tokenizers over the same texts.

Both tokenizers cut a space and the text into tokens, each a run of bytes. The union of their token ends cuts the bytes
into elementary intervals; a search in either array of ends gives each interval's owner, so that every interval is one
pair of overlapping tokens, a link. Where both have an end, a group closes: the shortest runs of tokens of either side
that cover the same bytes. A block of several documents is aligned at once, as a document's end is an end on both sides.

How many links of the whole corpus hold a pair of ids is counted in two steps: a task counts the distinct pairs of a
block, Spark sums them by pair, and the sums go back to the blocks that hold the pair. What is shuffled is thus a block's
distinct pairs and not its links, a pair that every document holds has one row a block, and a task holds one block.

Defined results. Texts that are null or empty, or that a tokenizer does not give back byte by byte after the space, have
no tokens: zeros and an empty ``groups_sha256``. Special tokens' strings in a text are plain text. Repeated rows, also of
one or of a null ``doc_id``, are aligned and counted each. Ties for a pair's highest count all count as best. Texts are
taken whole; one longer than a block is a block of its own. Only ``doc_id`` and ``text`` are read. No rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import save
from .textkernel import pieces

BLOCK_BYTES = 2 << 20


class Vocabulary(NamedTuple):
    """A tokenizer as the alignment needs it: the bytes of each id, and the ids of texts that stand after a space."""

    token_bytes: list[bytes]
    encode: Callable[[list[str]], list[np.ndarray]]


@lru_cache
def byte_level(path: str, pattern: str | None = None) -> Vocabulary:
    """A byte-level BPE from a ``.json`` file, or from the ``.tiktoken`` ranks of the same vocabulary with its ``pattern``,
    which give equal ids in a fifth of the time."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        names = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            names[rank] = token
        return Vocabulary(names, lambda texts: [plain.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts])
    from tokenizers import Tokenizer

    with open(path) as file:
        of_text = json.load(file)["model"]["vocab"]
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    # the byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for those after U+0100
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in kept]
    byte_of = {chr(b): b for b in kept} | {chr(0x100 + i): b for i, b in enumerate(moved)}
    names = [b""] * (max(of_text.values()) + 1)
    for token, i in of_text.items():
        names[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return Vocabulary(names, lambda texts: [np.array(x.ids, np.int64) for x in tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)])


@lru_cache
def piece_level(path: str) -> Vocabulary:
    """A SentencePiece model that puts the space in front itself and falls back to bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        names.append(bytes.fromhex(byte[1]) if byte and model.is_byte(i) else piece.replace("▁", " ").encode())
    return Vocabulary(names, lambda texts: [np.array(x, np.int64) for x in model.encode(texts, num_threads=1)])


class Aligned(NamedTuple):
    """Documents one after another. ``at_*`` are offsets by document; a link is a place in ``a_ids`` and one in ``b_ids``."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    a_group: np.ndarray  # number of each token's group
    b_group: np.ndarray
    at_group: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    at_link: np.ndarray


def _given_back(ids: np.ndarray, at: np.ndarray, names: list[bytes], raw: np.ndarray, at_raw: np.ndarray) -> np.ndarray:
    """Whether each text's tokens are its bytes, one after another."""
    sizes = np.array([len(x) for x in names], np.int64)
    own = sizes[ids]
    same = np.diff(np.concatenate([[0], np.cumsum(own)])[at]) == np.diff(at_raw)
    if not same.all():  # texts of another length would shift those after them
        return np.array([bool(ok) and b"".join([names[k] for k in ids[i:j].tolist()]) == raw[m:n].tobytes() for ok, i, j, m, n in zip(same, at[:-1], at[1:], at_raw[:-1], at_raw[1:], strict=True)])
    starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(names), np.uint8)
    differs = np.flatnonzero(flat[np.repeat(starts[ids] - (np.cumsum(own) - own), own) + np.arange(len(raw))] != raw)
    same[np.searchsorted(at_raw, differs, side="right") - 1] = False
    return same


def _offsets(sizes: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``np.union1d`` of two arrays that are in order: a stable sort merges two runs in linear time."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.append(True, both[1:] != both[:-1])[: len(both)]]


def align_texts(texts: list[str | None], a: Vocabulary, b: Vocabulary) -> Aligned:
    """Groups and links of every text."""
    chosen = [i for i, t in enumerate(texts) if t]
    raws = [b" " + texts[i].encode() for i in chosen]
    raw, at_raw = np.frombuffer(b"".join(raws), np.uint8), _offsets([len(r) for r in raws])
    some = [texts[i] for i in chosen]
    sides, good = [], np.ones(len(chosen), bool)
    for v in (a, b):
        lists = v.encode(some)
        ids, at = np.concatenate([*lists, np.zeros(0, np.int64)]), _offsets([len(x) for x in lists])
        good &= _given_back(ids, at, v.token_bytes, raw, at_raw)
        sides.append((ids, at))
    sizes = np.zeros(len(texts), np.int64)
    sizes[np.array(chosen, np.int64)[good]] = np.diff(at_raw)[good]
    tokens, ats, ends = [], [], []
    for (ids, at), v in zip(sides, (a, b), strict=True):
        n = np.zeros(len(texts), np.int64)
        n[np.array(chosen, np.int64)[good]] = np.diff(at)[good]
        tokens.append(ids if good.all() else ids[np.repeat(good, np.diff(at))])
        ats.append(_offsets(n))
        ends.append(np.cumsum(np.array([len(x) for x in v.token_bytes], np.int64)[tokens[-1]]))
    last, (ends_a, ends_b) = np.cumsum(sizes), ends
    cuts, both = _union(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
    # documents without tokens end where the one before them ends; an offset counts the ends up to a document's own
    within = lambda at_ends: np.concatenate([[0], np.searchsorted(at_ends, last, side="right")])
    return Aligned(
        *tokens, *ats, np.searchsorted(both, ends_a), np.searchsorted(both, ends_b), within(both),
        np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts), within(cuts),
    )


def _marked(ids: list[bytes], mark: bytes) -> np.ndarray:
    out = np.empty(len(ids), object)
    out[:] = [x + mark for x in ids]
    return out


class _Digests:
    """Digest of a document's groups, written ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        numbers = [b"%d" % i for i in range(max(len(a.token_bytes), len(b.token_bytes)))]
        self.inner, self.a_last, self.b_last = (_marked(numbers, m) for m in (b",", b"|", b";"))

    def __call__(self, x: Aligned) -> list[str]:
        groups = int(x.at_group[-1])
        before_b = np.concatenate([[0], np.cumsum(np.bincount(x.b_group, minlength=groups))])
        upto_a = np.cumsum(np.bincount(x.a_group, minlength=groups)) if groups else np.zeros(0, np.int64)
        out = np.empty(len(x.a_ids) + len(x.b_ids), object)
        for ids, group, place, last in (
            (x.a_ids, x.a_group, np.arange(len(x.a_ids)) + before_b[x.a_group], self.a_last),
            (x.b_ids, x.b_group, np.arange(len(x.b_ids)) + upto_a[x.b_group], self.b_last),
        ):
            ends = np.append(group[1:] != group[:-1], True)[: len(group)]
            out[place] = np.where(ends, last[ids], self.inner[ids])
        at = (x.at_a + x.at_b).tolist()
        return [hashlib.sha256(b"".join(out[i:j].tolist())[:-1]).hexdigest() if j > i else "" for i, j in zip(at[:-1], at[1:], strict=True)]


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.col("text").cast("string").alias("text"))


def _list(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))


def aligned(documents: DataFrame, a: Callable[[], Vocabulary], b: Callable[[], Vocabulary]) -> DataFrame:
    """The alignment itself, one row a document: ``doc_id``, ``a_ids``, ``b_ids``, ``a_group`` and ``b_group`` (number of
    each token's group, from 0), ``link_a`` and ``link_b`` (places of the linked tokens, from 0). No shuffle. ``a`` and
    ``b`` open a tokenizer in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = a(), b()
        for batch in pieces(batches, most=BLOCK_BYTES):
            x = align_texts(batch.column("text").to_pylist(), va, vb)
            own = lambda values, at, base: _list(values - np.repeat(base, np.diff(at)), at)
            columns = [
                batch.column("doc_id"), _list(x.a_ids, x.at_a), _list(x.b_ids, x.at_b),
                own(x.a_group, x.at_a, x.at_group[:-1]), own(x.b_group, x.at_b, x.at_group[:-1]),
                own(x.link_a, x.at_link, x.at_a[:-1]), own(x.link_b, x.at_link, x.at_b[:-1]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a_ids", "b_ids", "a_group", "b_group", "link_a", "link_b"])

    lists = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_group", "b_group", "link_a", "link_b"))
    return _texts(documents).mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, {lists}")


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(documents: DataFrame, a: Callable[[], Vocabulary], b: Callable[[], Vocabulary]) -> DataFrame:
    """Rows of two kinds: a document with its counts and the places of its distinct pairs, and a block's distinct pair
    with its place and how many links of the block hold it."""
    key = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = a(), b()
        digests, block = _Digests(va, vb), TaskContext.get().partitionId() << 32
        for batch in pieces(batches, most=BLOCK_BYTES):
            x, n = align_texts(batch.column("text").to_pylist(), va, vb), batch.num_rows
            pairs, place, held = np.unique(x.a_ids[x.link_a] << 32 | x.b_ids[x.link_b], return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(n), np.diff(x.at_link))
            own, times = np.unique(row << 32 | place, return_counts=True)
            at = np.searchsorted(own >> 32, np.arange(n + 1))
            counts = [pa.array(np.diff(o)) for o in (x.at_a, x.at_b, x.at_group, x.at_link)]
            is_doc = {"doc_id": batch.column("doc_id"), **dict(zip(_COUNTS, counts, strict=True)), "groups_sha256": pa.array(digests(x)), "places": _list(own & 0xFFFFFFFF, at), "times": _list(times, at)}
            is_pair = {"place": pa.array(np.arange(len(pairs), dtype=np.int32)), "pair": pa.array(pairs), "held": pa.array(held.astype(np.int64))}
            types = {k: v.type for k, v in (is_doc | is_pair).items()}
            for rows, some in ((n, is_doc), (len(pairs), is_pair)):
                columns = [some[k] if k in some else pa.nulls(rows, kind) for k, kind in types.items()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, block)), *columns], ["block", *types])
            block += 1

    schema = f"doc_id {key}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, places array<int>, times array<int>, place int, pair long, held long"
    return _texts(documents).mapInArrow(run, f"block long, {schema}")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair``, ``count`` (links of the corpus that hold it) and ``best`` (no pair of its B id has a higher one). The highest
    counts are one row an id of B's vocabulary, and are broadcast."""
    counts = blocks.where("pair is not null").groupBy("pair").agg(F.sum("held").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def summaries(documents: DataFrame, a: Callable[[], Vocabulary], b: Callable[[], Vocabulary]) -> DataFrame:
    """One row a document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``n_best`` (links
    whose pair is best for its B id) and ``count_sum`` (sum of the pairs' counts over its links)."""
    blocks = save(_blocks(documents, a, b), "blocks")
    pairs = blocks.where("pair is not null").select("block", "place", "pair")
    told = pairs.join(pair_counts(blocks), "pair").select(F.col("block").alias("of_block"), "place", "count", "best")
    docs = blocks.where("pair is null").select("block", "doc_id", *_COUNTS, "groups_sha256", "places", "times")

    def finish(own: pa.Table, found: pa.Table) -> pa.Table:
        count, best = np.zeros((2, found.num_rows), np.int64)
        place = found.column("place").to_numpy()
        count[place], best[place] = found.column("count").to_numpy(), found.column("best").to_numpy()
        places, times = (own.column(c).combine_chunks() for c in ("places", "times"))
        at = places.offsets.to_numpy().astype(np.int64)
        which, often = places.values.to_numpy()[at[0] : at[-1]], times.values.to_numpy()[times.offsets[0].as_py() :][: at[-1] - at[0]].astype(np.int64)
        sums = (np.concatenate([[0], np.cumsum(v[which] * often)]) for v in (best, count))
        n_best, count_sum = (pa.array(s[at[1:] - at[0]] - s[at[:-1] - at[0]]) for s in sums)
        return own.select(["doc_id", *_COUNTS, "groups_sha256"]).append_column("n_best", n_best).append_column("count_sum", count_sum)

    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, n_best long, count_sum long"
    return docs.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(finish, schema)
