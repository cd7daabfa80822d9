"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of the longest length as fit, then the
binary digits of the rest from high to low. Each piece is a sequence of its own, so no sequence crosses documents and
none is padded; pieces of one length form a bucket, from which batches of equal shape are drawn.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import pieces


def decompose(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


#: Fixed value: the added token of ``byte_bpe_50k.json``, which stands for its string wherever a text holds it.
ADDED = {"<|endoftext|>": 50256}


class Encoder:
    """Ids of whole texts as ``encode(text, add_special_tokens=False)`` of the ``tokenizers`` library gives them; an added
    token's string is that token.

    ``path`` is a ``.json`` file of that library, or a ``.tiktoken`` file with the ranks of the same byte-level vocabulary,
    whose ids are equal and which is encoded about five times as fast; that one needs ``pattern``, the expression that
    splits a text into words, and ``added``, the added tokens.
    """

    def __init__(self, path: str, pattern: str | None = None, added: dict[str, int] = ADDED):
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
            self._all = lambda texts: [encoding.encode_to_numpy(t, allowed_special="all") for t in texts]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self._all = lambda texts: [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        return self._all([t or "" for t in texts])


def pack(documents: DataFrame, tokenizer: str, pattern: str | None = None, longest: int = 2048, end_id: int = 1, with_ids: bool = True, added: dict[str, int] = ADDED) -> DataFrame:
    """Pieces of all documents (``doc_id``, ``text``): one row a piece, which is one sequence.

    ``doc_id``, ``start`` (the document's ids before it), ``length``, ``bucket`` (log2 of the length), ``ids`` (only
    ``with_ids``), ``ids_crc32``, ``doc_tokens`` (ids of the document with ``end_id``), ``sequence_id`` and ``offset``
    (always 0). ``sequence_id`` is unique; it follows the rows' places in the input, so equal rows, equal or null
    ``doc_id`` get sequences of their own. A null or empty text has one piece with ``end_id`` alone. Other columns of the
    input are not carried. No shuffle: a task packs what it reads, and memory follows a few MB of text or one document.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, pattern, added)
        for batch in pieces(batches):
            row, start, length, crc, tokens, values = [], [], [], [], [], []
            for i, ids in enumerate(encode(batch.column("text").to_pylist())):
                own = np.append(ids, np.uint32(end_id)).astype("<u4")
                at = 0
                for n in decompose(len(own), longest):
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(own[at : at + n].tobytes()))
                    tokens.append(len(own))
                    if with_ids:
                        values.append(own[at : at + n])
                    at += n
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.concatenate(values).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])

    key = dict(documents.dtypes)["doc_id"]
    found = documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)
    return found.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder a length: a training job reads batches of equal shape. No shuffle; each task adds a file to each folder it has rows for."""
    packed.write.partitionBy("bucket").parquet(path)
