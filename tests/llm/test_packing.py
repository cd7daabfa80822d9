import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lodestar.llm import packing

TEXTS = ["Hello  world, it's\n\n two  lines ", None, "", "<|endoftext|> x", "a <|endoftext|> b<|endoftext|><|endoftext", "don't  <|endoftext|>\n ", "naïve Ünïcode 　 z", "word " * 3000, "a"]


@pytest.fixture(scope="module")
def expected():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(TEXTS)}


def test_decompose():
    assert packing.decompose(5, 4) == [4, 1]
    assert packing.decompose(4096 + 3, 2048) == [2048, 2048, 2, 1]
    assert packing.decompose(0, 8) == []
    for n in range(1, 200):
        assert sum(packing.decompose(n, 16)) == n


@pytest.mark.parametrize("file", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json"])
def test_round_trip(spark, expected, file):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    rows = packing.pack(df, P.path(file), P.PATTERN, longest=64).orderBy("doc_id", "start").collect()
    got: dict = {}
    for r in rows:
        assert r.start == len(got.setdefault(r.doc_id, []))
        assert r.length & (r.length - 1) == 0 and r.length <= 64 and r.bucket == r.length.bit_length() - 1
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.doc_tokens == len(expected[r.doc_id]) and r.offset == 0
        got[r.doc_id] += r.ids
    assert got == expected
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    twice = spark.createDataFrame([(None, "x"), (None, "x")], "doc_id long, text string")
    rows = packing.pack(twice, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(rows) == len({r.sequence_id for r in rows}) == 2


def test_write_buckets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c"), (2, "a")], "doc_id long, text string")
    packed = packing.pack(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    packing.write_buckets(packed, f"file://{tmp_path}/b")
    back = spark.read.parquet(f"file://{tmp_path}/b")
    assert back.count() == packed.count()


def test_a_very_long_text_is_packed_whole(spark):
    text = "some words, and more of them. " * 60_000
    rows = packing.pack(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=False).where("doc_id = 1").collect()
    n = len(packing.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)([text])[0]) + 1
    assert sum(r.length for r in rows) == n == rows[0].doc_tokens and sorted(r.start for r in rows)[-1] < n and all(r.length <= 2048 for r in rows)
