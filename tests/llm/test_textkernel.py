import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import textkernel as K

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé \n\tz.", max_size=30)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = K.words(pa.array(texts, pa.string()))
    known: dict[str, int] = {}
    at = 0
    for row, text in enumerate(texts):
        for word in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)):
            assert w.row[at] == row
            assert known.setdefault(word, int(w.hash[at])) == w.hash[at]
            at += 1
    assert at == len(w.hash)
    assert len(set(known.values())) == len(known)


def test_blocks_do_not_change_words(monkeypatch):
    text = ["one two  three " * 50 + "x" * 400 + " four", None, "", "five"]
    whole = K.words(pa.array(text))
    monkeypatch.setattr(K, "_BLOCK", 64)
    small = K.words(pa.array(text))
    assert (whole.hash == small.hash).all() and (whole.row == small.row).all() and (whole.start == small.start).all()


def test_shingles_of_short_rows():
    rows, hashes = K.shingles(K.words(pa.array(["a b c", "a", None, "a b", "b a"])), 2)
    assert rows.tolist() == [0, 0, 1, 3, 4]
    assert hashes[0] == hashes[3] and hashes[4] not in hashes[:4]


def test_pieces_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 500, "z"])], ["text"])
    parts = list(K.pieces(iter([batch]), most=20))
    assert [t for p in parts for t in p.column("text").to_pylist()] == ["x" * 10, None, "y" * 500, "z"]
    assert np.sum([p.num_rows for p in parts]) == 4
