import hashlib
from collections import Counter
from functools import partial

import public_tokenizers as P
import pytest

from lodestar.llm import alignment

TEXTS = [
    (1, "Hello  world, it's\n\n two  lines "), (2, None), (3, ""), (4, "<|endoftext|> </s> <0x41> <unk>"), (5, "don't stop"), (5, "don't stop"),
    (6, "naïve Ünïcode 　 z 日本語 😀\ttab"), (7, "word " * 3000), (8, "a"), (9, " "), (10, "an ▁ underline"), (None, "x\x00y"), (11, "zyxwv" * 40),
]


a = partial(alignment.byte_level, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
b = partial(alignment.piece_level, P.path("piece_bpe_32k.model"))


def plain(texts, va, vb):
    """Spans of both sides compared one with another."""
    out = []
    for t in texts:
        ids, spans = [], []
        for v in (va, vb):
            own = v.encode([t])[0].tolist() if t else []
            at, some = 0, []
            for i in own:
                some.append((at, at + len(v.token_bytes[i])))
                at += len(v.token_bytes[i])
            if t and b"".join(v.token_bytes[i] for i in own) != b" " + t.encode():
                own = None
            ids.append(own)
            spans.append(some)
        if None in ids:
            ids, spans = [[], []], [[], []]
        links = [(i, j) for i, (p, q) in enumerate(spans[0]) for j, (r, s) in enumerate(spans[1]) if max(p, r) < min(q, s)]
        both = sorted({q for _, q in spans[0]} & {s for _, s in spans[1]})
        groups, low = [], 0
        for high in both:
            groups.append(tuple([i for i, (p, q) in zip(side, sp, strict=True) if low <= p and q <= high] for side, sp in zip(ids, spans, strict=True)))
            low = high
        out.append((*ids, groups, links))
    return out


def test_summaries_equal_plain_version(spark):
    rows = [(i, t if t != "word " * 3000 else "word " * 200) for i, t in TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, count = [], Counter()
    found = plain([t for _, t in rows], a(), b())
    for ia, ib, _, links in found:
        count.update((ia[i], ib[j]) for i, j in links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(n, best.get(y, 0))
    for (doc, _), (ia, ib, groups, links) in zip(rows, found, strict=True):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n = [count[ia[i], ib[j]] for i, j in links]
        n_best = sum(k == best[ib[j]] for k, (_, j) in zip(n, links, strict=True))
        want.append((doc or -1, len(ia), len(ib), len(groups), len(links), hashlib.sha256(told.encode()).hexdigest() if told else "", n_best, sum(n)))
    got = [(r.doc_id if r.doc_id is not None else -1, *r[1:]) for r in alignment.summaries(docs, a, b).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[1] == 0 for r in got) == 3  # null, empty, and the text that does not come back


def test_aligned_rows(spark):
    texts = ["Hello  world, it's", None, "naïve 日本"]
    rows = alignment.aligned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), a, b).orderBy("doc_id").collect()
    for r, (ia, ib, groups, links) in zip(rows, plain(texts, a(), b()), strict=True):
        assert (r.a_ids, r.b_ids) == (ia, ib)
        assert list(zip(r.link_a, r.link_b, strict=True)) == links
        assert [([i for i, g in zip(r.a_ids, r.a_group, strict=True) if g == k], [i for i, g in zip(r.b_ids, r.b_group, strict=True) if g == k]) for k in range(len(groups))] == groups


def test_both_files_of_a_vocabulary_agree():
    json_file = alignment.byte_level(P.path("byte_bpe_50k.json"))
    texts = [t for _, t in TEXTS if t]
    assert json_file.token_bytes[:50256] == a().token_bytes[:50256]
    assert [x.tolist() for x in json_file.encode(texts)] == [x.tolist() for x in a().encode(texts)]


def test_blocks_do_not_matter(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1)
    whole = sorted(map(str, alignment.summaries(docs, a, b).collect()))
    assert sorted(map(str, alignment.summaries(docs.repartition(7), a, b).collect())) == whole


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]])
def test_nothing_to_align(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as n_a")
    got = alignment.summaries(docs, a, b).collect()
    assert sorted(r[1:] for r in got) == [(0, 0, 0, 0, "", 0, 0)] * len(rows)
