"""Sections and chunks of the driver's pages and documents, against plain loops."""

import html as entities
import re

import plain_structure as S
import pytest

import __spark_entry__ as entry
from lodestar.functions.text import BOILERPLATE, NOISE_TAGS

SF = "/root/testdata/sf0.001"


def plain_sections(page):
    page = re.sub(r"(?s)<!--.*?-->", "", page)
    main = next((m.group(1) for t in ("main", "article", "body") if (m := re.search(rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", page))), page)
    for tag in NOISE_TAGS:
        main = re.sub(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "", main)
    out, heading = [[0, "", ""]], None
    for part in re.split(r"(<[^>]+>)", main):
        m = re.match(r"</?([a-zA-Z0-9]+)", part)
        tag = m.group(1).lower() if m else ""
        if tag in ("h1", "h2", "h3"):
            if part.startswith("</"):
                out.append([int(tag[1]), " ".join(heading.split()), ""])
                heading = None
            else:
                heading = ""
        elif part.startswith("<"):
            out[-1][2] += "\n" if tag in S.BLOCK_TAGS else ""
        elif heading is not None:
            heading += entities.unescape(part)
        else:
            out[-1][2] += entities.unescape(part)
    made = []
    for level, title, body in out:
        lines = [" ".join(x.split()) for x in body.split("\n")]
        good = [x for x in lines if (len(x.split()) > 2 or x[-1:] in tuple(".!?:")) and not x.startswith("*") and not any(p in x.lower() for p in (*BOILERPLATE, "========", "<a href", "<center", 'class="'))]
        body = "\n".join(x for x in good if x)
        if title or body:
            made.append((level, title, body))
    return made


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def test_html_sections_equal_a_plain_walk(spark, pages):
    got = {}
    for r in entry.queries()["html_sections"](spark, SF).orderBy("page_id", "ordinal").collect():
        got.setdefault(r.page_id, []).append((r.level, r.title, r.body))
    assert got == {k: v for k, p in pages.items() if (v := plain_sections(p.html or ""))}


@pytest.mark.parametrize("name,key", [("chunk_structural", "page_id"), ("chunk_markdown", "doc_id")])
def test_chunks_hold_all_words_under_the_ceiling(spark, pages, name, key):
    got = {}
    for r in entry.queries()[name](spark, SF).orderBy(key, "ordinal").collect():
        assert r.ordinal == len(got.setdefault(r[key], [])) and r.indexed == f"{r.path}\n\n{r.text}" and r.n_tokens == S.count_tokens(r.indexed)
        got[r[key]].append(r)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} if key == "doc_id" else pages
    for k, d in docs.items():
        mine, title = got.get(k, []), d.source if key == "doc_id" else d.url
        sections = S.markdown_sections(d.text or "") if key == "doc_id" else [S.Section(*x) for x in plain_sections(d.html or "")]
        words = [w for s in sections for w in s.body.split()]
        held = [w for r in mine for w in r.text.split()]
        assert all(r.path.startswith(title) for r in mine)
        if key == "page_id":
            assert set(words) <= set(held)
        # one word may be longer than what the breadcrumb leaves; all other parts fit
        assert all(r.n_tokens <= S.CEILING or len(r.text.split()) == 1 for r in mine)


def test_merge_equals_a_plain_rule():
    import random

    r = random.Random(8)
    count = lambda s: len(s.split())
    for _ in range(200):
        pieces = [S.Piece(("d", *(r.choice("ab") for _ in range(r.randrange(4)))), "w " * r.randrange(1, 200)) for _ in range(r.randrange(1, 9))]
        groups = []
        for p in pieces:
            if groups:
                held, last = sum(count(x.text) for x in groups[-1]), groups[-1][-1].path
                same = next((i for i in range(min(len(last), len(p.path))) if last[i] != p.path[i]), min(len(last), len(p.path)))
                if held >= S.FLOOR or held + count(p.text) > S.CEILING or (same < len(last) - 1 and held >= S.FLOOR // 2):
                    groups.append([p])
                else:
                    groups[-1].append(p)
            else:
                groups.append([p])
        got = S.merge(pieces, count)
        assert [count(x.text) for x in got] >= [sum(count(p.text) for p in g) for g in groups] and len(got) == len(groups)
        for g, made in zip(groups, got, strict=True):
            assert all(p.path[: len(made.path)] == made.path for p in g) and (len(g) > 1 or made == g[0])
