import random

import plain_structure as S
import pytest
from pyspark.sql import functions as F

from lodestar.functions.text import clean_markdown
from lodestar.sources import chunks as C
from lodestar.sources import outline as O

SF = "/root/testdata/sf0.001"
HTML = "<html><body><nav>menu</nav><main><h1>Title</h1><p>First words of a body.</p><h2>Part</h2><ul><li>One item that is long enough</li></ul><h3>Deep</h3><p>More text in here now.</p></main><footer>f</footer></body></html>"


def rows_of(df, key):
    out: dict = {}
    for r in df.orderBy(key, "ordinal").collect():
        assert r.ordinal == len(out.setdefault(r[key], [])) and r.indexed == f"{r.path}\n\n{r.text}" and r.n_tokens == S.count_tokens(r.indexed)
        out[r[key]].append((r.path, r.text))
    return out


def random_markdown(r):
    word = lambda: r.choice(["word", "two-part", "x,", "end.", "ção"])
    line = lambda: " ".join(word() for _ in range(r.choice([1, 5, 40, 200, 700])))
    parts = []
    for _ in range(r.randrange(0, 12)):
        parts.append(r.choice([f"# h{r.randrange(9)}", f"## g{r.randrange(9)}", f"### f{r.randrange(9)}", line(), line(), line() + "\n" + line(), "", "z" * 3000]))
        parts.append(r.choice(["", "", "tail"]))
    return "\n".join(parts)


@pytest.mark.parametrize("ceiling", [S.CEILING, 60])
def test_random_documents_equal_plain_loops(spark, ceiling):
    r = random.Random(31)
    docs = [(k, random_markdown(r), f"d {k}") for k in range(150)] + [(900, None, "n"), (901, "", "n")]
    sections = O.outline(spark.createDataFrame(docs, "doc_id long, text string, name string").repartition(3), "doc_id", "text", "name")
    got = rows_of(C.chunk(sections, "doc_id", ceiling=ceiling), "doc_id")
    want = {k: [(" > ".join(p.path), p.text) for p in v] for k, text, name in docs if text and (v := S.structural_chunks(name, S.markdown_sections(text), ceiling=ceiling))}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == v


def test_all_documents_and_pages_equal_plain_loops(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", clean_markdown(F.col("text")).alias("text"))
    got = rows_of(C.chunk(O.outline(documents, "doc_id", "text", "source"), "doc_id"), "doc_id")
    want = {r.doc_id: [(" > ".join(p.path), p.text) for p in v] for r in documents.collect() if r.text and (v := S.structural_chunks(r.source, S.markdown_sections(r.text)))}
    assert got == want
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    lines = pages.select("page_id", "url", O.page_lines(F.col("html")).alias("text"))
    sections = O.outline(lines, "page_id", "text", "url", kind="page")
    walked: dict = {}
    for r in sections.orderBy("page_id", "ordinal").collect():
        walked.setdefault(r.page_id, []).append(S.Section(r.level, r.title, r.body))
    assert walked == {r.page_id: v for r in pages.collect() if r.html and (v := S.html_sections(r.html))}
    mine = rows_of(C.chunk(sections, "page_id"), "page_id")
    urls = {r.page_id: r.url for r in pages.collect()}
    assert mine == {k: [(" > ".join(p.path), p.text) for p in v] for k, s in walked.items() if (v := S.structural_chunks(urls[k], s))}


def test_pages_of_odd_markup(spark):
    more = [HTML, None, "", "<p>no heading at all here.</p>", "<main></main><article><h2>A\n <i>b</i></h2><p>x &amp;lt; y &quot;q&quot; is it.</p></article>", "<h1>open <p>one two three four</p>", "</h2>stray close of it.<h3></h3>"]
    df = spark.createDataFrame(list(enumerate(more)), "page_id long, html string")
    lines = df.select("page_id", F.lit("n").alias("url"), O.page_lines(F.col("html")).alias("text"))
    got: dict = {}
    for r in O.outline(lines, "page_id", "text", "url", kind="page").orderBy("page_id", "ordinal").collect():
        got.setdefault(r.page_id, []).append((r.level, r.title, r.body))
    assert got[0] == [tuple(s) for s in S.html_sections(HTML)] and 1 not in got and 2 not in got
    assert got[3] == [(0, "", "no heading at all here.")] and got[4] == [(2, "A b", 'x &lt; y "q" is it.')]
    assert any("stray close of it." in b for _, _, b in got[6]) and any("one two three four" in b for _, _, b in got[5])
