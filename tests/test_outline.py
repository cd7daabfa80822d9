import random

import plain_structure as S

from lodestar.sources import outline as O

LINES = [
    "# One", "## Two ##", "### Three", "#### Four #", "###### Six", "#no", "Title", "other words", "---", "===", "-----", "", "   ", "```", "~~~ x", "- item", "| a |", "# ", "#  spaced  ", "* * *", "----- x", "  indented",
]


def want(name, text):
    sections = S.markdown_sections(text)
    stack, out = [], []
    for i, s in enumerate(sections):
        if s.title:
            stack = [(level, title) for level, title in stack if level < s.level] + [(s.level, s.title)]
        out.append((i, s.level, s.title, " > ".join([name, *(t for _, t in stack)]), s.body))
    return out


def test_random_documents_equal_the_walk(spark):
    r = random.Random(12)
    docs = [(k, "\n".join(r.choice(LINES) for _ in range(r.randrange(0, 25))), f"d{k}") for k in range(400)]
    docs += [(900, None, "n"), (901, "", "n"), (902, "\n".join(["# h", *["word " * 20] * 5000, "## k", "x"]), "long")]
    got: dict = {}
    for x in O.outline(spark.createDataFrame(docs, "doc_id long, text string, name string").repartition(3), "doc_id", "text", "name").orderBy("doc_id", "ordinal").collect():
        got.setdefault(x.doc_id, []).append((x.ordinal, x.level, x.title, x.path, x.body))
    expected = {k: v for k, text, name in docs if text and (v := want(name, text))}
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == v, docs[k] if k < 400 else k


def test_pages(spark):
    html = "<html><head><title>t</title></head><nav># no</nav><h1> A <b>b</b></h1><p>one two</p><!-- ## no --><h3>C</h3><script>## no</script>three\n<h2>D</h2>four</html>"
    df = spark.createDataFrame([(1, html, None), (2, None, "u")], "page_id long, html string, url string")
    rows = O.outline(df.select("page_id", "url", O.page_markdown(df.html).alias("text")), "page_id", "text", "url").orderBy("ordinal").collect()
    assert [(r.level, r.title, r.path) for r in rows if r.title] == [(1, "A b", " > A b"), (3, "C", " > A b > C"), (2, "D", " > A b > D")]
    assert [r.body for r in rows if r.title] == ["one two", "three", "four"]
