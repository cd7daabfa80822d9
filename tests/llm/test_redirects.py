import random
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.llm import redirects as R
from lodestar.llm.queries import ORACLES, URL_RULES

RULES = [R.Rule("net", "/", "block"), R.Rule("example.net", "/en/", "allow"), R.Rule("example.com", "/de/", "block"), R.Rule("org", "/fr/", "allow")]
CANONICAL = '<html><!-- <link rel="canonical" href="http://bad.net/"> --><link href="{}" rel=canonical></html>'


def judged(spark, pages, redirects=None):
    df = spark.createDataFrame([(i, u, h, "c") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, component string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in R.filter_urls(df, RULES, redirects).collect()}


def test_rules(spark):
    got = judged(spark, [("http://A.Example.NET/en/1?x#y", None), ("https://example.net/de", ""), ("http://xexample.com/de/", ""), ("http://x.net", ""), (None, None), ("no scheme", "x"), ("http://u.org/fr/?a://b", "")])
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/de", "net/", "block")
    assert got[2] == ("xexample.com", "/de/", None, "allow")
    assert got[3] == ("x.net", "", None, "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("org/fr/", "allow")


def test_components_spread_blocks_and_allows_win(spark):
    pages = [
        ("http://a.com/1", CANONICAL.format("http://b.com/2")),
        ("http://b.com/2", '<meta http-equiv="Refresh" content="0; url=http://evil.net/x">'),
        ("http://c.com/3", CANONICAL.format("http://fine.org/fr/")),
        ("http://fine.org/fr/", CANONICAL.format("http://worse.net/")),
        ("http://d.com/4", "<p>nothing</p>"),
        ("http://a.com/1#part", ""),
        ("http://e.com/dir/page", CANONICAL.format("other?a=1&amp;b=2")),
    ]
    got = {i: v[3] for i, v in judged(spark, pages).items()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "allow"}


def test_table_of_redirects_and_relative_links(spark):
    hops = spark.createDataFrame([("http://s.com/", "http://e.com/dir/other?a=1&b=2"), (None, "http://x.net/"), ("http://s.com/", "http://evil.net/")], "source string, target string")
    got = judged(spark, [("http://e.com/dir/page", CANONICAL.format("other?a=1&amp;b=2")), ("http://z.com/", "")], hops)
    assert (got[0][3], got[1][3]) == ("block", "allow")


def test_a_scheme_in_the_fragment_is_no_address(spark):
    got = judged(spark, [("a#b://c.net/x", CANONICAL.format("http://fine.org/fr/")), ("d#b://c.com/x", ""), ("http://q.com/" + "x" * 100_000, "<p>" * 100_000)])
    assert [got[i][:2] + got[i][3:] for i in (0, 1)] == [("c.net", "/x", "block"), ("c.com", "/x", "allow")] and got[2][3] == "allow"


def test_empty(spark):
    assert R.filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


ON = "http://a.example.io/dir/page?old=1#f"
#: What RFC 3986 (5.4) makes of references, and the cases of this module.
MEANT = {
    "/login?next=https://other.net/x": "http://a.example.io/login?next=https://other.net/x",
    "?p=2": "http://a.example.io/dir/page?p=2",
    "#top": "http://a.example.io/dir/page?old=1",
    "../x": "http://a.example.io/x",
    "../../../x/./y/..": "http://a.example.io/x/",
    "data:text/html,://b.net/": None,
    "mailto:a@b.net": None,
    "//B.net": "http://b.net/",
    "HTTPS://B.net?q#z": "https://b.net/?q",
    "g;x=1/../y": "http://a.example.io/dir/y",
    ".": "http://a.example.io/dir/",
    "g#s/../x": "http://a.example.io/dir/g",
    "g?y/../x": "http://a.example.io/dir/g?y/../x",
    "next://": None,
    "other?a=1": "http://a.example.io/dir/other?a=1",
}


def test_references_are_resolved(spark):
    rows = spark.createDataFrame([(t,) for t in MEANT], "t string").select("t", R.resolve(F.col("t"), R.address(F.lit(ON))).alias("a")).collect()
    assert {r.t: r.a for r in rows} == MEANT
    for t, a in MEANT.items():
        if a and "//" not in t and not t.startswith("../../.."):
            assert urljoin(ON, t).split("#")[0] == a or t in ("?p=2", "#top")


def test_references_on_bases(spark):
    bases, refs = ["http://h.net", "http://h.net/", "http://h.net/a/b/../c"], ["", "x", "./x", "../x", "/..", "..", "a/../../b", "//k.org/.", "/a//../b"]
    rows = spark.createDataFrame([(b, t) for b in bases for t in refs], "b string, t string").select("b", "t", R.resolve(F.col("t"), R.address(F.col("b"))).alias("a")).collect()
    for r in rows:
        assert r.a == urljoin(urljoin(r.b + ("/" if r.b.count("/") == 2 else ""), "." if r.b.endswith("/") else r.b.rsplit("/", 1)[-1] if r.b.count("/") > 2 else ""), r.t).replace("k.org/.", "k.org/") or (r.t, r.a) == ("/a//../b", "http://h.net/a/b")


def test_links_with_addresses_in_their_query_block_nothing(spark):
    page = "http://a.example.io/dir/page"
    got = judged(spark, [(page, CANONICAL.format(t)) for t in MEANT if "B.net" not in t])
    assert {v[3] for v in got.values()} == {"allow"}
    based = '<base target=_top href="http://evil.net/d/"><link rel="alternate canonical" href="x">'
    assert judged(spark, [(page, based), ("http://c.com/", '<link data-href="http://evil.net/" rel=canonical href="/">')])[0][3] == "block"


@pytest.fixture(scope="module")
def graphs():
    """200 graphs of links on hosts of their own, some of them blocked or allowed by the rules."""
    rnd, pages = random.Random(8), []
    for g in range(200):
        n = rnd.randint(1, 7)
        hosts = [f"h{i}.g{g}.{rnd.choice(['com', 'com', 'io', 'net', 'org'])}" for i in range(n)]
        for i, h in enumerate(hosts):
            links = ""
            for j in rnd.sample(range(n), rnd.choice([0, 1, 1, min(2, n)])):
                url = rnd.choice(["http://{}/fr/", "//{}/fr", "http://{}/", "http://{}"]).format(hosts[j])
                links += f'<link rel="canonical" href="{url}">' if rnd.random() < 0.5 else f'<meta http-equiv=refresh content="0; url={url}">'
            path = rnd.choice(["", "/", "/fr/", "/fr"])
            pages.append((len(pages), f"http://{h}{path}", links))
    return pages


def test_random_link_graphs_equal_union_find(spark, graphs):
    node = lambda u: (u if not u.startswith("//") else "http:" + u) + ("/" if u.count("/") == 2 else "")
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, url, html in graphs:
        for t in html.split("<")[1:]:
            target = t.split('href="')[1].split('"')[0] if t.startswith("link") else t.split("url=")[1].split('"')[0]
            up[top(node(url))] = top(node(target))

    def rule(url):
        host, _, path = url.split("://")[1].partition("/")
        path = "/" + path if "/" in url.split("://")[1] else ""
        return max(((r.text, r.verdict) for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda x: len(x[0]), default=None)

    said: dict = {}
    for x in list(up):
        if r := rule(x):
            said.setdefault(top(x), set()).add(r[1])
    want = {}
    for i, url, _ in graphs:
        spread = said.get(top(node(url)), set()) if node(url) in up and (top(node(url)) != node(url) or sum(top(x) == node(url) for x in up) > 1) else set()
        want[i] = (rule(url) or (None, "allow" if "allow" in spread or not spread else "block"))[1]
    got = {i: v[3] for i, v in judged(spark, [p[1:] for p in graphs]).items()}
    assert got == want and {"allow", "block"} == set(want.values())


def test_sql_says_the_same(spark, graphs):
    more = [(u, CANONICAL.format(t)) for u in (ON, "http://h.net", "http://k.com/a/b/../c") for t in [*MEANT, "http://evil.net/", "http://fine.org/fr/x"]]
    pages = [(i, u, h) for i, (u, h) in enumerate([p[1:] for p in graphs] + more + [(None, None), ("x", ""), ("http://q.com", None)])]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", pages)
    want = {r[0]: r[1:] for r in con.execute("select page_id, host, path, rule, verdict from (" + ORACLES["op8_redirect_equivalence"] + ")").fetchall()}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in R.filter_urls(df, URL_RULES).collect()} == want


def test_rules_of_equal_length_and_text(spark):
    rules = [R.Rule("a.com", "/x/", "block"), R.Rule("com", "/x/y/z/", "allow"), R.Rule("b.com", "/x/", "allow"), R.Rule("b.com", "/x/", "block"), R.Rule("", "/", "block")]
    df = spark.createDataFrame([(0, "http://a.com/x/", None), (1, "http://b.com/x/", None), (2, "http://c.com/x/", None)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in R.filter_urls(df, rules).collect()}
    assert got == {0: "block", 1: "block", 2: "allow"}
