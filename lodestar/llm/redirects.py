"""URL filters over redirect equivalence.

Host and path of every URL are judged by block and allow rules, of which the longest that fits wins. Pages that redirect
to one another or name one canonical address are aliases: connected components over those edges. A page without a rule
of its own takes its component's: allow if an alias is explicitly allowed, else block if one is blocked, else allow.

Edges are read from the pages (``<link rel=canonical>`` and ``<meta http-equiv=refresh>``, outside comments), and from a
table of redirects where there is one. A page's references are resolved as RFC 3986 says, on its address or its ``<base
href>``. Addresses are compared without fragment and dot segments, with scheme and host in small letters; an empty path is ``/``.

Defined results. A null URL, or one without ``://``, has an empty host and path, fits no rule and has no aliases: it is
allowed. One with ``://`` in its path, query or fragment only has a host and path, as the rules' definition says, but no
aliases. Null or empty HTML has no edges, nor have references without an address (``data:``, ``mailto:``). Equal addresses
are aliases of one another. Repeated rows are judged each. A rule with an empty host fits nothing; of two rules of equal
length that fit, the one later in the alphabet wins, and of two of equal text the later in the list. Only ``page_id``, ``url`` and ``html`` are read. An empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import save


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(rules: list[Rule], of_host: Column, of_path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null without one. Rules are a filter list's few hundreds at most."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        if r.host:
            fits = ((of_host == r.host) | of_host.endswith("." + r.host)) & of_path.startswith(r.path)
            rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"


def _parts(reference: Column) -> list[Column]:
    """Scheme with its colon, authority with its slashes, path and query of a reference; empty where there is none."""
    return [F.regexp_extract(reference, _PARTS, i) for i in range(1, 5)]


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, without the segments ``.`` and ``..``."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    shorter = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
    kept = F.aggregate(segments, F.expr("cast(array() as array<string>)"), lambda kept, s: F.when(s == ".", kept).when(s == "..", shorter(kept)).otherwise(F.array_append(kept, s)))
    whole = F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")
    return F.when(path.rlike(r"/\.\.?(/|$)"), whole).otherwise(path)


def address(url: Column) -> Column:
    """A URL as a node: scheme and host in small letters, a path without dot segments (``/`` where it is empty), the query,
    no fragment; null where the URL does not begin with a scheme, ``://`` and a host."""
    scheme, authority, path, query = _parts(url)
    rooted = F.when(path.startswith("/"), _without_dots(path)).otherwise(F.concat(F.lit("/"), path))
    return F.when((scheme != "") & (F.length(authority) > 2), F.concat(F.lower(scheme), F.translate(authority, _UPPER, _LOWER), rooted, query))


def resolve(reference: Column, base: Column) -> Column:
    """The address that ``reference`` means on a page with the address ``base``, as RFC 3986 (5.2) says; null where it is none."""
    scheme, authority, path, query = _parts(reference)
    on_scheme, on_authority, on_path, on_query = _parts(base)
    absolute, whole = scheme != "", (scheme != "") | (authority != "")
    merged = F.concat(F.regexp_replace(on_path, "[^/]*$", ""), path)
    to_path = F.when(whole | path.startswith("/"), path).when(path == "", on_path).otherwise(merged)
    to_query = F.when(whole | (path != "") | (query != ""), query).otherwise(on_query)
    return address(F.concat(F.when(absolute, scheme).otherwise(on_scheme), F.when(whole, authority).otherwise(on_authority), to_path, to_query))


_CANONICAL = r"""(?is)<link\b[^>]*\srel\s*=\s*(?:"[^"]*\bcanonical\b[^"]*"|'[^']*\bcanonical\b[^']*'|canonical\b)[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\shttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_BASE = r"""(?is)<base\b[^>]*>"""
_HREF = r"""(?is)[\s"']href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_URL = r"""(?is)\burl\s*=\s*['"]?([^'">\s]+)"""


def _target(tag: Column, pattern: str) -> Column:
    bare = F.regexp_replace(F.regexp_extract(tag, pattern, 1), r"""^["']|["']$""", "")
    return F.replace(F.trim(bare), F.lit("&amp;"), F.lit("&"))


def link_edges(pages: DataFrame) -> DataFrame:
    """``a``, ``b``: a page's address and one that it redirects to or calls canonical. A page's first ``<base href>`` is what
    its references are relative to."""
    some = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.regexp_replace(F.col("html"), r"(?s)<!--.*?-->", "").alias("html"))
    own = some.select(address(F.col("url")).alias("a"), "html", _target(F.regexp_extract("html", _BASE, 0), _HREF).alias("set")).where("a is not null")
    on = own.withColumn("base", F.coalesce(F.when(F.col("set") != "", resolve(F.col("set"), F.col("a"))), F.col("a")))
    tags = F.concat(F.regexp_extract_all("html", F.lit(_CANONICAL), 0), F.regexp_extract_all("html", F.lit(_REFRESH), 0))
    found = on.select("a", "base", F.explode(tags).alias("tag"))
    to = F.when(F.col("tag").rlike("(?i)^<link"), _target(F.col("tag"), _HREF)).otherwise(_target(F.col("tag"), _URL))
    ends = found.select("a", "base", to.alias("to")).where("to != ''").select("a", resolve(F.col("to"), F.col("base")).alias("b"))
    return ends.where("b is not null and a != b").distinct()


def filter_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``alias_of`` (the component's smallest address) for
    every row of ``pages``; ``redirects`` (``source``, ``target``) adds edges."""
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(address(F.col("source")), address(F.col("target")))).where("a is not null and b is not null and a != b")
    alias = components(edges)
    node_rule, node_verdict = judge(rules, host(F.col("id")), path(F.col("id")))
    # every address of a component has a say, one that is no page of ours too
    told = save(
        alias.withColumn("said", node_verdict).groupBy("component").agg(F.max(F.when(F.col("said") == "allow", 2).when(F.col("said") == "block", 1).otherwise(0)).alias("told")),
        "told",
    )
    known = alias.join(told, "component").select(F.col("id").alias("node"), F.col("component").alias("alias_of"), "told")
    url = F.col("url")
    rule, verdict = judge(rules, F.col("host"), F.col("path"))
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), address(url).alias("address"))
    joined = rows.join(known, rows.address == known.node, "left")
    spread = F.when(F.col("told") == 1, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, spread).alias("verdict"), F.coalesce("alias_of", "address").alias("alias_of"))
