"""Sections of Markdown and of pages as rows: lines are exploded, and fences, headings and breadcrumbs are window sums over them.

Of a page the main part is taken; noise elements go, heading tags of the first three levels become marked lines, block
elements begin lines, all other tags vanish. A document's lines are dealt by its key; a document is the largest thing that a
task orders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.text import BOILERPLATE, clean_markdown, contains_any, strip, strip_noise_tags

FENCE = r"^\s*(```|~~~)"
HEADING = r"^(#{1,6})\s+(\S.*?)\s*#*\s*$"
RULER = r"^(=+|-{3,})\s*$"
#: Elements that begin a line.
BLOCK_TAGS = (
    "address", "article", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "h4", "h5", "h6", "hr", "li",
    "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
)
#: Character references that are read; all others stay as they are written. The ampersand's is the last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&middot;": "·", "&copy;": "©", "&reg;": "®", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&bull;": "•", "&amp;": "&"}
_OPEN, _CLOSE = "\x02", "\x03"


def page_markdown(html: Column) -> Column:
    return clean_markdown(strip_noise_tags(html))


def page_lines(html: Column) -> Column:
    """A page's main part as lines; a heading is one that begins with a mark and its level."""
    bare = F.regexp_replace(html, rf"(?s)<!--.*?-->|[{_OPEN}{_CLOSE}]", "")
    part = lambda tag: F.nullif(F.regexp_extract(bare, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), F.lit(""))
    text = strip_noise_tags(F.coalesce(part("main"), part("article"), part("body"), bare))
    marked = F.regexp_replace(F.regexp_replace(text, r"(?i)<h([1-3])\b[^>]*>", _OPEN + "$1"), r"(?i)</h[1-3]\s*>", _CLOSE)
    plain = F.regexp_replace(F.regexp_replace(marked, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>", "\n"), r"(?s)<[^>]+>", "")
    read = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), plain)
    pieces = F.regexp_extract_all(read, F.lit(rf"(?s){_OPEN}[^{_OPEN}{_CLOSE}]*{_CLOSE}|[^{_OPEN}{_CLOSE}]+"), 0)
    line = lambda p: F.concat(F.lit("\n"), F.left(p, F.lit(2)), F.lit(" "), one_space(F.substring(F.left(p, F.length(p) - 1), 3, 1 << 30)), F.lit("\n"))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith(_OPEN), line(p)).otherwise(p)), "")


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tidy(body: Column, phrases: tuple[str, ...] = BOILERPLATE) -> Column:
    """Lines of over two words or with a sentence's end that are no boilerplate."""
    lines = F.transform(F.split(body, "\n"), one_space)
    noise = lambda low: low.startswith("*") | contains_any(low, [*phrases, "=" * 8, "<a href", "<center", 'class="'])
    return F.array_join(F.filter(lines, lambda x: (x.rlike(" .* ") | x.rlike("[.!?:]$")) & ~noise(F.lower(x))), "\n")


def _of_markdown(lines: DataFrame, key: str) -> DataFrame:
    """``level`` of a line that opens a section, ``shown``, and ``ruler``: the line under a title."""
    of = W.partitionBy(key).orderBy("i")
    sofar = of.rowsBetween(W.unboundedPreceding, 0)
    fence = F.col("line").rlike(FENCE)
    inside = (F.sum(fence.cast("int")).over(sofar) % 2 == 1) | fence
    seen = lines.withColumns({"closed": inside, "next": F.coalesce(F.lead("line").over(of), F.lit(""))})
    hashes = F.when(~F.col("closed"), F.length(F.regexp_extract("line", HEADING, 1))).otherwise(0)
    seen = seen.withColumn("hashes", hashes)
    # a line over a ruler is a title, unless it is itself the ruler of one: of a run of such lines every second one
    over = ~F.col("closed") & (F.col("hashes") == 0) & F.col("next").rlike(RULER) & (F.trim("line") != "")
    seen = seen.withColumn("over", over)
    run = F.col("i") - F.coalesce(F.max(F.when(~F.col("over"), F.col("i"))).over(sofar), F.lit(-1)) - 1
    seen = seen.withColumn("under", F.col("over") & (run % 2 == 0))
    level = F.when(F.col("hashes").between(1, 3), F.col("hashes")).when(F.col("under"), F.when(F.col("next").startswith("="), 1).otherwise(2))
    titled = F.when(F.col("hashes") > 0, F.regexp_extract("line", HEADING, 2)).otherwise(F.col("line"))
    return seen.withColumns({"level": level, "shown": titled, "ruler": F.coalesce(F.lag("under").over(of), F.lit(False))})


def _of_page(lines: DataFrame) -> DataFrame:
    marked = F.col("line").startswith(_OPEN)
    level = F.when(marked, F.substring("line", 2, 1).cast("int"))
    return lines.withColumns({"level": level, "shown": F.when(marked, F.substring("line", 4, 1 << 30)).otherwise(F.col("line")), "ruler": F.lit(False)})


def outline(documents: DataFrame, key: str, text: str, name: str, kind: str = "markdown") -> DataFrame:
    """``key``, ``ordinal`` (from 0, no gaps), ``level`` (0 before the first heading), ``title``, ``path`` and ``body`` of every section
    of ``text`` that has a title or a body, and ``parts``, the path as a list. ``kind``: ``markdown`` or ``page``, for texts of
    :func:`page_lines`, whose bodies are tidied.

    Levels 1 to 3, in either heading style, open sections; deeper ones are body without their signs; nothing inside a fence
    is a heading. The path is the document's ``name`` and the titles above and of the section. Null and empty texts have no
    sections. Keys must be unique."""
    lines = documents.select(key, F.coalesce(name, F.lit("")).alias("name"), F.posexplode(F.split(text, "\n")).alias("i", "line"))
    seen = _of_markdown(lines, key) if kind == "markdown" else _of_page(lines)
    sofar = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    opened = seen.withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(sofar))
    own = F.when(F.col("level").isNull() & ~F.col("ruler"), F.struct("i", "shown"))
    made = opened.groupBy(key, "name", "section").agg(
        F.max("level").alias("level"),
        F.max(F.when(F.col("level").isNotNull(), strip(F.col("shown")))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["shown"]), "\n").alias("body"),
    )
    made = made.withColumns({"body": strip(F.col("body")) if kind == "markdown" else tidy(F.col("body")), "level": F.coalesce("level", F.lit(0)), "title": F.coalesce("title", F.lit(""))})
    upto = W.partitionBy(key).orderBy("section").rowsBetween(W.unboundedPreceding, 0)
    last = {n: F.last(F.when((F.col("level") == n) & (F.col("title") != ""), F.struct("section", "title")), True).over(upto) for n in (1, 2, 3)}
    made = made.withColumns({f"t{n}": c for n, c in last.items()})
    at = lambda n: F.coalesce(F.col(f"t{n}.section"), F.lit(-1))
    second = F.when(at(2) > at(1), F.col("t2.title"))
    third = F.when(at(3) > F.greatest(at(1), at(2)), F.col("t3.title"))
    parts = F.array_compact(F.array("name", F.col("t1.title"), second, third))
    kept = made.withColumn("parts", parts).where("title != '' or body != ''")
    place = F.row_number().over(W.partitionBy(key).orderBy("section")) - 1
    return kept.select(key, place.cast("long").alias("ordinal"), F.col("level").cast("long").alias("level"), "title", F.array_join("parts", " > ").alias("path"), "body", "parts")
