"""Structural chunks: neighbouring sections together until a floor is reached, long ones cut, all under a ceiling of tokens.

The sections of a document meet in one array, as a document is cut as a whole; what is greedy is an ``aggregate`` over the
numbers of their tokens. Tokens are words and single signs, so the tokens of joined texts are the sum of their tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.text import strip

FLOOR, CEILING = 120, 450


def count_tokens(text: Column) -> Column:
    """Words and single signs; a stand-in for a model's own counter, which may be passed instead if it adds up likewise."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), 0))


def _common(a: Column, b: Column) -> Column:
    """How many values two lists have in common at their beginning; neither is empty."""
    least = F.least(F.size(a), F.size(b))
    apart = F.array_position(F.transform(F.sequence(F.lit(0), least - 1), lambda i: F.get(a, i) == F.get(b, i)), False)
    return F.when(apart > 0, apart - 1).otherwise(least).cast("int")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _groups(pieces: Column, floor: int, ceiling: int) -> Column:
    """The number of each piece's group (``n`` tokens, ``moved``: its parent is another one than its neighbour's)."""
    start = F.struct(F.lit(0).alias("size"), F.lit(-1).alias("group"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(s: Column, p: Column) -> Column:
        full = (s["size"] >= floor) | (s["size"] + p["n"] > ceiling) | (p["moved"] & (s["size"] >= floor // 2))
        new = (s["group"] < 0) | full
        group = F.when(new, s["group"] + 1).otherwise(s["group"])
        return F.struct(F.when(new, p["n"]).otherwise(s["size"] + p["n"]).alias("size"), group.alias("group"), F.array_append(s["out"], group).alias("out"))

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def _filled(words: Column, room: Column, count: Callable[[Column], Column]) -> Column:
    """Words filled up to the room, with single spaces."""
    start = F.struct(F.lit(0).alias("size"), F.lit("").alias("held"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(s: Column, w: Column) -> Column:
        n = count(w)
        over = (s["held"] != "") & (s["size"] + n > room)
        held = F.when(over | (s["held"] == ""), w).otherwise(F.concat(s["held"], F.lit(" "), w))
        return F.struct(F.when(over, n).otherwise(s["size"] + n).alias("size"), held.alias("held"), F.when(over, F.array_append(s["out"], s["held"])).otherwise(s["out"]).alias("out"))

    return F.aggregate(words, start, step, lambda s: F.when(s["held"] != "", F.array_append(s["out"], s["held"])).otherwise(s["out"]))


def split(text: Column, room: Column, count: Callable[[Column], Column] = count_tokens) -> Column:
    """Paragraphs filled up to the room, each part beginning with the last paragraph of the one before where both fit. A
    paragraph that is too long is cut at lines, and a line at words. No part of more than one word is over the room."""
    words = lambda line: F.filter(F.split(line, r"\s+"), lambda w: w != "")
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")
    cut = lambda p: F.flatten(F.transform(F.split(p, "\n"), lambda line: _filled(words(line), room, count)))
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(count(p) <= room, F.array(p)).otherwise(cut(p))))
    none = F.lit(0)
    start = F.struct(none.alias("size"), F.lit("").alias("last"), none.alias("n"), F.lit("").alias("held"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(s: Column, u: Column) -> Column:
        n = count(u)
        first, fits, overlaps = s["held"] == "", s["size"] + n <= room, s["n"] + n <= room
        joined = lambda a: F.concat(a, F.lit("\n\n"), u)
        return F.struct(
            F.when(first, n).when(fits, s["size"] + n).when(overlaps, s["n"] + n).otherwise(n).alias("size"), u.alias("last"), n.alias("n"),
            F.when(first, u).when(fits, joined(s["held"])).when(overlaps, joined(s["last"])).otherwise(u).alias("held"),
            F.when(first | fits, s["out"]).otherwise(F.array_append(s["out"], s["held"])).alias("out"),
        )

    return F.aggregate(units, start, step, lambda s: F.when(s["held"] != "", F.array_append(s["out"], s["held"])).otherwise(s["out"]))


def merged(sections: DataFrame, key: str, count: Callable[[Column], Column] = count_tokens, floor: int = FLOOR, ceiling: int = CEILING) -> DataFrame:
    """Sections (``ordinal``, ``parts``, ``body``) with a body, neighbours together until the floor is reached; not beyond the ceiling,
    nor over a change of parent once half the floor is there. A section below the last one, or beside it, changes no parent.
    ``key``, ``group``, ``parts`` (what the merged paths have in common) and ``text``, in which titles that the path loses stay."""
    own = sections.where("body != ''").select(key, "ordinal", "parts", "body", count(F.col("body")).alias("n"))
    before = F.lag("parts").over(W.partitionBy(key).orderBy("ordinal"))
    own = own.withColumn("before", before)
    moved = F.coalesce(F.when(F.col("before").isNotNull(), _common(F.coalesce("before", F.array(F.lit(""))), F.col("parts")) < F.size("before") - 1), F.lit(False))
    listed = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "n", moved.alias("moved"), "parts", "body"))).alias("x"))
    dealt = listed.select(key, F.explode(F.arrays_zip("x", _groups(F.col("x"), floor, ceiling).alias("g"))).alias("z")).select(key, F.col("z.g").alias("group"), "z.x.ordinal", "z.x.parts", "z.x.body")
    groups = dealt.groupBy(key, "group").agg(F.array_sort(F.collect_list(F.struct("ordinal", "parts", "body"))).alias("x"))
    first = F.get("x", F.lit(0))["parts"]
    groups = groups.withColumn("parts", F.slice(first, 1, F.array_min(F.transform("x", lambda p: _common(first, p["parts"])))))
    lost = lambda p: F.array_join(F.slice(p["parts"], F.size("parts") + 1, F.greatest(F.size(p["parts"]), F.lit(1))), " / ")
    lines = F.flatten(F.transform("x", lambda p: F.array(lost(p), p["body"])))
    text = F.when(F.size("x") == 1, F.get("x", F.lit(0))["body"]).otherwise(F.array_join(F.filter(lines, lambda t: t != ""), "\n"))
    return groups.select(key, "group", "parts", text.alias("text"))


def chunk(sections: DataFrame, key: str, count: Callable[[Column], Column] = count_tokens, floor: int = FLOOR, ceiling: int = CEILING) -> DataFrame:
    """``key``, ``ordinal`` (no gaps), ``path``, ``text`` (to be cited), ``indexed`` (breadcrumb and text) and ``n_tokens`` of what is
    indexed. The ceiling holds for breadcrumb and text together. Documents without a body have no chunks."""
    pieces = merged(sections, key, count, floor, ceiling).withColumn("path", F.array_join("parts", " > "))
    room = F.greatest(F.lit(1), ceiling - count(F.col("path")) - 2)
    parts = pieces.withColumn("room", room).select(key, "group", "path", F.posexplode(split(F.col("text"), F.col("room"), count)).alias("part", "text"))
    place = F.row_number().over(W.partitionBy(key).orderBy("group", "part")) - 1
    indexed = F.concat("path", F.lit("\n\n"), F.col("text"))
    return parts.select(key, place.cast("long").alias("ordinal"), "path", "text", indexed.alias("indexed"), count(indexed).cast("long").alias("n_tokens"))
