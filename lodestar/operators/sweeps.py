"""Every setting of a rule in one pass: distributions at all levels, designs side by side, thresholds by cumulated counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.text import contains_any

from . import rules


def distributions(profiles: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows each combination of values has, each value of each column alone, and all together: ``columns`` (null where
    one is not looked at), ``looked`` (names of those that are) and ``n``. One scan; partial counts are combined."""
    sets = [columns, *([c] for c in columns), []]
    looked = F.array_join(F.array_compact(F.array(*(F.when(F.grouping(c) == 0, F.lit(c)) for c in columns))), ",")
    return profiles.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns)).agg(F.count(F.lit(1)).alias("n"), looked.alias("looked"))


def priority_designs(profiles: DataFrame, designs: dict[str, tuple[bool, bool]]) -> DataFrame:
    """Priorities under designs that demote what is not verified, what is not eligible, both or neither: ``design``, ``priority``,
    ``n``. ``profiles``: ``quadrant``, ``confidence``, ``verified``, ``eligible``."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("design"), F.lit(v).alias("by_sign"), F.lit(e).alias("by_eligibility")) for n, (v, e) in designs.items())))
    rows = profiles.withColumn("d", each).select("quadrant", "confidence", "verified", "eligible", "d.*")
    seen = rules.priority(F.col("quadrant"), F.col("confidence"), F.col("verified") | ~F.col("by_sign"))
    priority = F.when(F.col("by_eligibility") & ~F.col("eligible"), "baixa").otherwise(seen)
    return rows.groupBy("design", priority.alias("priority")).agg(F.count(F.lit(1)).alias("n"))


def design_costs(rows: DataFrame, right: Column, without_sign: Column) -> DataFrame:
    """What it costs to give rows without any sign a label of their own, which no gold label equals: ``design``, ``right``, ``total``."""
    total, now = F.count(F.lit(1)), F.count_if(right)
    own = rows.agg(total.alias("total"), now.alias("keep label"), F.count_if(right & ~without_sign).alias("own label"))
    return own.select(F.explode(F.array(*(F.struct(F.lit(n).alias("design"), F.col(n).alias("right"), F.col("total").alias("total")) for n in ("keep label", "own label")))).alias("x")).select("x.*")


def thresholds(rows: DataFrame, value: str, gold: Column) -> DataFrame:
    """For every threshold that ``value`` takes: rows that reach it, how many of them are gold, and precision and recall. Rows
    are counted by value once; the cumulated sums run over the distinct values."""
    counted = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.count_if(gold).alias("g"))
    down, whole = W.orderBy(F.desc(value)), W.partitionBy()
    reached, hits = F.sum("n").over(down), F.sum("g").over(down)
    told = counted.select(F.col(value).cast("long").alias("threshold"), reached.alias("reached"), hits.alias("hits"), F.sum("g").over(whole).alias("gold"))
    return told.select("threshold", "reached", "hits", F.round(F.col("hits") / F.col("reached"), 6).alias("precision"), F.round(F.try_divide("hits", "gold"), 6).alias("recall"))


def _holds(term: str) -> Callable[[Column], Column]:
    return lambda s: s.contains(term)


def veto_diagnosis(documents: DataFrame, key: str, lexicon: dict[str, list[str]], markers: list[str]) -> DataFrame:
    """Why a veto holds or breaks: for each document and term that occurs in it, the sentences that hold the term, those of
    them with a marker, and whether all have one."""
    parts = F.split(F.lower("text"), r"[.!?;\n]+")
    each = []
    for label, terms in lexicon.items():
        for term in terms:
            holding = F.filter("parts", _holds(term))
            marked = F.filter(holding, lambda s: contains_any(s, markers))
            each.append(F.struct(F.lit(label).alias("label"), F.lit(term).alias("term"), F.size(holding).cast("long").alias("sentences"), F.size(marked).cast("long").alias("marked")))
    rows = documents.where(reduce(Column.__or__, (F.lower("text").contains(t) for terms in lexicon.values() for t in terms))).select(key, parts.alias("parts"))
    found = rows.select(key, F.explode(F.array(*each)).alias("x")).select(key, "x.*").where("sentences > 0")
    return found.withColumn("vetoed", F.col("marked") == F.col("sentences"))
