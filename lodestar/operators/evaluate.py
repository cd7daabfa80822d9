"""Measures of retrieval and rules; a constant-answer baseline stands beside each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import occurrences


def anchored(documents: DataFrame, asked: DataFrame, key: str, query_key: str) -> DataFrame:
    """Documents (``key``, ``text``) that hold a query's ``anchor`` word for word: ``query_key``, ``key``. An empty anchor is in
    none. One pass over the texts, whatever the number of anchors."""
    return occurrences.holding(documents, asked.select(query_key, "anchor"), "anchor", "text", key).select(query_key, key).distinct()


def recall_at(ranked: DataFrame, truth: DataFrame, key: str, query_key: str, ks: tuple[int, ...]) -> DataFrame:
    """Share of answerable queries with a right document among the first k, all k from one ranking."""
    first = ranked.join(truth, [query_key, key]).groupBy(query_key).agg(F.min("rank").alias("first"))
    each = truth.select(query_key).distinct().join(first, query_key, "left").withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks))))
    hit = F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)
    return each.groupBy(F.col("k").cast("long").alias("k")).agg(F.round(F.avg(hit), 6).alias("recall"), F.count(F.lit(1)).alias("answerable"))


def recall_by(ranked: DataFrame, truth: DataFrame, key: str, query_key: str, arm: str, arms: list[str], ks: tuple[int, ...]) -> DataFrame:
    """:func:`recall_at` for each arm of ``ranked``; an arm that finds nothing has a recall of 0."""
    first = ranked.join(truth, [query_key, key]).groupBy(arm, query_key).agg(F.min("rank").alias("first"))
    every = truth.select(query_key).distinct().withColumn(arm, F.explode(F.array(*map(F.lit, arms)))).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)
    joined = every.join(first, [arm, query_key], "left")
    return joined.groupBy(arm, F.col("k").cast("long").alias("k")).agg(F.round(F.avg(hit), 6).alias("recall"), F.count(F.lit(1)).alias("answerable"))


def abstention_margin(ranked: DataFrame, truth: DataFrame, key: str, query_key: str) -> DataFrame:
    """The worst answerable query's best right score, less the best score of any unanswerable query."""
    low = ranked.join(truth, [query_key, key]).groupBy(query_key).agg(F.max("score").alias("m")).agg(F.min("m").alias("lowest_answer"))
    high = ranked.join(truth.select(query_key).distinct(), query_key, "left_anti").agg(F.max("score").alias("highest_unanswerable"))
    return low.crossJoin(high).withColumn("margin", F.round(F.col("lowest_answer") - F.col("highest_unanswerable"), 6))


def fusion_grid(dense: DataFrame, lexical: DataFrame, key: str, query_key: str, ks: tuple[int, ...], weights: tuple[float, ...], keep: int) -> DataFrame:
    """Reciprocal rank fusion under every setting, from the two lists as they are."""
    settings = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("weight")) for k in ks for w in weights)))
    arms = dense.select(query_key, key, "rank", F.lit(0).alias("arm")).union(lexical.select(query_key, key, "rank", F.lit(1).alias("arm")))
    rows = arms.withColumn("s", settings).select(query_key, key, "rank", "arm", "s.k", "s.weight")
    part = F.when(F.col("arm") == 0, 1.0).otherwise(F.col("weight")) / (F.col("k") + F.col("rank"))
    fused = rows.groupBy("k", "weight", query_key, key).agg(F.round(F.sum(part), 6).alias("fused"), F.min(F.struct("arm", "rank")).alias("seen"))
    order = W.partitionBy("k", "weight", query_key).orderBy(F.desc("fused"), "seen")
    placed = fused.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= keep)
    return placed.select(F.col("k").cast("long").alias("k"), "weight", query_key, key, "fused", "position")


def precision_recall(sets: DataFrame, emitted: str, expected: str, ambiguous: str) -> DataFrame:
    """Macro averages over entities; ambiguous labels count for neither, and an entity that emits nothing has no
    precision unless nothing was expected, when it is 1."""
    counted = F.array_except(emitted, ambiguous)
    right = F.size(F.array_intersect(counted, expected))
    precision = F.when(F.size(counted) > 0, right / F.size(counted)).when(F.size(expected) == 0, 1.0)
    recall = F.when(F.size(expected) > 0, right / F.size(expected))
    return sets.agg(
        F.round(F.avg(precision), 6).alias("precision"), F.round(F.avg(recall), 6).alias("recall"), F.count_distinct(F.array_sort(F.array_distinct(emitted))).alias("distinct_sets"), F.count(F.lit(1)).alias("entities")
    )


def scoreboard(rows: DataFrame, field: str, predicted: Column, accepted: Column) -> DataFrame:
    """Correct, ambiguous, unmeasured and wrong answers; ``accepted`` is the list of labels that are right, null when unmeasured."""
    right = F.array_contains(accepted, predicted)
    outcome = F.when(accepted.isNull(), "unmeasured").when((F.size(accepted) > 1) & right, "ambiguous").when(right, "correct").otherwise("wrong")
    return rows.groupBy(F.lit(field).alias("field"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def confusion(rows: DataFrame, expected: Column, found: Column) -> DataFrame:
    """Both sides on their own: what should be found and wasn't, and what shouldn't and was."""
    return rows.groupBy(expected.alias("expected")).agg(F.count(F.lit(1)).alias("n"), F.count_if(found).alias("found"), F.count_if(found != expected).alias("wrong"))


def rule_coverage(entities: DataFrame, rules: DataFrame, emitted: DataFrame, constant: list[str], entity: str) -> DataFrame:
    """Pairs of an entity and a rule that covers it (part of its sector's name, or one of its needs), and whether what was
    emitted, or a constant answer, holds an expected value. ``rules`` is a list of a few rows."""
    covers = F.exists("sector_parts", lambda s: F.lower("sector").contains(s)) | F.array_contains("needs", F.col("need"))
    pairs = entities.join(rules, covers)
    answers = emitted.groupBy(entity).agg(F.collect_set("value").alias("values"))
    joined = pairs.join(answers, entity, "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))
    trivial = F.array(*(F.lit(c) for c in constant))
    return joined.groupBy("rule_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.arrays_overlap("values", "expected")).alias("hits"), F.count_if(F.arrays_overlap(trivial, F.col("expected"))).alias("trivial_hits"))


def strict_recall_at(ranked: DataFrame, truth: DataFrame, key: str, query_key: str, ks: tuple[int, ...]) -> DataFrame:
    """Loose and strict recall from one ranking: a document of the right group among the first k, and one of those that
    holds the anchor itself. ``ranked`` has ``group``; ``truth`` (``query_key``, ``key``, ``group``) the anchored documents."""
    groups = truth.select(query_key, "group").distinct()
    near = ranked.join(groups, [query_key, "group"]).join(truth.select(query_key, key, F.lit(True).alias("anchored")), [query_key, key], "left")
    first = near.groupBy(query_key).agg(F.min("rank").alias("loose"), F.min(F.when(F.col("anchored"), F.col("rank"))).alias("strict"))
    each = truth.select(query_key).distinct().join(first, query_key, "left").withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks))))
    share = lambda c: F.round(F.avg(F.when(F.col(c) <= F.col("k"), 1.0).otherwise(0.0)), 6)
    return each.groupBy(F.col("k").cast("long").alias("k")).agg(share("loose").alias("loose"), share("strict").alias("strict"), F.count(F.lit(1)).alias("answerable"))


def first_places(hits: DataFrame, engines: list[str]) -> DataFrame:
    """``hits`` (a column of ranks an engine): how often each engine has a right document first, and is better or worse than
    the first engine of the list."""
    far = lambda c: F.coalesce(F.col(c), F.lit(1 << 30))
    base = far(engines[0])
    parts = [F.struct(F.lit(e).alias("engine"), (far(e) == 1).cast("int").alias("first"), (far(e) < base).cast("int").alias("better"), (far(e) > base).cast("int").alias("worse")) for e in engines]
    return hits.select(F.explode(F.array(*parts)).alias("x")).select("x.*").groupBy("engine").agg(*(F.sum(c).cast("long").alias(c) for c in ("first", "better", "worse")))


def accuracy_by(pairs: DataFrame, flag: str, right: Column) -> DataFrame:
    """Right answers and their share on either side of a flag."""
    return pairs.groupBy(flag).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right"), F.round(F.avg(right.cast("double")), 6).alias("share"))


def partition_problems(sets: DataFrame, key: str, parts: list[str], vocabulary: list[str]) -> DataFrame:
    """``key``, ``reason``, ``labels``: lists that should be disjoint and cover a vocabulary, and where they don't."""
    listed = {p: F.coalesce(p, F.array().cast("array<string>")) for p in parts}
    whole = F.array(*map(F.lit, vocabulary))
    said = [F.struct(F.lit(f"unknown in {p}").alias("reason"), F.array_sort(F.array_except(c, whole)).alias("labels")) for p, c in listed.items()]
    pairs = [(a, b) for i, a in enumerate(parts) for b in parts[i + 1 :]]
    said += [F.struct(F.lit(f"in {a} and {b}").alias("reason"), F.array_sort(F.array_intersect(listed[a], listed[b])).alias("labels")) for a, b in pairs]
    every = F.flatten(F.array(*listed.values()))
    said.append(F.struct(F.lit("in none").alias("reason"), F.array_sort(F.array_except(whole, every)).alias("labels")))
    return sets.select(key, F.explode(F.array(*said)).alias("x")).select(key, "x.*").where(F.size("labels") > 0)


def ceiling(sets: DataFrame, candidates: str, expected: str) -> DataFrame:
    """The most that any choice among the candidates could find: expected labels that are candidates at all."""
    reached = F.size(F.array_intersect(candidates, expected))
    return sets.agg(F.sum(reached).cast("long").alias("reachable"), F.sum(F.size(expected)).cast("long").alias("total"), F.count_if(reached < F.size(expected)).alias("short"))


def anchors_hit(rows: DataFrame, chosen: str, anchors: list[str], head: int = 150) -> DataFrame:
    """A chosen span against the plain beginning of the text: how often each holds an anchor, of texts that have one."""
    has = lambda c: reduce(Column.__or__, (c.contains(a) for a in anchors))
    aimed = rows.where(has(F.col("text")))
    counted = aimed.agg(F.count(F.lit(1)).alias("n"), F.count_if(has(F.substring("text", 1, head))).alias("head"), F.count_if(has(F.col(chosen))).alias("chosen"))
    return counted
