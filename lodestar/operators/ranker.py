"""A reranker that is trained: pairwise logistic ranking over features of a question and a text, cross-fitted.

A candidate's features are its scores in both arms, the shares of the question's words, of its neighbouring words and of its
word triples that the text holds, where the text first holds one, and its length. For each question, every right candidate
is set against every wrong one, and the weights make the right one's score the larger. Newton's method needs sums over all
pairs only, by fold, so a round is one aggregation whatever the number of pairs. A question is scored with weights that were
fitted on the other folds. Without a fold that has pairs, the weights are zero and the fused order stays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import tokens

NAMES = ("cosine", "bm25", "words", "pairs", "triples", "early", "length")


def _share(asked: Column, held: Column) -> Column:
    """How much of a list of hashes another one has; 0 of an empty one."""
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, held)) / F.size(asked)).otherwise(0.0)


def _runs(words: Column, n: int) -> Column:
    """Hashes of ``n`` words in a row."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n)))))).otherwise(F.array().cast("array<bigint>"))


def _runs_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, the length in tokens, and the runs of one to three of them, each text's once."""
    own = rows.select(key, tokens(F.coalesce(text, F.lit(""))).alias("t"))
    return own.select(key, F.size("t").alias("n"), *(_runs(F.col("t"), n).alias(f"r{n}") for n in (1, 2, 3)))


def features(candidates: DataFrame, questions: DataFrame, texts: DataFrame, key: str, query_key: str) -> DataFrame:
    """``query_key``, ``key``, ``position`` and a column for each of ``NAMES``, from fused candidates (``score_0``, ``score_1``,
    ``position``), questions (``question``) and texts (``text``). Texts are tokenized once each, not once a candidate."""
    found = candidates.select(query_key, key, "position", F.coalesce("score_0", F.lit(0.0)).alias("cosine"), F.coalesce("score_1", F.lit(0.0)).alias("bm25"))
    held = _runs_of(texts.join(found.select(key).distinct(), key), key, "text")
    asked = _runs_of(questions, query_key, "question").select(query_key, *(F.col(f"r{n}").alias(f"q{n}") for n in (1, 2, 3)))
    joined = found.join(held, key).join(asked, query_key)
    first = F.array_position("r1", F.get(F.array_intersect("q1", "r1"), F.lit(0)))
    early = F.when(F.coalesce(first, F.lit(0)) > 0, 1 / first).otherwise(0.0)
    shares = (_share(F.col(f"q{n}"), F.col(f"r{n}")).alias(name) for n, name in enumerate(("words", "pairs", "triples"), start=1))
    return joined.select(query_key, key, "position", "cosine", F.log1p("bm25").alias("bm25"), *shares, early.alias("early"), F.log1p("n").alias("length"))


def fold_of(query_key: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(29), query_key), F.lit(folds)).cast("int")


def fit(examples: DataFrame, query_key: str, folds: int = 4, penalty: float = 1.0, rounds: int = 8) -> dict[int, list[float]]:
    """Weights for each fold, from the pairs of the others. ``examples``: features and ``right``; candidates of a question are
    the fused list's few, so its pairs are a few hundred. A round sends ``folds`` rows to the driver."""
    d = len(NAMES)
    right, wrong = (examples.where(c).select(query_key, F.array(*NAMES).alias(n)) for c, n in (("right", "x"), ("not right", "y")))
    apart = right.join(wrong, query_key).select(fold_of(query_key, folds).alias("fold"), F.zip_with("x", "y", lambda a, b: a - b).alias("d"))
    weights = {f: np.zeros(d) for f in range(folds)}
    at = [F.get("d", F.lit(i)) for i in range(d)]
    for _ in range(rounds):
        # each fold's pairs count for the weights of all other folds
        every = apart.withColumn("for", F.explode(F.array(*map(F.lit, range(folds))))).where(F.col("for") != F.col("fold"))
        score = F.lit(0.0)
        for f, w in weights.items():
            score = score + F.when(F.col("for") == f, sum((float(v) * c for v, c in zip(w, at, strict=True)), F.lit(0.0))).otherwise(0.0)
        chance = 1 / (1 + F.exp(score))  # of the wrong order
        rows = every.withColumn("p", chance).groupBy("for").agg(
            F.count(F.lit(1)).alias("n"),
            *(F.sum(F.col("p") * at[i]).alias(f"g{i}") for i in range(d)),
            *(F.sum(F.col("p") * (1 - F.col("p")) * at[i] * at[j]).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)),
        )
        moved = 0.0
        for r in rows.collect():
            w = weights[r["for"]]
            g = np.array([r[f"g{i}"] for i in range(d)]) / r.n - penalty / r.n * w
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / r.n + penalty / r.n * np.eye(d)
            step = np.linalg.solve(h + 1e-9 * np.eye(d), g)
            step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))  # far from the answer a whole step may go astray
            weights[r["for"]] = w + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-8:
            break
    return {f: w.tolist() for f, w in weights.items()}


def scores(found: DataFrame, weights: dict[int, list[float]], key: str, query_key: str) -> DataFrame:
    """``query_key``, ``key`` and ``rerank_score`` of features, each question by the weights of its fold."""
    fold, score = fold_of(query_key, len(weights)), F.lit(0.0)
    for f, w in weights.items():
        score = score + F.when(fold == f, sum((v * F.col(n) for v, n in zip(w, NAMES, strict=True)), F.lit(0.0))).otherwise(0.0)
    return found.select(query_key, key, F.round(score, 6).alias("rerank_score"))
