"""Remote models as pluggable providers: embedder, reranker, generator. Without one the honest default is ``none``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
Reranker = Callable[[str, list[str]], list[float]]
Generator = Callable[[str, list[str]], tuple[str, list[int]] | None]
Judge = Callable[[str, list[str]], list[int]]

_RERANKERS: dict[str, Reranker | None] = {"none": None}
_GENERATORS: dict[str, Generator | None] = {"none": None}


def register_reranker(name: str, fn: Reranker) -> None:
    _RERANKERS[name] = fn


def register_generator(name: str, fn: Generator) -> None:
    _GENERATORS[name] = fn


def reranker(name: str) -> Reranker | None:
    if name not in _RERANKERS:
        raise ValueError(f"unknown reranker: {name}")
    return _RERANKERS[name]


def generator(name: str) -> Generator | None:
    if name not in _GENERATORS:
        raise ValueError(f"unknown generator: {name}")
    return _GENERATORS[name]


def embed(passages: DataFrame, key: str, embedder: Embedder, batch: int = 16) -> DataFrame:
    """``key`` and ``embedding`` of every passage, in batches of ``batch`` texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = [v for i in range(0, len(frame), batch) for v in embedder(frame["text"].iloc[i : i + batch].tolist())]
            yield pd.DataFrame({key: frame[key], "embedding": vectors})

    return passages.select(key, "text").mapInPandas(run, f"{key} {dict(passages.dtypes)[key]}, embedding array<float>")


def rerank_scores(pairs: DataFrame, key: str, query_key: str, model: Reranker | None, batch: int = 32) -> DataFrame | None:
    """``query_key``, ``key`` and ``rerank_score`` of ``pairs`` (also ``question``, ``text``); None without a model."""
    if model is None:
        return None

    def run(group: pd.DataFrame) -> pd.DataFrame:
        scores = [s for i in range(0, len(group), batch) for s in model(group["question"].iloc[0], group["text"].iloc[i : i + batch].tolist())]
        return pd.DataFrame({query_key: group[query_key], key: group[key], "rerank_score": scores})

    kinds = dict(pairs.dtypes)
    return pairs.groupBy(query_key).applyInPandas(run, f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, rerank_score double")


def judged(found: DataFrame, entity: str, question: str, judge: Judge | None) -> DataFrame:
    """Evidence (``entity``, ``kind``, ``span``) that a judge approves, by its places in the entity's and kind's list, which
    is a few spans long. Without a judge, or where it fails, all of it stays; places out of range are dropped."""
    if judge is None:
        return found

    def run(group: pd.DataFrame) -> pd.DataFrame:
        try:
            return group.iloc[sorted({i for i in judge(question, group["span"].tolist()) if 0 <= i < len(group)})]
        except Exception:  # the judge is remote and optional
            return group

    return found.groupBy(entity, "kind").applyInPandas(run, found.schema)


def sustained(claims: DataFrame, judge: Judge | None) -> DataFrame:
    """Adds ``sustained``: whether a judge holds that a claim's ``span`` sustains its ``text``; null without a judge."""
    if judge is None:
        return claims.withColumn("sustained", F.lit(None).cast("boolean"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(sustained=[bool(judge(t, [s])) for t, s in zip(frame["text"], frame["span"], strict=True)])

    fields = ", ".join(f"`{n}` {k}" for n, k in claims.dtypes)
    return claims.mapInPandas(run, f"{fields}, sustained boolean")


def context(passages: list[tuple[str, str]]) -> str:
    """Numbered blocks for a prompt."""
    return "\n\n".join(f"[{i}] ({name}) {text}" for i, (name, text) in enumerate(passages))


def answer(questions: DataFrame, passages: DataFrame, query_key: str, model: Generator | None) -> DataFrame:
    """``query_key``, ``answer``, ``cited`` (places in the list of passages), ``abstained``, ``reason``.

    Without a model or without passages the answer is an abstention and nothing is called. Places out of range are
    dropped; an answer has no reason. ``passages``: ``query_key``, ``text``, ordered by ``doc_id``.
    """
    listed = passages.groupBy(query_key).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda p: p["text"]).alias("passages"))
    joined = questions.join(listed, query_key, "left").withColumn("passages", F.coalesce("passages", F.array().cast("array<string>")))
    if model is None:
        return joined.select(query_key, F.lit("").alias("answer"), F.array().cast("array<int>").alias("cited"), F.lit(True).alias("abstained"), F.lit("no provider").alias("reason"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, question, found in zip(frame[query_key], frame["question"], frame["passages"], strict=True):
                made = model(question, list(found)) if len(found) else None
                if made is None:
                    rows.append((k, "", [], True, "nothing answers the question" if len(found) else "no passages"))
                else:
                    rows.append((k, made[0], [i for i in made[1] if 0 <= i < len(found)], False, None))
            yield pd.DataFrame(rows, columns=[query_key, "answer", "cited", "abstained", "reason"])

    return joined.mapInPandas(run, f"{query_key} {dict(questions.dtypes)[query_key]}, answer string, cited array<int>, abstained boolean, reason string")
