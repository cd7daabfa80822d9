"""Keeping tables: upserts, stale rows, append and last-value channels, validation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.sources.shared import keep

_RUN_ID = re.compile(r"^[A-Za-z0-9_-]{1,64}$")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of, or beside, its own."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def without_stale(rows: DataFrame, fresh: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Rows of a document that was cut anew, up to its new number of parts; other documents' rows stay."""
    n = fresh.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"))
    return rows.join(n, keys, "left").where(F.col("parts").isNull() | (F.col(ordinal) < F.col("parts"))).drop("parts")


def appended(steps: DataFrame, thread: str, order: str) -> DataFrame:
    """An append channel: every step of a thread, with its ``place`` from 0 for steps that are numbered without gaps."""
    first = steps.groupBy(thread).agg(F.min(order).alias("first"))
    return steps.join(first, thread).withColumn("place", F.col(order) - F.col("first")).drop("first")


def last_value(steps: DataFrame, thread: str, order: str) -> DataFrame:
    """An overwriting channel: the row of the last step."""
    last = steps.groupBy(thread).agg(F.max_by(F.struct(*(c for c in steps.columns if c != thread)), order).alias("last"))
    return last.select(thread, "last.*").select(*steps.columns)


def placed(rows: DataFrame, group: Column, order: str, head: Column, by: str | None = None) -> DataFrame:
    """``place``: 1 for the first row by ``group``, then ``order``, of all rows or of each ``by``. ``head`` grows with ``order``
    and cuts it into parts of bounded size (a number over a width, a name's first letters); rows are counted by part, so no
    task orders more than one part, and only the counts meet."""
    owner = [by] if by else []
    keyed = rows.withColumns({"__group": group, "__head": head})
    part = [*owner, "__group", "__head"]
    counts = keyed.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(W.partitionBy(*owner).orderBy("__group", "__head")) - F.col("__n")).drop("__n")  # a row a part
    own = F.row_number().over(W.partitionBy(*part).orderBy(order))
    return keyed.withColumn("place", own).join(before, part).withColumn("place", (F.col("place") + F.col("__before")).cast("long")).drop("__group", "__head", "__before")


def placed_by_range(rows: DataFrame, group: Column, order: str) -> DataFrame:
    """:func:`placed` over all rows, for an order of any kind: rows are dealt to parts by ranges of it, whatever their values begin
    with, and saved; each part is then counted and numbered by itself, and only the counts meet."""
    dealt = rows.withColumn("__group", group).repartitionByRange("__group", order).withColumn("__part", F.spark_partition_id())
    kept = keep(dealt, "ranged")
    counts = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).drop("__n")  # a row a part
    own = F.row_number().over(W.partitionBy("__part").orderBy("__group", order))
    return kept.withColumn("place", own).join(before, "__part").withColumn("place", (F.col("place") + F.col("__before")).cast("long")).drop("__group", "__part", "__before")


def nested(rows: DataFrame, group: str, key: str, fields: list[str], most: int = 10_000, part: Column | None = None) -> DataFrame:
    """Rows under their group, as ``documents``: one array, or several ``part``s of about ``most`` elements where a group has
    more; or in the parts that ``part`` names. Only the fields that are kept are gathered."""
    narrow = rows.select(group, key, *fields, *([] if part is None else [part.alias("part")]))
    if part is not None:
        return narrow.groupBy(group, "part").agg(F.array_sort(F.collect_list(F.struct(key, *fields))).alias("documents"))
    parts = narrow.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    dealt = narrow.join(parts, group).withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    return dealt.groupBy(group, "part").agg(F.array_sort(F.collect_list(F.struct(key, *fields))).alias("documents"))


def re_embedded(chunks: DataFrame, vectors: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``chunks`` with the vector columns of ``vectors`` where it has the key; all other columns and rows stay."""
    new = vectors.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__new"))
    joined = chunks.join(new, key, "left")
    return joined.withColumns({c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).select(*chunks.columns)


def seeded(old_entities: DataFrame, old_documents: DataFrame, entities: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after a seed: entities by name (an old day of collection stays), documents by name and address."""
    kept = old_entities.select("nome", F.col("coletado_em").alias("__day"))
    fresh = entities.join(kept, "nome", "left").withColumn("coletado_em", F.coalesce("__day", "coletado_em")).select(*old_entities.columns)
    return upsert(old_entities, fresh, ["nome"]), upsert(old_documents, documents.select(*old_documents.columns), ["nome", "url_fonte"])


def stamped(recommendations: DataFrame, provider: str, entity: str) -> DataFrame:
    """A run to be kept: recommendations with the provider that ranked them and the number of entities."""
    n = recommendations.agg(F.count_distinct(entity).alias("entities"))
    return recommendations.withColumn("provider", F.lit(provider)).crossJoin(F.broadcast(n))  # one row


def run_path(folder: str, run_id: str) -> str:
    """Where a run is kept; an id that could leave the folder is refused."""
    if not _RUN_ID.match(run_id):
        raise ValueError(f"bad run id: {run_id!r}")
    return f"{folder.rstrip('/')}/{run_id}"


def save_run(run: DataFrame, folder: str, run_id: str) -> None:
    run.write.mode("overwrite").json(run_path(folder, run_id))


def without_text(entities: DataFrame) -> DataFrame:
    """Without the raw ``text``: of the rows, or of the elements of ``documents`` where they are nested."""
    nested_kind = dict(entities.dtypes).get("documents", "").startswith("array<struct")
    return entities.withColumn("documents", F.transform("documents", lambda d: d.dropFields("text"))) if nested_kind else entities.drop("text")
