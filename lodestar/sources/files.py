"""Reading seeds, gold labels and saved runs, and checking what was read."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import orphan_lines

#: Closed vocabularies of the data model.
VOCABULARIES = {
    "tipo": ("site", "noticia", "blog", "vaga", "release", "outro"),
    "confianca": ("baixa", "media", "alta"),
    "classe": ("non-AI", "AI-enabled", "AI-native"),
    "maturidade": ("baixa", "media", "alta"),
    "prioridade": ("baixa", "media", "alta"),
    "quadrante": ("sweet-spot", "prospect-de-evolucao", "ja-otimizada", "fora-do-funil"),
}
ENTITY = T.StructType([T.StructField(n, k) for n, k in (
    ("nome", T.StringType()), ("site", T.StringType()), ("setor", T.StringType()), ("estagio", T.StringType()), ("localizacao", T.StringType()), ("descricao_curta", T.StringType()),
    ("ano_fundacao", T.IntegerType()), ("tamanho_time", T.IntegerType()), ("fonte_descoberta", T.StringType()), ("coletado_em", T.DateType()),
)])
DOCUMENT = T.StructType([T.StructField(n, k) for n, k in (
    ("nome", T.StringType()), ("tipo", T.StringType()), ("titulo", T.StringType()), ("url_fonte", T.StringType()), ("data_publicacao", T.DateType()), ("conteudo_texto", T.StringType()),
)])


#: Schemas of the curated lists: where each page of the corpus is fetched and cited, questions with their anchors, sentences
#: that exclude or don't, spans of texts that are good evidence, and rules that cover entities.
MANIFEST = "tecnologia string, url_fetch string, url_citacao string, formato string, chars_medidos int, nota string"
QUESTIONS = "id string, pergunta string, idioma string, tipo string, tecnologia_esperada string, url_esperada string, frase_ancora string, regime string, termos_ausentes array<string>, justificativa_ausencia string"
EXCLUSIONS = "rotulo string, exclui boolean, frase string, origem string, nota string"
SPAN_LABELS = "chunk int, tecnologia string, ancoras array<string>, nota string"
RULES = "id string, casa_setor array<string>, casa_dor string, tecnologias_esperadas array<string>, origem string, nota string"


def _to_json(texts: pd.Series) -> pd.Series:
    import json

    import yaml

    return texts.map(lambda t: json.dumps(yaml.safe_load(t), default=str))


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``json`` of each YAML file; files are read and parsed by the tasks."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("yaml"))
    return files.select("file", F.pandas_udf(_to_json, T.StringType())("yaml").alias("json"))


def curated(spark: SparkSession, path: str, schema: str, root: str | None = None) -> DataFrame:
    """The rows of a curated YAML list, in the file's order (``place``): the list itself, or the one under ``root``."""
    kind = f"array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in schema.split(','))}>>"
    rows = F.from_json("json", f"{root} {kind}")[root] if root else F.from_json("json", kind)
    return _parsed(spark, path).select("file", F.posexplode(rows).alias("place", "x")).select("file", "place", "x.*")


def question_checks(kind: str = "tipo") -> dict[str, Column]:
    """What a question must have: an address and an anchor if it has an answer, else a reason and no address."""
    answerable = F.col(kind) != "sem_resposta"
    return {
        "no address or anchor": ~answerable | (F.col("url_esperada").isNotNull() & F.col("frase_ancora").isNotNull()),
        "unanswerable with an address": answerable | F.col("url_esperada").isNull(),
        "unanswerable without a reason": answerable | F.col("justificativa_ausencia").isNotNull(),
    }


def exclusion_problems(cases: DataFrame, labels: list[str]) -> DataFrame:
    """``rotulo``, ``reason``: labels that are unknown, or of which only one side is there."""
    sides = cases.groupBy("rotulo").agg(F.count_distinct("exclui").alias("sides"))
    reason = F.when(~F.col("rotulo").isin(*labels), "unknown label").when(F.col("sides") < 2, "one side only")
    return sides.select("rotulo", reason.alias("reason")).where("reason is not null")


def seeds(spark: SparkSession, folder: str) -> DataFrame:
    """One row a YAML file of a folder, by file name: ``file`` and the parsed ``seed``. Curated labels are no part of the
    schema and so are never loaded."""
    nested = T.StructType([*ENTITY.fields, T.StructField("documentos", T.ArrayType(T.StructType(DOCUMENT.fields[1:])))])
    return _parsed(spark, folder).select("file", F.from_json("json", nested).alias("seed")).orderBy("file")


def entities(seeded: DataFrame) -> DataFrame:
    return seeded.select(*(F.col(f"seed.{f.name}") for f in ENTITY.fields))


def documents(seeded: DataFrame) -> DataFrame:
    return seeded.select(F.col("seed.nome").alias("nome"), F.explode("seed.documentos").alias("d")).select("nome", "d.*")


def runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headers of saved runs, newest first; broken files are left out."""
    read = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return read.where("_corrupt is null").drop("_corrupt").orderBy(F.desc("gerado_em"))


def violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """``key`` and ``reason`` for each check that a row fails; a null outcome fails."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in checks.items())))
    return rows.select(key, F.explode(failed).alias("reason"))


def vocabulary_checks(columns: dict[str, str]) -> dict[str, Column]:
    """Checks that columns hold values of their closed vocabulary; null is allowed."""
    return {f"{c} is none of {v}": F.col(c).isNull() | F.col(c).isin(*VOCABULARIES[v]) for c, v in columns.items()}


def seed_checks() -> dict[str, Column]:
    """What a seed must have: a name, three documents or more of two kinds or more, web addresses, and texts of length."""
    d = F.col("seed.documentos")
    return {
        "no name": F.length("seed.nome") > 0,
        "fewer than 3 documents": F.size(d) >= 3,
        "unknown kind": F.forall(d, lambda x: x["tipo"].isin(*VOCABULARIES["tipo"])),
        "fewer than 2 kinds": F.size(F.array_distinct(F.transform(d, lambda x: x["tipo"]))) >= 2,
        "no web address": F.forall(d, lambda x: x["url_fonte"].startswith("http")),
        "short text": F.forall(d, lambda x: F.length(x["conteudo_texto"]) >= 200),
        "page furniture or orphan punctuation": F.forall(d, lambda x: F.size(orphan_lines(x["conteudo_texto"])) == 0),
    }
