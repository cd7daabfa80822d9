"""A table of requests carried to recommendations in one plan: planned as rows, answered by search, completed by rules.

A request is a sentence. Its words choose sectors and needs by lexicons, its other words are looked up in the index, entities
are ranked by their best document, and for each need of a chosen entity the entity's own documents are searched for the
need's words. Scores come from postings alone; texts are fetched at the end, for the few documents that are cited.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.text import tokens

from .search import Index, top


def planned(requests: DataFrame, key: str, sectors: dict[str, list[str]], needs: dict[str, list[str]], stopwords: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``sectors``, ``needs`` (in the order of the request, without repeats) and ``keywords`` (tokens that are in neither
    lexicon) of each row of ``requests`` (``key``, ``text``). A null or empty text plans nothing."""
    said = requests.select(key, F.coalesce(tokens(F.col("text"), stopwords), F.array().cast("array<string>")).alias("words"))

    def named(lexicon: dict[str, list[str]]) -> Column:
        """The entry that a word is of, by any of its terms at the word's beginning; null of none."""
        return lambda w: reduce(lambda c, kv: c.when(reduce(Column.__or__, (w.startswith(t) for t in kv[1])), kv[0]), lexicon.items(), F.when(F.lit(False), ""))

    of_sector, of_need = named(sectors), named(needs)
    own = lambda f: F.array_distinct(F.array_compact(F.transform("words", f)))
    rest = F.array_distinct(F.filter("words", lambda w: of_sector(w).isNull() & of_need(w).isNull()))
    return said.select(key, own(of_sector).alias("sectors"), own(of_need).alias("needs"), rest.alias("keywords"))


def _scored(held: Index, asked: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Sum of ``idf`` x ``tf`` of the asked terms (``keys``, ``term``) in each document; from postings alone."""
    rarity = held.frequencies.crossJoin(F.broadcast(held.stats)).select("term", F.log(1 + F.col("n") / F.col("df")).alias("idf"))  # one row
    return asked.join(rarity, "term").join(held.postings, "term").groupBy(*keys, key).agg(F.sum(F.col("idf") * F.col("tf") / (1 + F.col("tf"))).alias("score"))


def answered(plans: DataFrame, held: Index, documents: DataFrame, needs: dict[str, list[str]], key: str, doc: str, entity: str, sector: str, entities: int = 3, cited: int = 1, best: DataFrame | None = None) -> DataFrame:
    """``key``, ``entity``, ``entity_place``, ``need``, ``need_place``, ``doc`` and ``score``: of each request the best ``entities`` and,
    for each of its needs in their order (all needs, where it names none), the ``cited`` best of the entity's documents.

    ``documents``: ``doc``, ``entity``, ``sector``, without texts. A request without keywords ranks the entities of its sectors by
    name; one that names nothing at all has no answer. An entity without a document for a need has no row for it. ``best`` (``key``,
    ``entity``, ``best``) may give the best entities of the requests with keywords (:func:`heaviest.best`); ``held`` then needs only the
    terms of ``needs``. Otherwise every pair of a request and a document that share a term is scored from postings."""
    small = documents.select(doc, entity, sector)
    wanted = plans.where(F.size("keywords") + F.size("sectors") + F.size("needs") > 0)
    bare = small.select(entity, sector).distinct()
    allowed = wanted.select(key, F.explode_outer("sectors").alias("wanted"), (F.size("keywords") > 0).alias("spoken"))
    # a request's entities: of its sectors, if it names any, and with a hit, if it has keywords
    if best is None:
        hits = _scored(held, wanted.select(key, F.explode("keywords").alias("term")), [key], doc).join(small, doc)
        best = hits.groupBy(key, entity, sector).agg(F.max("score").alias("best")).join(allowed, key).where("wanted is null or wanted = " + sector)
    by_name = allowed.where("not spoken and wanted is not null").join(bare, F.col("wanted") == F.col(sector)).select(key, entity, F.lit(0.0).alias("best"))
    free = allowed.where("not spoken and wanted is null").select(key)
    first = bare.select(entity).distinct().orderBy(entity).limit(entities)
    by_need = free.crossJoin(F.broadcast(first)).select(key, entity, F.lit(0.0).alias("best"))  # ``entities`` rows
    ranked = best.select(key, entity, "best").union(by_name).union(by_need).groupBy(key, entity).agg(F.round(F.max("best"), 6).alias("best"))
    chosen = top(ranked, key, "best", entity, entities).select(key, entity, F.col("rank").alias("entity_place"))
    every = F.array(*map(F.lit, needs))
    of_needs = plans.select(key, F.posexplode(F.when(F.size("needs") > 0, F.col("needs")).otherwise(every)).alias("need_place", "need"))
    terms = reduce(lambda c, kv: c.when(F.col("need") == kv[0], F.array(*map(F.lit, kv[1]))), needs.items(), F.when(F.lit(False), F.array().cast("array<string>")))
    # a need's documents are scored once, whatever the number of requests that ask for it
    lexicon = documents.sparkSession.createDataFrame([(n,) for n in needs], "need string").select("need", F.explode(terms).alias("term"))
    of_need = _scored(held, lexicon, ["need"], doc).join(small.select(doc, entity), doc)
    of_entity = of_need.withColumn("p", F.row_number().over(W.partitionBy("need", entity).orderBy(F.desc(F.round("score", 6)), doc))).where(F.col("p") <= cited)
    out = chosen.join(of_needs, key).join(of_entity, ["need", entity])
    return out.select(key, entity, F.col("entity_place").cast("long").alias("entity_place"), "need", (F.col("need_place") + 1).cast("long").alias("need_place"), doc, F.round("score", 6).alias("score"))


def recommended(answers: DataFrame, documents: DataFrame, key: str, doc: str, entity: str, head: int = 200) -> DataFrame:
    """One row a request and entity: ``needs`` and ``evidence`` (numbered blocks for a prompt), in the order of the needs. The texts
    of cited documents are fetched here, each once, and shortened to ``head`` characters."""
    cited = answers.select(doc).distinct().join(documents.select(doc, F.substring(F.coalesce("text", F.lit("")), 1, head).alias("head")), doc)
    rows = answers.join(cited, doc).groupBy(key, entity, "entity_place").agg(F.array_sort(F.collect_list(F.struct("need_place", "need", doc, "head"))).alias("x"))
    blocks = F.transform("x", lambda e, i: F.concat(F.lit("["), i.cast("string"), F.lit("] ("), e["need"], F.lit(") "), e["head"]))
    return rows.select(key, entity, "entity_place", F.array_join(F.transform("x", lambda e: e["need"]), ",").alias("needs"), F.array_join(blocks, "\n\n").alias("evidence"))
