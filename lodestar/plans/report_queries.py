"""Queries behind the report and the remaining measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import evaluate, rules, tables

from .registry import query, table
from .retrieval_queries import _ITEMS, ENGINES, ENGINES_SQL, TRUTH_SQL, bm25_sql, engine_rows, lexical, truth
from .rule_queries import _CLASS, _CONF_SQL, _DEEP_SQL, _LEVEL, _PRIORITY, _QUADRANT, CLAIMS_SQL, _graded, claims, claims_sql, facts

@query("SELECT lang, n, place FROM (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS place FROM documents GROUP BY lang) WHERE place <= 3")
def most_common_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("seen")).orderBy(F.desc("n"), "seen").limit(3)
    return counted.select("lang", "n", F.row_number().over(W.orderBy(F.desc("n"), "seen")).cast("long").alias("place"))  # three rows


@query(f"WITH {CLAIMS_SQL}, {_DEEP_SQL}, c AS (SELECT {_CLASS} AS class, {_LEVEL} AS level FROM facts) SELECT class, count(*) FILTER (level = 'baixa') AS baixa, count(*) FILTER (level = 'media') AS media, count(*) FILTER (level = 'alta') AS alta FROM c GROUP BY class")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    c = f.select(rules.class_of(rules.class_points(f.autopilot, f.data, f.technical)).alias("class"), rules.maturity(f.deep).alias("level"))
    return c.groupBy("class").pivot("level", list(rules.CONFIDENCE)).count().na.fill(0)


@query(f"""WITH {_CONF_SQL}, {_DEEP_SQL}, low AS (SELECT source, ['baixa', 'media', 'alta'][min(list_position(['baixa', 'media', 'alta'], confidence))] AS confidence FROM graded GROUP BY source),
c AS (SELECT source, {_CLASS} AS class, {_LEVEL} AS level, (autopilot OR data OR technical) AS verified FROM facts), q AS (SELECT *, {_QUADRANT} AS quadrant FROM c),
p AS (SELECT q.source, quadrant, coalesce(confidence, 'baixa') AS confidence, verified FROM q LEFT JOIN low USING (source)), r AS (SELECT *, {_PRIORITY} AS priority FROM p)
SELECT source, quadrant, confidence, priority, row_number() OVER (ORDER BY CASE priority WHEN 'alta' THEN 0 WHEN 'media' THEN 1 ELSE 2 END, source) AS place FROM r""")
def entity_priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    low = _graded(spark, sf_dir).groupBy("source").agg(rules.lowest(rules.CONFIDENCE, F.col("confidence")).alias("confidence"))
    c = f.select("source", rules.class_of(rules.class_points(f.autopilot, f.data, f.technical)).alias("class"), rules.maturity(f.deep).alias("level"), (f.autopilot | f.data | f.technical).alias("verified"))
    q = c.join(low, "source", "left").select("source", "verified", rules.quadrant(F.col("class"), F.col("level"), F.col("verified")).alias("quadrant"), F.coalesce("confidence", F.lit("baixa")).alias("confidence"))
    p = q.select("source", "quadrant", "confidence", rules.priority(q.quadrant, q.confidence, q.verified).alias("priority"))
    rank = F.when(F.col("priority") == "alta", 0).when(F.col("priority") == "media", 1).otherwise(2)
    return tables.placed_by_range(p, rank, "source")


_HITS_SQL = f"{ENGINES_SQL}, h AS (SELECT engine, query_id, min(rank) AS rank FROM e JOIN truth USING (query_id, doc_id) GROUP BY 1, 2)"
_POSITIONS_SQL = ", ".join(f"max(rank) FILTER (engine = '{n}') AS {n}" for n in ENGINES)


def engine_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rank of a right document for each test item and engine; null where an engine finds none."""
    right = truth(spark, sf_dir)
    hits = engine_rows(spark, sf_dir).join(right, ["query_id", "doc_id"]).groupBy("query_id").pivot("engine", ENGINES).agg(F.min("rank").cast("long"))
    return right.select("query_id").distinct().join(hits, "query_id", "left")


@query(f"{_HITS_SQL} SELECT t.query_id, {_POSITIONS_SQL} FROM (SELECT DISTINCT query_id FROM truth) t LEFT JOIN h ON h.query_id = t.query_id GROUP BY t.query_id")
def rank_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_hits(spark, sf_dir)


_FAR_SQL = "coalesce({0}, 1 << 30)"
_FIRST_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS engine, count(*) FILTER ({_FAR_SQL.format(n)} = 1) AS first, count(*) FILTER ({_FAR_SQL.format(n)} < {_FAR_SQL.format('dense')}) AS better, count(*) FILTER ({_FAR_SQL.format(n)} > {_FAR_SQL.format('dense')}) AS worse FROM w HAVING count(*) > 0"
    for n in ENGINES
)


@query(f"{_HITS_SQL}, w AS (SELECT t.query_id, {_POSITIONS_SQL} FROM (SELECT DISTINCT query_id FROM truth) t LEFT JOIN h ON h.query_id = t.query_id GROUP BY t.query_id) {_FIRST_SQL}")
def first_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each engine comes first, and against the plain dense one."""
    return evaluate.first_places(engine_hits(spark, sf_dir), ENGINES)


@query(f"""WITH {bm25_sql(_ITEMS)}, {TRUTH_SQL}, m AS (SELECT query_id, max(score) AS top FROM lexical GROUP BY 1)
SELECT (query_id IN (SELECT query_id FROM truth)) AS answerable, count(*) AS n, count(*) FILTER (coalesce(top, 0) >= 100) AS answered FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN m USING (query_id) GROUP BY 1""")
def abstention_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lexical(spark, sf_dir, items=True).groupBy("query_id").agg(F.max("score").alias("top"))
    known = truth(spark, sf_dir).select("query_id").distinct().withColumn("answerable", F.lit(True))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    joined = asked.join(top, "query_id", "left").join(known, "query_id", "left")
    return joined.groupBy(F.coalesce("answerable", F.lit(False)).alias("answerable")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("top", F.lit(0.0)) >= 100).alias("answered"))


@query("SELECT source, count(*) AS documents, count(*) FILTER (o_orderdate IS NULL) AS undated FROM documents LEFT JOIN orders ON o_orderkey = doc_id AND o_orderstatus = 'F' GROUP BY source")
def undated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(days, F.col("doc_id") == F.col("o_orderkey"), "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("o_orderdate").isNull()).alias("undated"))


DELIVERY = {"autopilot": ["therou"], "copilot": ["nthe", "license"]}
_DELIVERY_SQL = claims_sql(DELIVERY)


@query(f"WITH {_DELIVERY_SQL} SELECT source, CASE WHEN a = 0 AND c = 0 THEN NULL WHEN a > c THEN 'autopilot' ELSE 'copilot' END AS delivery FROM (SELECT s.source, count(*) FILTER (kind = 'autopilot') AS a, count(*) FILTER (kind = 'copilot') AS c FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN claims c ON s.source = c.source GROUP BY s.source)")
def delivery_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = rules.claims(documents, DELIVERY, "source")
    counted = documents.select("source").distinct().join(found, "source", "left").groupBy("source").agg(F.count_if(F.col("kind") == "autopilot").alias("a"), F.count_if(F.col("kind") == "copilot").alias("c"))
    return counted.select("source", rules.delivery(F.col("a"), F.col("c")).alias("delivery"))


_AGED_SQL = "'Founded about ' || (doc_id % 30) || ' years ago. ' || text || '. Started ' || (doc_id % 7) || ' years ago.'"
_YEARS_SQL = rf"list_max([x::INT for x in regexp_extract_all(lower({_AGED_SQL}), '(?:founded|created|started)[^.!?\n]{{0,40}}?(\d{{1,3}}) years ago', 1)])"


def aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose whole text says how old its source is."""
    old, new = (F.concat(F.lit(head), (F.col("doc_id") % n).cast("string"), F.lit(" years ago.")) for head, n in (("Founded about ", 30), ("Started ", 7)))
    return table(spark, sf_dir, "documents").withColumn("text", F.concat(old, F.lit(" "), F.col("text"), F.lit(". "), new))


@query(f"SELECT doc_id, {_YEARS_SQL} AS years FROM documents")
def relative_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aged(spark, sf_dir).select("doc_id", rules.relative_age(F.col("text")).alias("years"))


@query(f"""WITH y AS (SELECT source, doc_id, {_YEARS_SQL} AS years FROM documents) SELECT source, years, doc_id FROM y WHERE years IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY years DESC, doc_id) = 1""")
def declared_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest age that any document of a source declares, and the first that does."""
    return rules.declared_age(aged(spark, sf_dir), "source")


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 130 THEN text ELSE CASE WHEN regexp_extract(substr(text, 1, 129), '(?s)^(.*)\s', 1) <> '' THEN rtrim(regexp_extract(substr(text, 1, 129), '(?s)^(.*)\s', 1), ' ') ELSE substr(text, 1, 129) END || '…' END AS short FROM documents""")
def shortened_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.shorten(F.col("text"), 130).alias("short"))


@query("SELECT conv_id, turn - first AS place, '[' || (turn - first) || '] (' || role || ') ' || text AS block FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered blocks of a prompt, a row each; the few that a prompt takes are joined where it is made."""
    kept = tables.appended(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return kept.select("conv_id", "place", F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] ("), "role", F.lit(") "), "text").alias("block"))


@query("""WITH s AS (SELECT source, list_sort(list_distinct(list(lang))) AS a, list_sort(list_distinct(list(lang) FILTER (n_chars > 3000))) AS b FROM documents GROUP BY source)
SELECT source, array_to_string(list_sort(list_intersect(a, coalesce(b, []))), ',') AS both, array_to_string(list_sort([x for x in a if not list_contains(coalesce(b, []), x)]), ',') AS only_a FROM s""")
def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("a"), F.collect_set(F.when(F.col("n_chars") > 3000, F.col("lang"))).alias("b"))
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    return own.select("source", joined(F.array_intersect("a", "b")).alias("both"), joined(F.array_except("a", "b")).alias("only_a"))


@query(f"WITH {CLAIMS_SQL} SELECT source, string_agg(kind || ': ' || span, ' | ' ORDER BY kind, doc_id) AS question FROM claims WHERE place = 1 GROUP BY source")
def retrieval_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = claims(spark, sf_dir).where("place = 1")
    parts = F.array_sort(F.collect_list(F.struct("kind", "doc_id", "span")))
    return first.groupBy("source").agg(F.array_join(F.transform(parts, lambda x: F.concat(x["kind"], F.lit(": "), x["span"])), " | ").alias("question"))
