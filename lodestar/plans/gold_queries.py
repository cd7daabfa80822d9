"""Queries that hold answers against gold labels, and what a profile and a run are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import contains_any
from lodestar.operators import evaluate, rules, tables
from lodestar.sources.shared import fingerprint, shared_dir

from .registry import query, table
from .rule_queries import (
    _CLASS,
    _CONF_SQL,
    _DEEP_SQL,
    _NEEDS_SQL,
    _VETO,
    BEST_SQL,
    CLAIMS_SQL,
    EXCLUDED,
    LEXICONS,
    MARKERS,
    _cited,
    _eligibility_sql,
    _graded,
    claims,
    claims_sql,
    facts,
)

_list = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
PAINS = {"latency": ["nthe"], "cost": ["therou", "token"], "privacy": ["license", "password"]}


@query(f"WITH {claims_sql(PAINS, '2')} SELECT source, kind AS pain, doc_id, span, place FROM claims")
def pains_two_evidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs by their lexicons, two evidences each at most."""
    return rules.claims(table(spark, sf_dir, "documents"), PAINS, "source", most=2).withColumnRenamed("kind", "pain")


_VALUE_SQL = "SELECT source, 'value' AS kind, min(doc_id) AS doc_id, substr(arg_min(text, doc_id), 1, 400) AS span FROM documents GROUP BY source"


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select("source").distinct()
    return names.withColumn("description", F.when(F.col("source") != "src3", F.concat(F.lit("about "), "source")))


@query(f"SELECT source, kind, 'about ' || source AS text, doc_id, span FROM ({_VALUE_SQL}) WHERE source <> 'src3'")
def value_proposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The description with the beginning of the first document as its evidence."""
    return rules.value_proposition(described(spark, sf_dir), table(spark, sf_dir, "documents"), "source")


_KINDS_SQL = f"list_position({_list(rules.CLAIM_ORDER)}, kind)"


@query(f"""WITH {CLAIMS_SQL}, {claims_sql(PAINS, '2', 'pains')}, v AS ({_VALUE_SQL}), a AS (SELECT source, kind, doc_id FROM claims WHERE kind <> 'autopilot' UNION ALL SELECT source, 'pain', doc_id FROM pains
UNION ALL SELECT source, kind, doc_id FROM v WHERE source <> 'src3') SELECT source, kind, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_KINDS_SQL}, doc_id) AS place FROM a""")
def claims_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims of a profile in the order of their kinds."""
    pains = rules.claims(table(spark, sf_dir, "documents"), PAINS, "source", most=2).select("source", F.lit("pain").alias("kind"), "doc_id")
    value = value_proposition(spark, sf_dir).select("source", "kind", "doc_id")
    own = claims(spark, sf_dir).where("kind != 'autopilot'").select("source", "kind", "doc_id")
    return rules.flattened(own.union(pains).union(value), "source").select("source", "kind", "doc_id", "place")


_UNVERIFIED_SQL = """list_filter([CASE WHEN age = 'unverified' THEN 'year of foundation' WHEN age = 'pending' THEN 'exact date of foundation' END, CASE WHEN coalesce(site, '') = '' THEN 'site' END,
CASE WHEN NOT technical THEN 'developer' END, 'incorporation'], lambda x: x IS NOT NULL)"""


@query(f"""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1985 + c_custkey % 20 END AS y, c_custkey % 17 AS declared, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END AS site, c_acctbal > 0 AS technical FROM customer),
a AS (SELECT c_custkey, trim(site) AS site, technical, CASE WHEN y IS NULL THEN CASE WHEN declared > 10 THEN 'excluded' ELSE 'unverified' END WHEN 2004 - y > 10 THEN 'excluded' WHEN 2004 - y = 10 THEN 'pending' ELSE 'eligible' END AS age FROM c)
SELECT c_custkey, age, array_to_string({_UNVERIFIED_SQL}, '; ') AS unverified FROM a""")
def unverified_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements that the data can't show are listed and never exclude."""
    key = F.col("c_custkey")
    age = rules.age_outcome(F.when(key % 5 != 0, 1985 + key % 20), F.lit(2004), key % 17)
    rows = table(spark, sf_dir, "customer").select(key, age.alias("age"), F.when(key % 3 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("site"), (F.col("c_acctbal") > 0).alias("technical"))
    return rows.select("c_custkey", "age", F.array_join(rules.unverified(F.col("age"), F.col("site"), F.col("technical")), "; ").alias("unverified"))


_RECENT_SQL = "(1998 - year(o_orderdate)) * 12 + 8 - month(o_orderdate) < 24"
_ARMS_SQL = f"""{_CONF_SQL}, d2 AS (SELECT c.source, count(*) AS evidences, count(DISTINCT lang) AS kinds, count(*) FILTER ({_RECENT_SQL}) AS recent, count(*) FILTER (place = 1) AS n1,
count(DISTINCT lang) FILTER (place = 1) AS k1, count(*) FILTER (place = 1 AND {_RECENT_SQL}) AS r1 FROM claims c JOIN documents d USING (doc_id) LEFT JOIN orders o ON o_orderkey = c.doc_id WHERE kind <> 'technical' GROUP BY c.source)"""
_LEVEL_SQL = "CASE WHEN {0} = 0 THEN 'baixa' WHEN {1} >= 2 AND {2} >= 1 THEN 'alta' WHEN {1} >= 2 OR {2} >= 1 THEN 'media' ELSE 'baixa' END"


@query(f"""WITH {_ARMS_SQL}, low AS (SELECT source, ['baixa', 'media', 'alta'][min(list_position(['baixa', 'media', 'alta'], confidence))] AS a FROM graded GROUP BY source)
SELECT s.source, coalesce(a, 'baixa') AS a, {_LEVEL_SQL.format('coalesce(n1, 0)', 'coalesce(k1, 0)', 'coalesce(r1, 0)')} AS b, {_LEVEL_SQL.format('coalesce(evidences, 0)', 'coalesce(kinds, 0)', 'coalesce(recent, 0)')} AS c,
{_LEVEL_SQL.format('coalesce(evidences, 0)', 'coalesce(kinds, 0)', 'coalesce(evidences, 0)')} AS d FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN low ON low.source = s.source LEFT JOIN d2 ON d2.source = s.source""")
def confidence_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of a diagnosis in four ways: the least of all claims (a), of its own first evidence (b), of all its own
    evidence (c), and the same as if every document were recent (d)."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    days = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("day"))
    own = claims(spark, sf_dir).where("kind != 'technical'").join(documents, "doc_id").join(days, "doc_id", "left")
    recent, first = rules.recent(F.col("day"), F.lit("1998-08-01").cast("date")), F.col("place") == 1
    sums = own.groupBy("source").agg(
        F.count_if(first).alias("n1"), F.count_distinct(F.when(first, F.col("lang"))).alias("k1"), F.count_if(first & recent).alias("r1"),
        F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("k"), F.count_if(recent).alias("r"),
    )
    levels = _graded(spark, sf_dir).groupBy("source").agg(F.collect_list("confidence").alias("levels"))  # three kinds of claims
    names = table(spark, sf_dir, "documents").select("source").distinct()
    joined = names.join(sums, "source", "left").join(levels, "source", "left").na.fill(0, ["n1", "k1", "r1", "n", "k", "r"])
    level = lambda n, k, r: rules.diagnosis_confidence(F.col("levels"), rules.confidence(F.col(k), F.col(r), F.col(n)), own_evidence=True)
    return joined.select("source", rules.diagnosis_confidence(F.coalesce("levels", F.array().cast("array<string>")), F.lit(None)).alias("a"), level("n1", "k1", "r1").alias("b"), level("n", "k", "r").alias("c"), level("n", "k", "n").alias("d"))


@query(f"""WITH {BEST_SQL}, w AS (SELECT text, span FROM best WHERE contains(text, 'license') OR contains(text, 'token'))
SELECT count(*) AS n, count(*) FILTER (contains(substr(text, 1, 150), 'license') OR contains(substr(text, 1, 150), 'token')) AS head, count(*) FILTER (contains(span, 'license') OR contains(span, 'token')) AS chosen FROM w""")
def span_selector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span selector beside its baseline, the first 150 characters."""
    documents = table(spark, sf_dir, "documents")
    best = rules.best_spans(documents, "doc_id", **MARKERS).select("doc_id", "span").join(documents.select("doc_id", "text"), "doc_id")
    return evaluate.anchors_hit(best, "span", ["license", "token"])


_SETS_SQL = """SELECT source, list_sort(list_distinct(list(lang) FILTER (n_chars > 3000))) AS expected, list_sort(list_distinct(list(lang) FILTER (n_chars < 200))) AS forbidden, list_sort(list_distinct(list(lang) FILTER (n_chars BETWEEN 1000 AND 1200))) AS ambiguous FROM documents GROUP BY source"""
_VOCABULARY = ["en", "fr", "de", "es", "pt"]


def _label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, lang = F.col("n_chars"), F.col("lang")
    some = {"expected": n > 3000, "forbidden": n < 200, "ambiguous": n.between(1000, 1200)}
    return table(spark, sf_dir, "documents").groupBy("source").agg(*(F.collect_set(F.when(c, lang)).alias(k) for k, c in some.items()))


def _problems_sql() -> str:
    parts, out = ("expected", "forbidden", "ambiguous"), []
    for p in parts:
        out.append(f"SELECT source, 'unknown in {p}' AS reason, [x for x in {p} if not list_contains({_list(_VOCABULARY)}, x)] AS l FROM s")
    for i, a in enumerate(parts):
        out += [f"SELECT source, 'in {a} and {b}', [x for x in {a} if list_contains({b}, x)] FROM s" for b in parts[i + 1 :]]
    out.append(f"SELECT source, 'in none', list_sort([x for x in {_list(_VOCABULARY)} if not list_contains(list_concat(list_concat(expected, forbidden), ambiguous), x)]) FROM s")
    safe = ", ".join(f"coalesce({p}, []) AS {p}" for p in parts)
    return f"WITH t AS ({_SETS_SQL}), s AS (SELECT source, {safe} FROM t), x AS ({' UNION ALL '.join(out)}) SELECT source, reason, array_to_string(l, ',') AS labels FROM x WHERE len(l) > 0"


@query(_problems_sql())
def label_partition_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lists of labels that should be disjoint and cover the vocabulary, and where they aren't."""
    found = evaluate.partition_problems(_label_sets(spark, sf_dir), "source", ["expected", "forbidden", "ambiguous"], _VOCABULARY)
    return found.withColumn("labels", F.array_join("labels", ","))


@query(f"""WITH {claims_sql(PAINS, '2', 'pains')}, c AS (SELECT source, list_distinct(list(kind)) AS candidates FROM pains GROUP BY source), s AS (SELECT DISTINCT source FROM documents),
j AS (SELECT s.source, len([x for x in ['latency', 'privacy'] if list_contains(coalesce(candidates, []), x)]) AS r FROM s LEFT JOIN c USING (source))
SELECT sum(r)::BIGINT AS reachable, (2 * count(*))::BIGINT AS total, count(*) FILTER (r < 2) AS short FROM j""")
def candidate_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall that no judge of the candidates can exceed."""
    documents = table(spark, sf_dir, "documents")
    made = rules.claims(documents, PAINS, "source", most=2).groupBy("source").agg(F.collect_set("kind").alias("candidates"))
    sets = documents.select("source").distinct().join(made, "source", "left").select(F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"), F.array(F.lit("latency"), F.lit("privacy")).alias("expected"))
    return evaluate.ceiling(sets, "candidates", "expected")


@query(f"""WITH {CLAIMS_SQL}, {_DEEP_SQL}, w AS (SELECT source, {_CLASS} AS class, deep FROM facts) SELECT count(*) FILTER (deep >= 3) AS reachable, count(*) AS total FROM w WHERE class = 'AI-native'""")
def rubric_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the entities that should be of the top class have the depth that its step asks for."""
    f = facts(spark, sf_dir)
    native = f.where(rules.class_of(rules.class_points(f.autopilot, f.data, f.technical)) == "AI-native")
    return native.agg(F.count_if(F.col("deep") >= rules.DEEP_MARKERS).alias("reachable"), F.count(F.lit(1)).alias("total"))


_TERMS_SQL = ", ".join(f"('{label}', '{t}')" for label, terms in EXCLUDED.items() for t in terms)


@query(f"""WITH {CLAIMS_SQL}, now AS (SELECT DISTINCT source, label FROM claims, (VALUES {_TERMS_SQL}) v(label, term) WHERE contains(lower(span), term)), wide AS (SELECT DISTINCT source, label FROM ({_eligibility_sql()}))
SELECT source, label, 'new' AS side FROM (SELECT * FROM wide EXCEPT SELECT * FROM now) UNION ALL SELECT source, label, 'gone' FROM (SELECT * FROM now EXCEPT SELECT * FROM wide)""")
def excluded_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusions that a scan of whole texts finds, vetoes and all, and the evidence alone does not, and the other way round."""
    held = F.explode(F.array_compact(F.array(*(F.when(contains_any(F.lower("span"), terms), F.lit(label)) for label, terms in EXCLUDED.items()))))
    now = claims(spark, sf_dir).select("source", held.alias("label")).distinct()
    wide = rules.exclusions(table(spark, sf_dir, "documents"), EXCLUDED, _VETO, "source").select("source", "label").distinct()
    side = lambda a, b, name: a.join(b, ["source", "label"], "left_anti").withColumn("side", F.lit(name))
    return side(wide, now, "new").union(side(now, wide, "gone"))


@query("SELECT (n_chars > 2000) AS verified, count(*) AS n, count(*) FILTER (quality = 1) AS \"right\", round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS share FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def accuracy_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).alias("verified")), "doc_id")
    return evaluate.accuracy_by(pairs, "verified", F.col("quality") == 1)


@query("SELECT vec_id, label, round(CASE WHEN label = 1 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) AS first, (label = 1) AS renewed FROM embeddings")
def re_embed_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New vectors of one label take the place of the old ones; all else stays."""
    old = table(spark, sf_dir, "embeddings")
    new = old.where("label = 1").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    out = tables.re_embedded(old, new, "vec_id", ["embedding"])
    return out.select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), (F.col("label") == 1).alias("renewed"))


@query(f"""WITH {_NEEDS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) AS place FROM f), r AS (SELECT * FROM p WHERE place <= 3 AND len(evidence) > 0)
SELECT source, position, place, 'none' AS provider, (SELECT count(DISTINCT source) FROM r) AS entities FROM r""")
def run_with_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run as it is kept: every recommendation with the provider that ranked it."""
    made = rules.recommend(_cited(spark, sf_dir), "source").select("source", "position", "place")
    return tables.stamped(made, "none", "source")


@query(f"""WITH {_NEEDS_SQL}, k AS (SELECT * FROM f WHERE source NOT IN ('src2', 'src5')), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) AS place FROM k), r AS (SELECT source, count(*) AS n FROM p WHERE place <= 3 AND len(evidence) > 0 GROUP BY source)
SELECT s.source, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN NULL WHEN s.source IN (SELECT source FROM k) THEN 'no evidence for the first citations' ELSE 'nothing cited' END AS reason FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN r USING (source)""")
def recommendation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity with its number of recommendations; two sources play a role and are no technology."""
    cited = _cited(spark, sf_dir)
    made = rules.recommend(cited, "source", without=["src2", "src5"], role="source")
    names = table(spark, sf_dir, "documents").select("source").distinct()
    return rules.recommended(names, made, cited.where(~F.col("source").isin("src2", "src5")), "source")


@query("""SELECT doc_id, CASE WHEN lang <> 'es' THEN n_chars END AS size, CASE WHEN length(text) >= 200 THEN upper(lang) END AS code,
array_to_string(list_filter([CASE WHEN lang = 'es' THEN 'size' END, CASE WHEN length(text) < 200 THEN 'code' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents""")
def step_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed step leaves its name and a null; the steps beside it keep their values."""
    steps = {"size": (F.col("lang") != "es", F.col("n_chars")), "code": (F.length("text") >= 200, F.upper("lang"))}
    return rules.guarded(table(spark, sf_dir, "documents"), steps).select("doc_id", "size", "code", F.array_join("errors", ",").alias("errors"))


@query("SELECT doc_id, source, lang FROM documents WHERE lang = 'de'")
def one_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of one strategy, of a table that is kept by strategy: only its folder is read."""
    state = fingerprint(spark, f"{sf_dir}/documents.parquet")
    path = f"{shared_dir(spark)}/by-strategy-{spark.sparkContext.applicationId}-{state}"
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("strategy"))
    rows.write.mode("ignore").partitionBy("strategy").parquet(path)  # of one state of the table there is one path, written once
    return spark.read.schema("doc_id long, source string, strategy string").parquet(path).where("strategy = 'de'").select("doc_id", "source", F.col("strategy").alias("lang"))


@query(f"""WITH {claims_sql(LEXICONS, name="own")} SELECT 'constant' AS arm, count(*) AS entities, count(*) FILTER (toxic) AS agree FROM (SELECT source, bool_or(contains(lower(text), 'license')) AS toxic FROM documents GROUP BY source)
UNION ALL SELECT 'rules', count(*), count(*) FILTER (toxic = found) FROM (SELECT source, bool_or(contains(lower(text), 'license')) AS toxic FROM documents GROUP BY source) JOIN (SELECT s.source, count(o.source) > 0 AS found FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT * FROM own WHERE kind = 'data') o ON o.source = s.source GROUP BY s.source) USING (source)""")
def rules_vs_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant answer beside the rules': entities on whose data signal each agrees with the whole texts."""
    documents = table(spark, sf_dir, "documents")
    gold = documents.groupBy("source").agg(F.max(F.lower("text").contains("license")).alias("gold"))
    found = claims(spark, sf_dir).where("kind = 'data'").select("source", F.lit(True).alias("found")).distinct()
    both = gold.join(found, "source", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    arm = lambda name, right: both.agg(F.count(F.lit(1)).alias("entities"), F.count_if(right).alias("agree")).select(F.lit(name).alias("arm"), "entities", "agree")
    return arm("constant", F.col("gold")).union(arm("rules", F.col("gold") == F.col("found")))
