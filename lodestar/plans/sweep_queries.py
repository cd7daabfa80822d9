"""Sweeps and diagnostics over profiles, and tables that are changed bucket by bucket or made by runs that can be taken up."""

from __future__ import annotations

import uuid
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import contains_any
from lodestar.operators import evaluate, rules, sweeps
from lodestar.sources import buckets
from lodestar.sources.runs import Run
from lodestar.sources.shared import keep, shared_dir

from .registry import query, table
from .report_queries import _PRIORITY
from .rule_queries import _CLASS, _CONF_SQL, _DEEP_SQL, _LEVEL, _QUADRANT, _VETO, CLAIMS_SQL, EXCLUDED, LEXICONS, _eligibility_sql, _graded, facts

_PROFILES_SQL = f"""{_CONF_SQL}, {_DEEP_SQL}, low AS (SELECT source, ['baixa', 'media', 'alta'][min(list_position(['baixa', 'media', 'alta'], confidence))] AS confidence FROM graded GROUP BY source),
out AS (SELECT DISTINCT source FROM ({_eligibility_sql()})),
c AS (SELECT source, deep, {_CLASS} AS class, {_LEVEL} AS level, (autopilot OR data OR technical) AS verified FROM facts), q AS (SELECT *, {_QUADRANT} AS quadrant FROM c),
p AS (SELECT q.source, deep, class, quadrant, coalesce(confidence, 'baixa') AS confidence, verified, q.source NOT IN (SELECT source FROM out) AS eligible FROM q LEFT JOIN low USING (source)),
profiles AS (SELECT *, {_PRIORITY} AS priority FROM p)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity a row: ``class``, ``quadrant``, ``confidence``, ``verified``, ``eligible``, ``priority``, ``deep``."""
    f = facts(spark, sf_dir)
    low = _graded(spark, sf_dir).groupBy("source").agg(rules.lowest(rules.CONFIDENCE, F.col("confidence")).alias("confidence"))
    out = rules.exclusions(table(spark, sf_dir, "documents"), EXCLUDED, _VETO, "source").select("source", F.lit(False).alias("eligible")).distinct()
    verified = f.autopilot | f.data | f.technical
    c = f.select("source", "deep", rules.class_of(rules.class_points(f.autopilot, f.data, f.technical)).alias("class"), rules.maturity(f.deep).alias("level"), verified.alias("verified"))
    q = c.join(low, "source", "left").join(out, "source", "left")
    q = q.select("source", "deep", "class", "verified", rules.quadrant(F.col("class"), F.col("level"), F.col("verified")).alias("quadrant"), F.coalesce("confidence", F.lit("baixa")).alias("confidence"), F.coalesce("eligible", F.lit(True)).alias("eligible"))
    return q.withColumn("priority", rules.priority(q.quadrant, q.confidence, q.verified))


_STATES = """SELECT a.b AS autopilot, d.b AS data, t.b AS technical, k.n::BIGINT AS deep FROM (VALUES (true), (false)) a(b), (VALUES (true), (false)) d(b), (VALUES (true), (false)) t(b), (VALUES (0), (1), (3)) k(n)"""
_STEP = "CASE WHEN deep >= 3 THEN 3 WHEN deep >= 1 THEN 1 ELSE 0 END"


@query(f"""WITH {CLAIMS_SQL}, {_DEEP_SQL}, s AS ({_STATES}), n AS (SELECT autopilot, data, technical, {_STEP} AS deep, count(*) AS n FROM facts GROUP BY ALL),
c AS (SELECT s.*, coalesce(n, 0) AS n, {_CLASS.replace('autopilot', 's.autopilot').replace('data', 's.data').replace('technical', 's.technical')} AS class, {_LEVEL.replace('deep', 's.deep')} AS level, (s.autopilot OR s.data OR s.technical) AS verified
FROM s LEFT JOIN n ON s.autopilot = n.autopilot AND s.data = n.data AND s.technical = n.technical AND s.deep = n.deep), q AS (SELECT *, {_QUADRANT} AS quadrant FROM c)
SELECT class, level, quadrant, count(*) AS states, count(*) FILTER (n > 0) AS met, sum(n)::BIGINT AS entities FROM q GROUP BY ALL""")
def classifier_state_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All states that the classifier can be in, which of them entities are in, and how many entities."""
    flags = (True, False)
    states = spark.createDataFrame(list(product(flags, flags, flags, (0, 1, 3))), "autopilot boolean, data boolean, technical boolean, deep long")
    step = F.when(F.col("deep") >= rules.DEEP_MARKERS, 3).when(F.col("deep") >= 1, 1).otherwise(0).cast("long")
    own = ["autopilot", "data", "technical", "deep"]
    met = keep(facts(spark, sf_dir).withColumn("deep", step).groupBy(*own).agg(F.count(F.lit(1)).alias("n")), "states")  # 24 rows
    s = states.join(met, own, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    c = s.select("n", rules.class_of(rules.class_points(s.autopilot, s.data, s.technical)).alias("class"), rules.maturity(s.deep).alias("level"), (s.autopilot | s.data | s.technical).alias("verified"))
    q = c.withColumn("quadrant", rules.quadrant(F.col("class"), F.col("level"), F.col("verified")))
    return q.groupBy("class", "level", "quadrant").agg(F.count(F.lit(1)).alias("states"), F.count_if(F.col("n") > 0).alias("met"), F.sum("n").alias("entities"))


QUADRANTS = ["sweet-spot", "prospect-de-evolucao", "ja-otimizada", "fora-do-funil"]


@query(f"""WITH {_PROFILES_SQL}, s AS (SELECT q AS quadrant, c AS confidence, v AS verified FROM (VALUES {', '.join(f"('{q}')" for q in QUADRANTS)}) a(q), (VALUES ('baixa'), ('media'), ('alta')) b(c), (VALUES (true), (false)) d(v)),
n AS (SELECT quadrant, confidence, verified, count(*) AS n FROM profiles GROUP BY ALL) SELECT s.*, {_PRIORITY} AS priority, coalesce(n, 0) AS entities FROM s LEFT JOIN n USING (quadrant, confidence, verified)""")
def priority_demotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priority of every possible cell, and how many entities are in it."""
    cells = spark.createDataFrame(list(product(QUADRANTS, rules.CONFIDENCE, (True, False))), "quadrant string, confidence string, verified boolean")
    own = ["quadrant", "confidence", "verified"]
    met = keep(profiles(spark, sf_dir).groupBy(*own).agg(F.count(F.lit(1)).alias("n")), "cells")  # 24 rows
    return cells.join(met, own, "left").select(*own, rules.priority(F.col("quadrant"), F.col("confidence"), F.col("verified")).alias("priority"), F.coalesce("n", F.lit(0)).alias("entities"))


@query(f"""WITH {_PROFILES_SQL} SELECT class, quadrant, priority, array_to_string([x for x in [CASE WHEN grouping(class) = 0 THEN 'class' END, CASE WHEN grouping(quadrant) = 0 THEN 'quadrant' END, CASE WHEN grouping(priority) = 0 THEN 'priority' END] if x IS NOT NULL], ',') AS looked,
count(*) AS n FROM profiles GROUP BY GROUPING SETS ((class, quadrant, priority), (class), (quadrant), (priority), ())""")
def profile_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, quadrants and priorities alone, together, and by their combinations."""
    return sweeps.distributions(profiles(spark, sf_dir), ["class", "quadrant", "priority"])


_TERM_ROWS = "(VALUES " + ", ".join(f"('{kind}', '{t}')" for kind, terms in LEXICONS.items() for t in terms) + ") l(kind, term)"


@query(f"""WITH {_CONF_SQL}, gold AS (SELECT source, kind FROM documents JOIN {_TERM_ROWS} ON contains(lower(text), term) GROUP BY source, kind HAVING count(DISTINCT doc_id) >= 2),
said AS (SELECT 'emitted' AS arm, source, kind FROM graded UNION ALL SELECT 'validated', source, kind FROM graded WHERE confidence <> 'baixa' UNION ALL SELECT DISTINCT 'constant', source, 'data' FROM documents),
e AS (SELECT arm, source, (SELECT list_sort(list(DISTINCT kind)) FROM said WHERE said.arm = a.arm AND said.source = d.source) AS emitted, (SELECT list(DISTINCT kind) FROM gold WHERE gold.source = d.source) AS expected FROM (VALUES ('emitted'), ('validated'), ('constant')) a(arm), (SELECT DISTINCT source FROM documents) d),
f AS (SELECT arm, coalesce(emitted, []::VARCHAR[]) AS emitted, coalesce(expected, []::VARCHAR[]) AS expected, len(list_intersect(coalesce(emitted, []::VARCHAR[]), coalesce(expected, []::VARCHAR[]))) AS hit FROM e)
SELECT arm, round(avg(CASE WHEN len(emitted) > 0 THEN hit / len(emitted) WHEN len(expected) = 0 THEN 1.0 END), 6) AS precision, round(avg(CASE WHEN len(expected) > 0 THEN hit / len(expected) END), 6) AS recall,
count(DISTINCT emitted) AS distinct_sets, count(*) AS entities FROM f GROUP BY arm""")
def emitted_against_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and discrimination of the kinds of claims that are emitted, of those that are corroborated, and of a
    constant answer; expected is what two documents of an entity or more speak of."""
    documents, graded = table(spark, sf_dir, "documents"), keep(_graded(spark, sf_dir).select("source", "kind", "confidence"), "graded")
    spoken = F.array_compact(F.array(*(F.when(contains_any(F.lower("text"), terms), F.lit(kind)) for kind, terms in LEXICONS.items())))
    counted = documents.select("source", F.explode(spoken).alias("kind")).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))
    gold = counted.where("n >= 2").groupBy("source").agg(F.collect_set("kind").alias("expected"))
    names = keep(documents.select("source").distinct().join(gold, "source", "left"), "gold")
    listed = lambda rows: rows.groupBy("source").agg(F.collect_set("kind").alias("emitted"))
    arms = {"emitted": listed(graded), "validated": listed(graded.where("confidence != 'baixa'")), "constant": names.select("source", F.array(F.lit("data")).alias("emitted"))}
    none = F.array().cast("array<string>")
    out = None
    for arm, said in arms.items():
        sets = names.join(said, "source", "left").select(F.coalesce("emitted", none).alias("emitted"), F.coalesce("expected", none).alias("expected"), none.alias("ambiguous"))
        own = evaluate.precision_recall(sets, "emitted", "expected", "ambiguous").withColumn("arm", F.lit(arm))
        out = own if out is None else out.unionByName(own)
    return out


DESIGNS = {"none": (False, False), "both": (True, True), "verification": (True, False), "eligibility": (False, True)}
_DESIGNS_SQL = "(VALUES " + ", ".join(f"('{n}', {v}, {e})" for n, (v, e) in DESIGNS.items()) + ") d(design, by_sign, by_eligibility)"


@query(f"""WITH {_PROFILES_SQL}, s AS (SELECT design, eligible, by_eligibility, quadrant, confidence, (verified OR NOT by_sign) AS verified FROM profiles, {_DESIGNS_SQL}), r AS (SELECT design, CASE WHEN by_eligibility AND NOT eligible THEN 'baixa' ELSE {_PRIORITY} END AS priority FROM s)
SELECT design, priority, count(*) AS n FROM r GROUP BY ALL""")
def priority_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities with both demotions, either and none."""
    return sweeps.priority_designs(profiles(spark, sf_dir), DESIGNS)


_STEPPED = "CASE WHEN NOT verified THEN 'non-AI' WHEN deep >= 3 THEN 'AI-native' ELSE 'AI-enabled' END"


@query(f"""WITH {_PROFILES_SQL}, g AS (SELECT *, class = {_STEPPED} AS ok FROM profiles)
SELECT 'keep label' AS design, count(*) FILTER (ok) AS "right", count(*) AS total FROM g UNION ALL SELECT 'own label', count(*) FILTER (ok AND verified), count(*) FROM g""")
def design_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes against those of the stepped rubric, with the label of entities without a sign kept, or replaced by one of its own."""
    rows = profiles(spark, sf_dir)
    gold = F.when(~F.col("verified"), "non-AI").when(F.col("deep") >= rules.DEEP_MARKERS, "AI-native").otherwise("AI-enabled")
    return sweeps.design_costs(rows, F.col("class") == gold, ~F.col("verified"))


@query(f"""WITH {_PROFILES_SQL}, n AS (SELECT deep, count(*) AS n, count(*) FILTER (class = 'AI-native') AS g FROM profiles GROUP BY deep),
s AS (SELECT deep AS threshold, sum(n) OVER (ORDER BY deep DESC) AS reached, sum(g) OVER (ORDER BY deep DESC) AS hits, sum(g) OVER () AS gold FROM n)
SELECT threshold::BIGINT AS threshold, reached::BIGINT AS reached, hits::BIGINT AS hits, round(hits / reached, 6) AS precision, round(hits / nullif(gold, 0), 6) AS recall FROM s""")
def depth_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of deep markers as the threshold of the top class, against the class by points."""
    return sweeps.thresholds(profiles(spark, sf_dir), "deep", F.col("class") == "AI-native")


@query(f"""WITH e AS ({_eligibility_sql()}) SELECT s.source, count(label) = 0 AS eligible, coalesce(string_agg(label, ',' ORDER BY label), '') AS reasons FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN e USING (source) GROUP BY s.source""")
def eligibility_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities with their verdict and what excludes them."""
    documents = table(spark, sf_dir, "documents")
    out = rules.exclusions(documents, EXCLUDED, _VETO, "source").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("reasons"))
    return documents.select("source").distinct().join(out, "source", "left").select("source", F.col("reasons").isNull().alias("eligible"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def _veto_sql() -> str:
    marked = " OR ".join(f"contains(s, '{m}')" for m in _VETO)
    parts = "regexp_split_to_array(lower(text), '[.!?;\\n]+')"
    each = [f"SELECT doc_id, '{label}' AS label, '{t}' AS term, [s for s in {parts} if contains(s, '{t}')] AS h FROM documents" for label, terms in EXCLUDED.items() for t in terms]
    return f"WITH t AS ({' UNION ALL '.join(each)}) SELECT doc_id, label, term, len(h)::BIGINT AS sentences, len([s for s in h if {marked}])::BIGINT AS marked, len([s for s in h if {marked}]) = len(h) AS vetoed FROM t WHERE len(h) > 0"


@query(_veto_sql())
def veto_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence by sentence: which documents' terms are vetoed, and which keep an occurrence without a marker."""
    return sweeps.veto_diagnosis(table(spark, sf_dir, "documents"), "doc_id", EXCLUDED, _VETO)


@query("""SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderpriority = '1-URGENT' THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders
UNION ALL SELECT o_custkey, -o_orderkey, o_totalprice, 'N' FROM orders WHERE o_orderpriority = '1-URGENT'""")
def bucketed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in buckets of their customer: urgent ones come again and bring a second one each, and closed ones are priced
    anew; either change is a version, of the buckets that it touches."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    own = ["o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"]
    path = f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}"
    buckets.create(orders.select(own), path, ["o_custkey"], buckets=32)
    urgent = orders.where("o_orderpriority = '1-URGENT'").withColumn("o_orderstatus", F.lit("N"))
    new = urgent.select(own).union(urgent.withColumn("o_orderkey", -F.col("o_orderkey")).select(own))
    buckets.upsert(spark, path, new, ["o_custkey", "o_orderkey"])
    closed = orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.lit(0.0).alias("o_totalprice"))
    buckets.set_columns(spark, path, closed, ["o_custkey", "o_orderkey"], ["o_totalprice"])
    return buckets.read(spark, path)


@query(f"WITH {CLAIMS_SQL} SELECT kind, count(DISTINCT source) AS entities, count(*) AS claims FROM claims GROUP BY kind")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that breaks behind its first stage and is taken up: the claims are read, and only their counts are made."""
    from .rule_queries import claims

    def run(last) -> DataFrame:
        own = Run(spark, f"{shared_dir(spark)}/runs", f"claims-{spark.sparkContext.applicationId}"[:64], [f"{sf_dir}/documents.parquet"])
        found = own.stage("claims", lambda: claims(spark, sf_dir))
        return own.stage("counts", lambda: last(found))

    def broken(found: DataFrame) -> DataFrame:
        raise InterruptedError

    try:
        run(broken)
    except InterruptedError:
        pass
    return run(lambda found: found.groupBy("kind").agg(F.count_distinct("source").alias("entities"), F.count(F.lit(1)).alias("claims")))
