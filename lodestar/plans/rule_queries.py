"""Queries over rules, measures and kept tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import evaluate, rules, tables
from lodestar.sources.shared import keep

from .registry import query, table
from .text_queries import SENTENCES_SQL, TOKENS_SQL

_list = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
LEXICONS = {"autopilot": ["therou"], "data": ["license", "password"], "technical": ["token", "nthe"]}
DEEP = ["thtion", "attion", "ertion", "eriner", "apache"]
_any = lambda x, terms: "(" + " OR ".join(f"contains(lower({x}), '{t}')" for t in terms) + ")"


def claims_sql(lexicons: dict[str, list[str]], most: str = "3", name: str = "claims") -> str:
    sentence = "substr(list_filter({0}, lambda s: length(s) > 40 AND {1})[1], 1, 400)"
    each = (f"SELECT source, '{k}' AS kind, doc_id, {sentence.format(SENTENCES_SQL, _any('s', t))} AS span FROM documents" for k, t in lexicons.items())
    return f"{name}_all AS ({' UNION ALL '.join(each)}), {name} AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY doc_id) AS place FROM {name}_all WHERE span IS NOT NULL QUALIFY place <= {most})"


CLAIMS_SQL = claims_sql(LEXICONS)
_DEEP_SQL = f"""deep AS (SELECT source, len(list_filter({_list(DEEP)}, lambda m: contains(string_agg(lower(span), ' ' ORDER BY doc_id), m))) AS deep FROM claims WHERE kind = 'technical' GROUP BY source),
facts AS (SELECT s.source, count(*) FILTER (kind = 'autopilot') > 0 AS autopilot, count(*) FILTER (kind = 'data') > 0 AS data, count(*) FILTER (kind = 'technical') > 0 AS technical, coalesce(any_value(deep), 0)::BIGINT AS deep
FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN claims c ON s.source = c.source LEFT JOIN deep d ON s.source = d.source GROUP BY s.source)"""
_POINTS = "2 * autopilot::INT + 2 * data::INT + technical::INT"
_CLASS = f"CASE WHEN {_POINTS} >= 4 THEN 'AI-native' WHEN {_POINTS} >= 1 THEN 'AI-enabled' ELSE 'non-AI' END"
_LEVEL = "CASE WHEN deep >= 3 THEN 'alta' WHEN deep >= 1 THEN 'media' ELSE 'baixa' END"
_QUADRANT = "CASE WHEN class = 'non-AI' AND NOT verified THEN 'prospect-de-evolucao' WHEN class = 'non-AI' THEN 'fora-do-funil' WHEN class <> 'AI-native' THEN 'prospect-de-evolucao' WHEN level = 'alta' THEN 'ja-otimizada' ELSE 'sweet-spot' END"
_PRIORITY = "CASE WHEN NOT verified THEN 'baixa' WHEN quadrant = 'sweet-spot' THEN CASE WHEN confidence = 'baixa' THEN 'media' ELSE 'alta' END WHEN quadrant = 'prospect-de-evolucao' THEN 'media' ELSE 'baixa' END"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.claims(table(spark, sf_dir, "documents"), LEXICONS, "source")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = claims(spark, sf_dir)
    has = lambda k: F.count_if(F.col("kind") == k) > 0
    technical = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "technical", F.struct("doc_id", F.lower("span").alias("s"))))), lambda x: x["s"]))
    own = found.groupBy("source").agg(has("autopilot").alias("autopilot"), has("data").alias("data"), has("technical").alias("technical"), F.size(T.present(technical, DEEP)).cast("long").alias("deep"))
    names = table(spark, sf_dir, "documents").select("source").distinct()
    return names.join(own, "source", "left").na.fill({"autopilot": False, "data": False, "technical": False, "deep": 0})


@query(f"WITH {CLAIMS_SQL} SELECT source, kind, doc_id, span, place FROM claims")
def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir)


@query(f"WITH {CLAIMS_SQL} SELECT c.source, c.kind, count(*) AS spans, count(*) FILTER (contains(d.text, c.span)) AS verbatim FROM claims c JOIN documents d USING (doc_id) GROUP BY 1, 2")
def evidence_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = claims(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return joined.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.contains("text", "span")).alias("verbatim"))


@query(f"""WITH {CLAIMS_SQL}, {_DEEP_SQL}, c AS (SELECT source, ({_POINTS})::BIGINT AS points, {_CLASS} AS class, {_LEVEL} AS level, (autopilot OR data OR technical) AS verified FROM facts)
SELECT *, {_QUADRANT} AS quadrant FROM c""")
def class_maturity_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = [F.col(c) for c in ("autopilot", "data", "technical")]
    points = rules.class_points(*signals)
    placed = facts(spark, sf_dir).select("source", points.alias("points"), rules.class_of(points).alias("class"), rules.maturity(F.col("deep")).alias("level"), (signals[0] | signals[1] | signals[2]).alias("verified"))
    return placed.withColumn("quadrant", rules.quadrant(F.col("class"), F.col("level"), F.col("verified")))


@query(f"""WITH {CLAIMS_SQL}, {_DEEP_SQL} SELECT source, deep, CASE WHEN NOT (autopilot OR data OR technical) THEN 'non-AI' WHEN deep >= 3 OR (autopilot AND data) THEN 'AI-native' ELSE 'AI-enabled' END AS class FROM facts""")
def stepped_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return f.select("source", "deep", rules.class_stepped(f.autopilot | f.data | f.technical, f.deep, f.autopilot, f.data).alias("class"))


_CONF_SQL = f"""{CLAIMS_SQL}, dated AS (SELECT c.source, c.kind, d.lang, o.o_orderdate AS day FROM claims c JOIN documents d USING (doc_id) LEFT JOIN orders o ON o.o_orderkey = c.doc_id),
conf AS (SELECT source, kind, count(*) AS evidences, count(DISTINCT lang) AS kinds, count(*) FILTER ((1998 - year(day)) * 12 + 8 - month(day) < 24) AS recent FROM dated GROUP BY 1, 2),
graded AS (SELECT *, CASE WHEN kinds >= 2 AND recent >= 1 THEN 'alta' WHEN kinds >= 2 OR recent >= 1 THEN 'media' ELSE 'baixa' END AS confidence FROM conf)"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    days = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("day"))
    dated = claims(spark, sf_dir).join(documents, "doc_id").join(days, "doc_id", "left")
    recent = rules.recent(F.col("day"), F.lit("1998-08-01").cast("date"))
    own = dated.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("evidences"), F.count_distinct("lang").alias("kinds"), F.count_if(recent).alias("recent"))
    return own.withColumn("confidence", rules.confidence(own.kinds, own.recent, own.evidences))


@query(f"WITH {_CONF_SQL} SELECT source, kind, evidences, kinds, recent, confidence FROM graded")
def confidence_by_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir)


@query(f"""WITH {_CONF_SQL} SELECT s.source, ['baixa', 'media', 'alta'][coalesce(min(list_position(['baixa', 'media', 'alta'], confidence)), 1)] AS confidence, count(confidence) AS claims
FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN graded g ON s.source = g.source GROUP BY s.source""")
def min_ordinal_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select("source").distinct()
    return names.join(_graded(spark, sf_dir), "source", "left").groupBy("source").agg(rules.lowest(rules.CONFIDENCE, F.col("confidence")).alias("confidence"), F.count("confidence").alias("claims"))


EXCLUDED = {"license": ["gnu", "apache", "license"], "secret": ["password", "token"]}
_VETO = ["version 3", "cc by"]


def _eligibility_sql() -> str:
    parts = []
    for label, terms in EXCLUDED.items():
        for j, t in enumerate(terms):
            held = f"[s for s in regexp_split_to_array(lower(text), '[.!?;\\n]+') if contains(s, '{t}')]"
            veto = " OR ".join(f"contains(s2, '{m}')" for m in _VETO)
            parts.append(f"SELECT source, doc_id, '{label}' AS label, {j} AS term_at, '{t}' AS term FROM documents WHERE regexp_matches(lower(text), '\\b{t}') AND NOT (len({held}) > 0 AND len([s2 for s2 in {held} if {veto}]) = len({held}))")
    return "WITH h AS (" + " UNION ALL ".join(parts) + ") SELECT source, label, term, doc_id FROM h QUALIFY row_number() OVER (PARTITION BY source, label ORDER BY term_at, doc_id) = 1"


@query(_eligibility_sql())
def eligibility_term_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.exclusions(table(spark, sf_dir, "documents"), EXCLUDED, _VETO, "source")


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN y IS NULL THEN CASE WHEN declared > 10 THEN 'excluded' ELSE 'unverified' END WHEN 2004 - y > 10 THEN 'excluded' WHEN 2004 - y = 10 THEN 'pending' ELSE 'eligible' END AS outcome
FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE year(o_orderdate) END AS y, o_orderkey % 23 AS declared FROM orders)) GROUP BY outcome""")
def eligibility_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.year("o_orderdate"))
    outcome = rules.age_outcome(year, F.lit(2004), F.col("o_orderkey") % 23)
    return table(spark, sf_dir, "orders").select(outcome.alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# a line begins within 320 characters of the block's first one, so no block holds over 161 lines
_LINES_SQL = r"[x for x in [trim(y, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) for y in string_split(text, chr(10))] if x <> '']"
_SPANS_SQL = f"""l AS (SELECT doc_id, text, {_LINES_SQL} AS lines FROM documents),
n AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l), b AS (SELECT doc_id, i, unnest(range(i, least(len(lines), i + 160) + 1)) AS j, lines[i:i + 160] AS near FROM n),
s AS (SELECT doc_id, i, j, array_to_string(near[1:j - i + 1], chr(10)) AS span FROM b WHERE list_sum([length(x) + 1 for x in near[1:j - i + 1]]) - 1 BETWEEN 80 AND 320)"""
MARKERS = {"technical": ["license", "version", "token", "thtion"], "showcase": ["our", "customers"], "invitation": ["the", "click"]}
_count = lambda terms: "(" + " + ".join(f"contains(lower(span), '{t}')::INT" for t in terms) + ")"
_times = lambda pattern: f"len(regexp_extract_all(span, '{pattern}'))"
_SCORE_SQL = f"""({_count(MARKERS["technical"])} + 2 * {_times(rules.NUMBER)} - 3 * ({_count(MARKERS["showcase"])} + {_times(rules.STORY_HEAD)} + {_times(rules.FEED_ENTRY)})
- 2 * {_times(rules.EMOJI)} - {_count(MARKERS["invitation"])})::DOUBLE / (length(span) / 100.0::DOUBLE)"""
BEST_SQL = f"""{_SPANS_SQL}, k AS (SELECT doc_id, i, j, span, round({_SCORE_SQL}, 6) AS score FROM s), b1 AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i, j) = 1),
best AS (SELECT l.doc_id, text, i, j, score, coalesce(span, substr(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1, 320)) AS span FROM l LEFT JOIN b1 USING (doc_id))"""


@query(f"WITH {BEST_SQL} SELECT doc_id, i, j, score, md5(span) AS digest FROM best")
def span_blocks_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = rules.best_spans(table(spark, sf_dir, "documents"), "doc_id", **MARKERS)
    return best.select("doc_id", "i", "j", "score", F.md5(F.col("span").cast("binary")).alias("digest"))


@query("""WITH r AS (SELECT source AS owner, lang AS list, md5(text) AS url, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rank, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS list_at FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY rank, list_at) AS turn FROM r WHERE rank <= 8), f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY owner, url ORDER BY turn) = 1)
SELECT owner, list, url, rank, row_number() OVER (PARTITION BY owner ORDER BY turn) AS position FROM f""")
def interleave_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("source", "lang").orderBy("doc_id"))
    place = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3)
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("owner"), F.col("lang").alias("list"), F.md5(F.col("text").cast("binary")).alias("url"), rank.alias("rank"), place.alias("list_at")).where("rank <= 8")
    return rules.interleave(rows, "owner", "url").select("owner", "list", "url", F.col("rank").cast("long").alias("rank"), F.col("position").cast("long").alias("position"))


@query("""WITH r AS (SELECT source, lang, doc_id AS position, n_chars AS score, text AS t FROM documents)
SELECT source, lang, min(position) AS position, md5(arg_max(t, (score, -position))) AS text, max(score) AS score FROM r GROUP BY 1, 2""")
def best_text_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "lang", F.col("doc_id").alias("position"), F.col("n_chars").alias("score"), "text")
    return rules.best_text_per_group(rows, "source", "lang").withColumn("text", F.md5(F.col("text").cast("binary")))


@query("SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'es' THEN 1 WHEN 'de' THEN 2 ELSE 3 END, doc_id) AS new_position FROM documents")
def order_by_custom_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = rules.by_list(table(spark, sf_dir, "documents").select("source", "doc_id", "lang"), "lang", ["es", "de"], "source", "doc_id")
    return placed.withColumn("new_position", F.col("new_position").cast("long"))


@query("""WITH e(technology, need, exact_text) AS (VALUES ('src1', 'fr', 'made for French'), ('src2', 'de', 'made for German')), t(need, template) AS (VALUES ('en', '{technology} reads English'), ('fr', '{technology} reads French')),
r AS (SELECT DISTINCT source AS technology, lang AS need FROM documents)
SELECT r.technology, r.need, coalesce(exact_text, replace(template, '{technology}', r.technology), 'ask us') AS business, CASE WHEN r.technology IN ('src1') THEN 'alta' ELSE 'media' END AS complexity FROM r LEFT JOIN e USING (technology, need) LEFT JOIN t ON r.need = t.need""")
def lookup_three_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = spark.createDataFrame([("src1", "fr", "made for French"), ("src2", "de", "made for German")], "technology string, need string, exact_text string")
    template = spark.createDataFrame([("en", "{technology} reads English"), ("fr", "{technology} reads French")], "need string, template string")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("technology"), F.col("lang").alias("need")).distinct()
    complexity = spark.createDataFrame([("src1", "alta")], "technology string, complexity string")
    looked = rules.lookup(rows, exact, template, "ask us").join(F.broadcast(complexity), "technology", "left")
    return looked.select("technology", "need", "business", F.coalesce("complexity", F.lit("media")).alias("complexity"))


_NEEDS_SQL = "n AS (SELECT source, lang AS need, (count(*) > 6) AS validated FROM documents GROUP BY 1, 2), c AS (SELECT source, lang AS origin, doc_id AS position FROM documents), v AS (SELECT source, list(need ORDER BY need) AS valid FROM n WHERE validated GROUP BY source), f AS (SELECT c.*, CASE WHEN list_contains(valid, origin) THEN [origin] ELSE coalesce(valid, []) END AS evidence FROM c LEFT JOIN v USING (source))"


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    needs = documents.groupBy("source", F.col("lang").alias("need")).agg((F.count(F.lit(1)) > 6).alias("validated"))
    cited = documents.select("source", F.col("lang").alias("origin"), F.col("doc_id").alias("position"))
    return rules.with_fallback(cited, needs, "source")


@query(f"WITH {_NEEDS_SQL} SELECT source, origin, position, array_to_string(evidence, ',') AS evidence FROM f")
def evidence_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).withColumn("evidence", F.array_join("evidence", ","))


@query(f"WITH {_NEEDS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) AS place FROM f) SELECT source, origin, position, place, array_to_string(evidence[1:3], ',') AS evidence FROM p WHERE place <= 3 AND len(evidence) > 0")
def recommend_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.recommend(_cited(spark, sf_dir), "source").select("source", "origin", "position", "place", F.array_join("evidence", ",").alias("evidence"))


_RULES = [(1, ["brass", "nickel"], "x", ["MFGR#1", "Brand#11"]), (2, ["steel"], "Brand#12", ["Brand#12"]), (3, [], "Brand#13", ["Brand#13", "Brand#31"])]
_RULES_SQL = "(VALUES " + ", ".join(f"({i}, {_list(s) if s else '[]::VARCHAR[]'}, '{n}', {_list(e)})" for i, s, n, e in _RULES) + ") r(rule_id, parts, need, expected)"


@query(f"""SELECT rule_id::BIGINT AS rule_id, count(*) AS pairs, count(*) FILTER (list_has_any([p_brand], expected)) AS hits, count(*) FILTER (list_has_any(['Brand#13', 'Brand#12'], expected)) AS trivial_hits
FROM part JOIN {_RULES_SQL} ON len([s for s in parts if contains(lower(p_type), s)]) > 0 OR need = p_brand GROUP BY rule_id""")
def rule_coverage_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    listed = spark.createDataFrame(_RULES, "rule_id long, sector_parts array<string>, need string, expected array<string>")
    entities = part.select("p_partkey", F.col("p_type").alias("sector"), F.array("p_brand").alias("needs"))
    return evaluate.rule_coverage(entities, listed, part.select("p_partkey", F.col("p_brand").alias("value")), ["Brand#13", "Brand#12"], "p_partkey")


@query(r"""WITH w AS (SELECT source, term, count(*) AS n FROM (SELECT source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}'))) AS term FROM documents) GROUP BY ALL),
e AS (SELECT source, arg_min(term, (-n, term)) AS name FROM w GROUP BY source), d AS (SELECT doc_id, name AS own, text FROM documents JOIN e USING (source))
SELECT own, name, count(*) AS documents FROM d JOIN (SELECT DISTINCT name FROM e) v ON NOT contains(own, name) AND NOT contains(name, own) AND contains(text, name)
AND regexp_matches(text, '(^|[^\w.-])' || name || '($|[^\w-])') GROUP BY ALL""")
def cross_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of entities in the documents of others. The tables name no entity but by a number, so each one's name is the
    word of eight letters or more that most of its documents hold."""
    documents = table(spark, sf_dir, "documents")
    words = documents.select("source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), 0))).alias("term"))
    counted = words.groupBy("source", "term").agg(F.count(F.lit(1)).alias("n"))
    names = keep(counted.groupBy("source").agg(F.min_by("term", F.struct(-F.col("n"), "term")).alias("own")), "names")  # read several times
    found = rules.mentions(documents, names.select(F.col("own").alias("name")), "doc_id", "source").join(names, "source").where(rules.apart("own"))
    return found.groupBy("own", "name").agg(F.count(F.lit(1)).alias("documents"))


_SETS_SQL = """e AS (SELECT source, list_distinct(list(CASE WHEN contains(lower(text), 'license') THEN 'license' END) || list(CASE WHEN contains(lower(text), 'password') THEN 'password' END) || list(CASE WHEN contains(lower(text), 'idiot') THEN 'idiot' END)) AS raw FROM documents GROUP BY source),
s AS (SELECT source, [x for x in raw if x IS NOT NULL] AS emitted, ['license', 'password'] AS expected, ['idiot'] AS ambiguous FROM e), c AS (SELECT *, [x for x in emitted if NOT list_contains(ambiguous, x)] AS counted FROM s), k AS (SELECT *, len(list_intersect(counted, expected)) AS hit FROM c)"""


@query(f"""WITH {_SETS_SQL}, t AS (SELECT 'rules' AS arm, counted, expected, hit, emitted FROM k UNION ALL SELECT 'constant', ['license'], expected, 1, ['license'] FROM k)
SELECT arm, round(avg(CASE WHEN len(counted) > 0 THEN hit / len(counted) END), 6) AS precision, round(avg(hit / len(expected)), 6) AS recall, count(DISTINCT list_sort(emitted)) AS distinct_sets, count(*) AS entities FROM t GROUP BY arm""")
def precision_recall_vs_trivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = ["license", "password", "idiot"]
    own = table(spark, sf_dir, "documents").groupBy("source").agg(*(F.max(F.lower("text").contains(t)).alias(t) for t in terms))
    listed = lambda *v: F.array(*(F.lit(x) for x in v))
    emitted = F.array_compact(F.array(*(F.when(F.col(t), F.lit(t)) for t in terms)))
    sets = own.select(emitted.alias("emitted"), listed("license", "password").alias("expected"), listed("idiot").alias("ambiguous"))
    arms = [sets.withColumn("arm", F.lit("rules")), sets.withColumns({"emitted": listed("license"), "arm": F.lit("constant")})]
    out = [evaluate.precision_recall(a, "emitted", "expected", "ambiguous").withColumn("arm", F.lit(n)) for a, n in zip(arms, ("rules", "constant"), strict=True)]
    return out[0].unionByName(out[1])


@query("SELECT (toxic = 1) AS expected, count(*) AS n, count(*) FILTER (f) AS found, count(*) FILTER (f <> (toxic = 1)) AS wrong FROM (SELECT toxic, (contains(lower(text), 'idiot') OR contains(lower(text), 'loser') OR contains(lower(text), 'scum')) AS f FROM labels JOIN documents USING (doc_id)) GROUP BY 1")
def two_sided_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return evaluate.confusion(joined, F.col("toxic") == 1, T.contains_any(F.lower("text"), ["idiot", "loser", "scum"]))


@query("SELECT CASE WHEN toxic IS NULL THEN 'unmeasured' WHEN quality = toxic THEN 'ambiguous' WHEN quality = 1 THEN 'correct' ELSE 'wrong' END AS outcome, 'quality' AS field, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def field_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    accepted = F.when(F.col("toxic").isNull(), None).when(F.col("quality") == F.col("toxic"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    return evaluate.scoreboard(joined, "quality", F.col("quality"), accepted)


@query(f"WITH s AS (SELECT source, list_distinct(flatten(list([x for x in {SENTENCES_SQL} if length(x) > 40]))) AS s, sum(length(text)) AS n FROM documents GROUP BY source) SELECT source, coalesce(list_sum([length(x) for x in s]), 0)::BIGINT AS covered, round(coalesce(list_sum([length(x) for x in s]), 0)::DOUBLE / n::DOUBLE, 6) AS ratio FROM s")
def coverage_distinct_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    spans = documents.select("source", F.explode(T.long_sentences(F.col("text"))).alias("s")).distinct().groupBy("source").agg(F.sum(F.length("s")).alias("covered"))
    total = documents.groupBy("source").agg(F.sum(F.length("text")).alias("n"))
    covered = F.coalesce("covered", F.lit(0)).cast("long")
    return total.join(spans, "source", "left").select("source", covered.alias("covered"), F.round(covered / F.col("n"), 6).alias("ratio"))


@query(f"SELECT lang, min(n)::BIGINT AS least, floor(median(n))::BIGINT AS middle, max(n)::BIGINT AS most FROM (SELECT lang, len({TOKENS_SQL}) AS n FROM documents) GROUP BY lang")
def median_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").select("lang", F.size(T.raw_tokens(F.col("text"))).alias("n"))
    return n.groupBy("lang").agg(F.min("n").cast("long").alias("least"), F.floor(F.percentile("n", 0.5)).cast("long").alias("middle"), F.max("n").cast("long").alias("most"))


@query("""SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 2 = 0)
UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END, o_totalprice * 2, 'N' FROM orders WHERE o_orderstatus = 'F'""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one status come again: those with an even key replace their row, the others are new."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    key = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    new = orders.where("o_orderstatus = 'F'").select(key.alias("o_orderkey"), (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("N").alias("o_orderstatus"))
    return tables.upsert(orders, new, ["o_orderkey"])


@query("""WITH n AS (SELECT l_orderkey, count(*) AS parts FROM lineitem WHERE l_quantity < 25 GROUP BY 1)
SELECT l.l_orderkey, l.l_linenumber FROM lineitem l LEFT JOIN n USING (l_orderkey) WHERE parts IS NULL OR l.l_linenumber - 1 < parts""")
def delete_stale_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_linenumber") - 1).alias("ordinal"))
    return tables.without_stale(rows, rows.where("l_quantity < 25"), ["l_orderkey"], "ordinal").select("l_orderkey", "l_linenumber")


@query("SELECT conv_id, turn, role, turn - min(turn) OVER (PARTITION BY conv_id) AS place FROM conversations")
def thread_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.appended(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def thread_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.last_value(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")


#: Ids whose documents come in one part under their source, so that no row grows with the table.
PART_IDS = 100_000


@query(f"SELECT source, doc_id // {PART_IDS} AS part, array_to_string(list(doc_id || ' ' || lang ORDER BY doc_id), ',') AS documents, count(*) AS n FROM documents GROUP BY ALL")
def payload_drop_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents nested under their source, without the texts, which are dropped before anything is gathered. A source's documents
    come in parts by ranges of their ids."""
    part = F.floor(F.col("doc_id") / PART_IDS).cast("long")
    payload = tables.nested(tables.without_text(table(spark, sf_dir, "documents")), "source", "doc_id", ["lang"], part=part)
    listed = F.transform("documents", lambda d: F.concat(d["doc_id"].cast("string"), F.lit(" "), d["lang"]))
    return payload.select("source", "part", F.array_join(listed, ",").alias("documents"), F.size("documents").cast("long").alias("n"))
