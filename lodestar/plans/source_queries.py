"""Queries over parsed structure and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.sources import chunks, files, outline
from lodestar.streaming import progress

from .registry import query, table
from .text_queries import _GAP_SQL, _LINES_SQL, _SHOWN_SQL


_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_NOISE_SQL = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in T.NOISE_TAGS:  # no back references here: one element after another
    _NOISE_SQL = rf"regexp_replace({_NOISE_SQL}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', '', 'g')"


@query(rf"""WITH n AS (SELECT page_id, url, {_NOISE_SQL} AS h FROM pages), c AS (SELECT page_id, url, array_to_string([{_SHOWN_SQL} for p in regexp_extract_all(h, '{T.PIECE}')], '') AS t FROM n),
m AS (SELECT page_id, coalesce(url, '') AS name, string_split({_GAP_SQL.format(_LINES_SQL)}, chr(10)) AS ls FROM c WHERE t IS NOT NULL),
l AS (SELECT page_id, name, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line FROM m),
s1 AS (SELECT *, sum(regexp_matches(line, '{outline.FENCE}')::INT) OVER (PARTITION BY page_id ORDER BY i) % 2 = 1 OR regexp_matches(line, '{outline.FENCE}') AS closed, coalesce(lead(line) OVER (PARTITION BY page_id ORDER BY i), '') AS next FROM l),
s2 AS (SELECT *, CASE WHEN closed THEN 0 ELSE length(regexp_extract(line, '{outline.HEADING}', 1)) END AS hashes FROM s1),
s3 AS (SELECT *, NOT closed AND hashes = 0 AND regexp_matches(next, '{outline.RULER}') AND trim(line) <> '' AS over_it FROM s2),
s4 AS (SELECT *, over_it AND (i - coalesce(max(CASE WHEN NOT over_it THEN i END) OVER (PARTITION BY page_id ORDER BY i), -1) - 1) % 2 = 0 AS under FROM s3),
s5 AS (SELECT *, CASE WHEN hashes BETWEEN 1 AND 3 THEN hashes WHEN under THEN CASE WHEN starts_with(next, '=') THEN 1 ELSE 2 END END AS level, CASE WHEN hashes > 0 THEN regexp_extract(line, '{outline.HEADING}', 2) ELSE line END AS shown,
coalesce(lag(under) OVER (PARTITION BY page_id ORDER BY i), false) AS ruler FROM s4),
s6 AS (SELECT *, sum((level IS NOT NULL)::INT) OVER (PARTITION BY page_id ORDER BY i) AS section FROM s5),
g AS (SELECT page_id, name, section, coalesce(max(level), 0) AS level, coalesce(max(trim(shown, {_TRIM})) FILTER (level IS NOT NULL), '') AS title, coalesce(trim(string_agg(shown, chr(10) ORDER BY i) FILTER (level IS NULL AND NOT ruler), {_TRIM}), '') AS body FROM s6 GROUP BY ALL),
t AS (SELECT *, {', '.join(f"last_value(CASE WHEN level = {n} AND title <> '' THEN section END IGNORE NULLS) OVER w AS p{n}, last_value(CASE WHEN level = {n} AND title <> '' THEN title END IGNORE NULLS) OVER w AS t{n}" for n in (1, 2, 3))}
FROM g WINDOW w AS (PARTITION BY page_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY section) - 1 AS ordinal, level::BIGINT AS level, title, concat_ws(' > ', name, t1, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN t3 END) AS path, md5(body) AS body
FROM t WHERE title <> '' OR body <> ''""")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the pages with their breadcrumbs, by windows over lines."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", outline.page_markdown(F.col("html")).alias("text"))
    return outline.outline(pages, "page_id", "text", "url").drop("parts").withColumn("body", F.md5(F.col("body").cast("binary")))


def _page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", outline.page_lines(F.col("html")).alias("text"))
    return outline.outline(pages, "page_id", "text", "url", kind="page")


@query()
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_sections(spark, sf_dir).select("page_id", "ordinal", "level", "title", "body")


@query()
def chunk_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk(_page_sections(spark, sf_dir), "page_id")


@query()
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", T.clean_markdown(F.col("text")).alias("text"))
    return chunks.chunk(outline.outline(documents, "doc_id", "text", "source"), "doc_id")


@query("SELECT conv_id, 'role is none of confianca' AS reason FROM conversations WHERE role IS NOT NULL UNION ALL SELECT conv_id, 'empty text' FROM conversations WHERE length(text) = 0 OR text IS NULL")
def vocabulary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = files.vocabulary_checks({"role": "confianca"}) | {"empty text": F.length("text") > 0}
    return files.violations(table(spark, sf_dir, "conversations"), "conv_id", checks)


@query("SELECT time_bucket(INTERVAL 1 hour, ts::TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.windowed(table(spark, sf_dir, "events"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, count(*) AS steps FROM events GROUP BY user_id")
def event_last_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.threads(table(spark, sf_dir, "events"))


@query("""WITH e AS (SELECT user_id AS run, event_id AS place, event_type AS node, props AS payload FROM events), n AS (SELECT run, min(payload) AS name FROM e WHERE node = 'signup' GROUP BY run)
SELECT run, place, 'node' AS kind, node, name, NULL::BIGINT AS steps, NULL::VARCHAR AS reason FROM e LEFT JOIN n USING (run)
UNION ALL SELECT run, NULL, 'end', NULL, name, count(*), CASE WHEN bool_or(node = 'purchase') THEN 'finished' ELSE 'silent' END FROM e LEFT JOIN n USING (run) GROUP BY run, name""")
def run_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a display is told of each user's events, as a table; the stream of the same is ``progress.messages``."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("place"), "ts", F.col("event_type").alias("node"), F.col("props").alias("payload"))
    return progress.all_messages(events, "signup", "purchase")
