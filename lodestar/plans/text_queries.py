"""Queries over raw text: search, tokens, sentences, cleaning, chunks, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import search

from .registry import query, table

TERMS = ["license", "apache", "token", "software"]
MARKERS = ["license", "apache", "token", "version", "software", "copyright", "public"]
TOKENS_SQL = rf"regexp_extract_all(strip_accents(lower(text)), '{T.TOKEN}')"
SENTENCES_SQL = r"list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s, ' '))"
_list = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
_SEARCH_SQL = f"""
scored AS (SELECT source, 0.1 * len([t for t in {TOKENS_SQL} if t in {_list(TERMS)}]) AS score FROM documents),
ranked AS (SELECT source, round(max(score), 6)::DOUBLE AS score, count(*) AS matched FROM scored WHERE score > 0 GROUP BY source)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source").distinct()


@query(f"WITH {_SEARCH_SQL} SELECT source, score, matched FROM ranked ORDER BY score DESC, source LIMIT 5")
def entity_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_entities(entities(spark, sf_dir), table(spark, sf_dir, "documents"), TERMS, "source", 5)


@query("SELECT DISTINCT source, 0.0::DOUBLE AS score, 0::BIGINT AS matched FROM documents ORDER BY source LIMIT 5")
def entity_search_no_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_entities(entities(spark, sf_dir), table(spark, sf_dir, "documents"), [], "source", 5)


@query("""SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE (contains(lower(c_mktsegment), 'build') OR contains(lower(c_mktsegment), 'auto')) AND c_acctbal >= 1000""")
def attribute_filter_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = search.SearchPlan(sectors=["BUILD", "auto"], size_min=1000)
    wanted = search.like_any(F.col("c_mktsegment"), plan.sectors) & search.between(F.col("c_acctbal"), plan.size_min, plan.size_max)
    placed = search.like_any(F.col("n_name"), plan.places)
    nation = table(spark, sf_dir, "nation").where(placed).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").where(wanted).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")


@query(f"""WITH {_SEARCH_SQL}, best AS (SELECT source FROM ranked ORDER BY score DESC, source LIMIT 3)
SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS place FROM documents JOIN best USING (source)""")
def documents_for_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    best = search.search_entities(entities(spark, sf_dir), documents, TERMS, "source", 3).select("source")
    order = W.partitionBy("source").orderBy(F.desc_nulls_last("n_chars"), "doc_id")
    return documents.join(F.broadcast(best), "source").select("source", "doc_id", "n_chars", F.row_number().over(order).cast("long").alias("place"))  # three rows


@query(f"""WITH t AS (SELECT doc_id, [x for x in {TOKENS_SQL} if length(x) > 1 and x not in ('the', 'de', 'und')] AS k FROM documents)
SELECT doc_id, len(k)::BIGINT AS n_tokens, len(list_distinct(k))::BIGINT AS n_distinct, k[1] AS first_token FROM t""")
def tokens_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text"), ("the", "de", "und")).alias("k"))
    return own.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.size(F.array_distinct("k")).cast("long").alias("n_distinct"), F.try_element_at("k", F.lit(1)).alias("first_token"))


@query(f"""WITH s AS (SELECT doc_id, [x for x in {SENTENCES_SQL} if length(x) > 40] AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(list_sum([length(x) for x in s]), 0)::BIGINT AS n_letters FROM s""")
def sentences_over_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", T.long_sentences(F.col("text")).alias("s"))
    return own.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate("s", F.lit(0), lambda n, x: n + F.length(x)).cast("long").alias("n_letters"))


@query(f"""WITH s AS (SELECT doc_id, source, [x for x in {SENTENCES_SQL} if length(x) > 40 and (contains(lower(x), 'license') or contains(lower(x), 'the '))] AS s FROM documents),
f AS (SELECT source, doc_id, substr(s[1], 1, 400) AS span, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM s WHERE len(s) > 0)
SELECT source, doc_id, span, place FROM f WHERE place <= 3""")
def first_sentence_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.filter(T.long_sentences(F.col("text")), lambda s: T.contains_any(F.lower(s), ["license", "the "]))
    found = table(spark, sf_dir, "documents").select("source", "doc_id", F.substring(F.try_element_at(hit, F.lit(1)), 1, 400).alias("span")).where("span is not null")
    place = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return found.withColumn("place", place.cast("long")).where("place <= 3")


@query(f"""WITH m AS (SELECT source, doc_id, [x for x in {_list(MARKERS)} if contains(lower(text), x)] AS m, length(text) AS n FROM documents),
e AS (SELECT source, unnest(m) AS marker FROM m), d AS (SELECT source, count(DISTINCT marker) AS markers FROM e GROUP BY source)
SELECT m.source, coalesce(any_value(markers), 0)::BIGINT AS distinct_markers, sum(len(m))::BIGINT AS marker_hits, round(sum(100.0 * len(m)) / sum(n), 6) AS density FROM m LEFT JOIN d ON m.source = d.source GROUP BY m.source""")
def marker_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("source", T.present(F.lower("text"), MARKERS).alias("m"), F.length("text").alias("n"))
    each = [F.max(F.array_contains("m", x).cast("int")) for x in MARKERS]
    distinct = sum(each[1:], each[0])
    return own.groupBy("source").agg(
        distinct.cast("long").alias("distinct_markers"), F.sum(F.size("m")).cast("long").alias("marker_hits"), F.round(F.sum(100.0 * F.size("m")) / F.sum("n"), 6).alias("density")
    )


@query(r"""SELECT count(*) FILTER (regexp_matches(lower(text), '\blicense')) AS starts_word, count(*) FILTER (regexp_matches(text, '(?i)\blicense\b')) AS whole_word,
count(*) FILTER (contains(lower(text), 'license')) AS anywhere, count(*) FILTER (regexp_matches(lower(text), '\bthe')) AS starts_the, count(*) FILTER (regexp_matches(text, '(?i)\bthe\b')) AS whole_the FROM documents""")
def word_boundary_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, low = F.col("text"), F.lower("text")
    counts = {"starts_word": T.starts_word(low, "license"), "whole_word": T.whole_word(t, "license"), "anywhere": low.contains("license"), "starts_the": T.starts_word(low, "the"), "whole_the": T.whole_word(t, "the")}
    return table(spark, sf_dir, "documents").agg(*(F.count_if(c).alias(k) for k, c in counts.items()))


@query(r"""WITH s AS (SELECT doc_id, [x for x in regexp_split_to_array(lower(text), '[.!?;\n]+') if contains(x, 'license')] AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS sentences, (len([x for x in s if contains(x, 'apache') or contains(x, 'gnu') or contains(x, 'cc by')]) = len(s)) AS vetoed FROM s WHERE len(s) > 0""")
def third_party_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    holding = F.filter(F.split(low, r"[.!?;\n]+"), lambda s: s.contains("license"))
    veto = T.vetoed_by_third_party(F.col("text"), "license", ["apache", "gnu", "cc by"])
    return table(spark, sf_dir, "documents").where(low.contains("license")).select("doc_id", F.size(holding).cast("long").alias("sentences"), veto.alias("vetoed"))


_NOISE_SQL = "regexp_replace(html, '<!--(?s:.*?)-->', '', 'g')"
_NOISE_SQL = "regexp_replace(" + _NOISE_SQL + ", '(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in T.NOISE_TAGS) + "', '', 'g')"
_PAGE_SQL = f"regexp_replace({_NOISE_SQL}, '<[^>]+>', chr(10), 'g')"
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_GAP_SQL = "trim(regexp_replace(array_to_string({0}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), " + _WS + ")"
_KEPT_SQL = rf"[l for l in [trim(y, {_WS}) for y in string_split({{0}}, chr(10))] if regexp_matches(l, '\S\s+\S+\s+\S') or regexp_matches(l, '[.!?:]$')]"
_CLEAN_SQL = _GAP_SQL.format(_KEPT_SQL.format(_PAGE_SQL))


@query(f"SELECT page_id, md5({_NOISE_SQL}) AS digest, length({_NOISE_SQL})::BIGINT AS n FROM pages")
def html_strip_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = T.strip_noise_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(bare.cast("binary")).alias("digest"), F.length(bare).cast("long").alias("n"))


def _inside_sql(tag: str) -> str:
    return rf"regexp_extract_all(h, '(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>', 1)"


_LINE_TEXTS_SQL = rf"""list_transform(blocks, lambda b: array_to_string([y for y in [trim(z, {_WS}) for z in string_split(regexp_replace(regexp_replace(b, '{T._INLINE}', '', 'g'), '(?s)<[^>]+>', chr(10), 'g'), chr(10))] if y <> ''], chr(10)))"""


@query(rf"""WITH n AS (SELECT page_id, {_NOISE_SQL} AS h FROM pages), c AS (SELECT page_id, list_concat({_inside_sql('main')}, {_inside_sql('article')}, [coalesce(nullif(regexp_extract(h, '(?is)<body\b[^>]*>(.*)</body\s*>', 1), ''), h)]) AS blocks FROM n WHERE h IS NOT NULL),
t AS (SELECT page_id, {_LINE_TEXTS_SQL} AS texts FROM c), m AS (SELECT page_id, texts[list_position(list_transform(texts, lambda x: length(x)), list_max(list_transform(texts, lambda x: length(x))))] AS t FROM t)
SELECT page_id, md5({_GAP_SQL.format(_KEPT_SQL.format('t'))}) AS digest, length(t)::BIGINT AS n FROM m""")
def page_longest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of a page's main parts, cleaned line by line."""
    longest = table(spark, sf_dir, "pages").where("html is not null").select("page_id", T.longest_block(F.col("html")).alias("t"))
    return longest.select("page_id", F.md5(T.clean_lines(F.col("t")).cast("binary")).alias("digest"), F.length("t").cast("long").alias("n"))


def page_text() -> Column:
    return T.strip_tags(T.strip_noise_tags(F.col("html")))


@query(f"SELECT page_id, md5({_CLEAN_SQL}) AS digest, length({_CLEAN_SQL})::BIGINT AS n FROM pages")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "pages").select("page_id", T.clean_lines(page_text()).alias("t"))
    return clean.select("page_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("n"))


PHRASES = ["licensed under", "all rights"]
_BOILER_SQL = _GAP_SQL.format(rf"""[l for l in string_split(text, chr(10)) if not ({" or ".join(f"contains(lower(l), '{p}')" for p in PHRASES)} or regexp_matches(lower(l), '={{8}}|^\s*\*|<a href|<center|class="'))]""")


@query(f"SELECT doc_id, md5({_BOILER_SQL}) AS digest, (length(text) - length({_BOILER_SQL}))::BIGINT AS dropped FROM documents")
def clean_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = T.drop_boilerplate(F.col("text"), PHRASES)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(kept.cast("binary")).alias("digest"), (F.length("text") - F.length(kept)).cast("long").alias("dropped"))


_MARKED = "<h2>Title</h2>\n[![b](u)](v) ![i](u) [link text](http://x)\n| - |\n |\n---\n<!-- c -->"
_SHOWN_SQL = rf"""CASE WHEN regexp_full_match(p, '{T._HEAD}') THEN chr(10) || repeat('#', p[3]::INT) || ' ' WHEN regexp_full_match(p, '{T._HEAD_END}') THEN chr(10)
WHEN regexp_full_match(p, '(?s)<.+>') OR starts_with(p, '![') OR starts_with(p, '[![') THEN '' WHEN regexp_full_match(p, '(?s)\[.*\]\([^()]*\)') THEN regexp_extract(p, '(?s)^\[(.*)\]\([^()]*\)$', 1) ELSE p END"""
_BARE = "' ' || chr(9) || chr(13) || chr(12) || chr(11)"
_LINES_SQL = rf"[rtrim(l, {_BARE}) for l in string_split(t, chr(10)) if trim(l, {_BARE}) NOT IN ('|', '-', '·') AND (l = '' OR trim(l, {_BARE}) <> '')]"


@query(rf"""WITH m AS (SELECT doc_id, replace('{_MARKED}', '\n', chr(10)) || text AS t FROM documents),
c AS (SELECT doc_id, array_to_string([{_SHOWN_SQL} for p in regexp_extract_all(t, '{T.PIECE}')], '') AS t FROM m) SELECT doc_id, md5({_GAP_SQL.format(_LINES_SQL)}) AS digest FROM c""")
def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit(_MARKED), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_markdown(marked).cast("binary")).alias("digest"))


@query("""WITH w AS (SELECT doc_id, generate_series(0, greatest(0, ceil((length(text) - 800) / 680.0)::INT) * 680, 680) AS starts, text FROM documents),
c AS (SELECT doc_id, [substr(text, a + 1, 800) for a in starts] AS c FROM w), k AS (SELECT doc_id, [x for x in c if trim(x, ' ') <> ''] AS c FROM c),
e AS (SELECT doc_id, unnest(range(len(c))) AS ordinal, c FROM k) SELECT doc_id, ordinal::BIGINT AS ordinal, md5(c[ordinal + 1]) AS digest, length(c[ordinal + 1])::BIGINT AS n FROM e""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.fixed_windows(F.col("text"))).alias("ordinal", "c"))
    return cut.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.md5(F.col("c").cast("binary")).alias("digest"), F.length("c").cast("long").alias("n"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS content_hash FROM documents""")
def slug_and_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"), F.sha2(T.normalise_newlines(F.col("text")), 256).alias("content_hash"))


_NEW_ID, _NEW_TEXT = "CASE WHEN doc_id % 11 = 0 THEN doc_id + 1000000000 ELSE doc_id END", "CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END"


@query(f"""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents), n AS (SELECT {_NEW_ID} AS doc_id, sha256({_NEW_TEXT}) AS h FROM documents)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'gone' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS outcome FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def hash_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of all documents: some texts change, some documents are numbered anew."""
    documents = table(spark, sf_dir, "documents")
    old = documents.select("doc_id", F.sha2("text", 256).alias("old"))
    new = documents.select(F.expr(_NEW_ID).alias("doc_id"), F.sha2(F.expr(_NEW_TEXT), 256).alias("new"))
    outcome = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return old.join(new, "doc_id", "full").select("doc_id", outcome.alias("outcome"))


LEAST_CHARS, LEAST_HEADINGS = 3000, 3  # fixed values: what a source needs
_TITLE_SQL = r"coalesce(nullif(regexp_extract(html, '(?is)<title[^>]*>\s*(.*?)\s*</title>', 1), ''), url)"
_CONTENT_SQL = rf"trim(regexp_replace({_PAGE_SQL}, '\s+', ' ', 'g'))"


@query(rf"""SELECT page_id, length({_CONTENT_SQL})::BIGINT AS n, len(regexp_extract_all(html, '(?i)<h[1-3][ >]'))::BIGINT AS headings, {_TITLE_SQL} AS title,
(length({_CONTENT_SQL}) >= {LEAST_CHARS} AND len(regexp_extract_all(html, '(?i)<h[1-3][ >]')) >= {LEAST_HEADINGS}) AS accepted FROM pages""")
def quality_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of enough content and headings; the others are told apart, not dropped."""
    n = F.length(F.trim(F.regexp_replace(page_text(), r"\s+", " ")))
    headings = F.regexp_count("html", F.lit("(?i)<h[1-3][ >]"))
    title = T.title_of(F.col("html"), "html", F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", n.cast("long").alias("n"), headings.cast("long").alias("headings"), title.alias("title"), ((n >= LEAST_CHARS) & (headings >= LEAST_HEADINGS)).alias("accepted"))


@query(r"""SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?m)^[ \t]*#[# \t]*(.*?)[ \t]*$', 1), ''), source) AS title FROM documents""")
def markdown_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.title_of(F.col("text"), "markdown", F.col("source")).alias("title"))


@query(r"""SELECT doc_id, len([l for l in [trim(y, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) for y in string_split(text, chr(10))] if length(l) BETWEEN 1 AND 3 and not regexp_matches(l, '[\p{L}\p{N}]')])::BIGINT AS orphans,
len(regexp_extract_all(text, '(?m)^[-*] '))::BIGINT AS list_items, len(regexp_extract_all(text, '[\x{1F300}-\x{1FAFF}\x{2190}-\x{21FF}\x{2600}-\x{27BF}]'))::BIGINT AS ornaments FROM documents""")
def line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan lines, lines that begin an item of a list, and ornamental signs of each document."""
    counted = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    orphans = F.size(T.orphan_lines(F.col("text"))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", orphans.alias("orphans"), counted("(?m)^[-*] ").alias("list_items"), counted(r"[\x{1F300}-\x{1FAFF}\x{2190}-\x{21FF}\x{2600}-\x{27BF}]").alias("ornaments"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, length(to_json({'id': event_id, 'kind': event_type}))::BIGINT AS n FROM events")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field out of a JSON text, and a row written as one."""
    written = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.length(written).cast("long").alias("n"))


@query(r"""SELECT source, 'short text' AS reason, count(*) AS n FROM documents WHERE length(text) < 200 GROUP BY source
UNION ALL SELECT source, 'fewer than 3 documents', count(*) FROM documents GROUP BY source HAVING count(*) < 3
UNION ALL SELECT source, 'fewer than 2 kinds', count(*) FROM documents GROUP BY source HAVING count(DISTINCT lang) < 2
UNION ALL SELECT source, 'orphan punctuation', count(*) FROM documents WHERE len([l for l in string_split(text, chr(10)) if length(trim(l, ' ')) BETWEEN 1 AND 3 AND NOT regexp_matches(l, '[A-Za-z0-9À-ÿ]')]) > 0 GROUP BY source""")
def seed_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    orphan = F.exists(F.split("text", "\n"), lambda line: F.length(F.trim(line)).between(1, 3) & ~line.rlike("[A-Za-z0-9À-ÿ]"))
    row = documents.select("source", "lang", (F.length("text") < 200).alias("short"), orphan.alias("orphan"))
    facts = row.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("lang").alias("kinds"), F.count_if("short").alias("short"), F.count_if("orphan").alias("orphan"))
    reasons = {"short text": ("short > 0", "short"), "fewer than 3 documents": ("docs < 3", "docs"), "fewer than 2 kinds": ("kinds < 2", "docs"), "orphan punctuation": ("orphan > 0", "orphan")}
    found = F.array_compact(F.array(*(F.when(F.expr(when), F.struct(F.lit(reason).alias("reason"), F.col(n).alias("n"))) for reason, (when, n) in reasons.items())))
    return facts.select("source", F.explode(found).alias("v")).select("source", "v.reason", "v.n")
