import pytest
from pyspark.sql import functions as F

from lodestar.operators import evaluate, rules, tables


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_classes(spark):
    got = {(a, d, t): value(spark, rules.class_of(rules.class_points(F.lit(a), F.lit(d), F.lit(t)))) for a in (True, False) for d in (True, False) for t in (True, False)}
    assert got[(True, True, False)] == "AI-native" and got[(True, False, True)] == "AI-enabled" and got[(False, False, False)] == "non-AI"


@pytest.mark.parametrize("kinds,recent,n,want", [(0, 0, 0, None), (1, 0, 1, "baixa"), (1, 1, 1, "media"), (2, 0, 2, "media"), (2, 1, 2, "alta")])
def test_confidence(spark, kinds, recent, n, want):
    assert value(spark, rules.confidence(F.lit(kinds), F.lit(recent), F.lit(n))) == want


def test_recency_ignores_the_day(spark):
    day = lambda s: F.lit(s).cast("date")
    assert value(spark, rules.recent(day("2022-10-31"), day("2024-09-01"))) and not value(spark, rules.recent(day("2022-09-30"), day("2024-09-01")))
    assert value(spark, rules.recent(F.lit(None).cast("date"), day("2024-09-01"))) is False


def test_term_major_and_veto(spark):
    docs = spark.createDataFrame([("e", 1, "we sell second."), ("e", 2, "we sell first."), ("f", 3, "a client of ours does first."), ("g", 4, "xfirst")], "name string, doc_id long, text string")
    got = rules.exclusions(docs, {"label": ["first", "second"]}, ["client"], "name").collect()
    assert [(r.name, r.term, r.doc_id) for r in got] == [("e", "first", 2)]


def test_age(spark):
    assert [value(spark, rules.age_outcome(F.lit(y).cast("int"), F.lit(2024))) for y in (2015, 2014, 2013, None)] == ["eligible", "pending", "excluded", "unverified"]
    assert value(spark, rules.relative_age(F.lit("It was founded some 12 years ago, and started 3 years ago."))) == 12


def test_lowest_of_scale(spark):
    df = spark.createDataFrame([("alta",), ("media",)], "c string")
    assert df.agg(rules.lowest(rules.CONFIDENCE, F.col("c")).alias("x")).first().x == "media"
    assert df.where("false").agg(rules.lowest(rules.CONFIDENCE, F.col("c")).alias("x")).first().x == "baixa"


def test_cut_comes_before_the_filter(spark):
    rows = spark.createDataFrame([("e", i, ["x"] if i > 1 else []) for i in range(1, 6)], "name string, position long, evidence array<string>")
    assert [r.position for r in rules.recommend(rows, "name").orderBy("position").collect()] == [2, 3]


def test_interleave(spark):
    rows = [("e", "a", "u1", 1, 0), ("e", "a", "u2", 2, 0), ("e", "b", "u1", 1, 1), ("e", "b", "u3", 2, 1)]
    df = spark.createDataFrame(rows, "owner string, list string, url string, rank int, list_at int")
    assert [r.url for r in rules.interleave(df, "owner", "url").orderBy("position").collect()] == ["u1", "u2", "u3"]


def test_spans_and_score(spark):
    df = spark.createDataFrame([(1, "x" * 50 + "\n\n" + "y" * 50 + "\n" + "z" * 400), (2, ""), (3, None), (4, " short ")], "doc_id long, text string")
    assert [(r.i, r.j) for r in rules.spans(df, "doc_id").collect()] == [(1, 2)]
    assert sorted((r.doc_id, r.i, None if r.span is None else len(r.span)) for r in rules.best_spans(df, "doc_id").collect()) == [(1, 1, 101), (2, None, 0), (3, None, None), (4, None, 5)]
    assert value(spark, rules.span_score(F.lit(""), ["a"], [], [])) is None
    assert value(spark, rules.span_score(F.lit("a 5 ms " + " " * 93), ["a"], [], [])) == 3.0


@pytest.mark.parametrize(
    "text,points",
    [("2.4x faster", 2), ("24,000 tokens", 2), ("FP8 and 70B", 4), ("in 2024, 3 items", 0), ("Writer / Startup Pens", -3), ("see\nA B / Case", -3), ("* [2024/07/09] news", -3), ("\u2728 \U0001f680", -4), ("runs on CUDA and Triton", 2), ("Success Story", -3), ("learn more", -1)],
)
def test_parts_of_the_score(spark, text, points):
    assert value(spark, rules.span_score(F.lit(text))) == pytest.approx(points / (len(text) / 100))


def test_spans_equal_a_plain_loop(spark):
    import random

    r = random.Random(6)
    texts = {k: "\n".join(" " * r.randrange(2) + "ab " * r.randrange(0, 60) for _ in range(r.randrange(0, 40))) for k in range(30)}
    texts[99] = "\n".join("x" for _ in range(500))
    want = set()
    for k, text in texts.items():
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if len(block := "\n".join(lines[i : j + 1])) > rules.SPAN_MAX:
                    break
                if len(block) >= rules.SPAN_MIN:
                    want.add((k, i + 1, j + 1, block))
    got = rules.spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id").collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_profile_parts(spark):
    documents = spark.createDataFrame([("e", 2, "second"), ("e", 1, "first"), ("f", 3, "third")], "name string, doc_id long, text string")
    names = spark.createDataFrame([("e", "what it does"), ("f", None), ("g", "no documents")], "name string, description string")
    assert [tuple(x) for x in rules.value_proposition(names, documents, "name").collect()] == [("e", "value", "what it does", 1, "first")]
    found = spark.createDataFrame([("e", "pain", 1), ("e", "stack", 2), ("e", "delivery", 0), ("e", "pain", 0)], "name string, kind string, doc_id long")
    assert [(x.kind, x.doc_id) for x in rules.flattened(found, "name").orderBy("place").collect()] == [("stack", 2), ("pain", 0), ("pain", 1), ("delivery", 0)]
    assert value(spark, rules.unverified(F.lit("pending"), F.lit(" "), F.lit(True))) == ["exact date of foundation", "site", "incorporation"]
    assert value(spark, rules.diagnosis_confidence(F.array(F.lit("alta"), F.lit(None), F.lit("media")), F.lit("alta"))) == "media"
    assert value(spark, rules.diagnosis_confidence(F.array().cast("array<string>"), F.lit("alta"))) == "baixa"
    assert value(spark, rules.diagnosis_confidence(F.array(F.lit("baixa")), F.lit("alta"), own_evidence=True)) == "alta"
    assert [value(spark, rules.age_outcome(F.lit(None).cast("int"), F.lit(2024), F.lit(n))) for n in (10, 11)] == ["unverified", "excluded"]


def test_places_cover_all_rows(spark):
    rows = [(i * 7919 % 1000, "en" if i % 3 else "fr", f"o{i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "n long, lang string, owner string")
    got = rules.by_list(df, "lang", ["fr"], "owner", "n", width=40).collect()
    for owner in ("o0", "o1"):
        mine = sorted((x.lang != "fr", x.n, x.new_position) for x in got if x.owner == owner)
        assert [p for *_, p in mine] == list(range(1, len(mine) + 1))


def test_cross_mentions(spark):
    documents = spark.createDataFrame([("acme", "we met Other-Co. and Other."), ("acme labs", "acme is here"), ("other", "Other"), ("x", "a.Other Other-2"), ("x", None)], "name_of string, text string").selectExpr("monotonically_increasing_id() as id", "*")
    documents = spark.createDataFrame(documents.collect(), documents.schema)
    names = spark.createDataFrame([("Other",), ("acme",), ("",), (None,)], "name string")
    assert [(r.name_of, r.name) for r in rules.cross_mentions(documents, names, "name_of", "id").collect()] == [("acme", "Other")]


def test_anchors_seeded_or_short(spark):
    docs = spark.createDataFrame([(1, "say: the quick brown fox jumps over it"), (2, "The quick brown fox jumps over"), (3, "quick-brown"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "k-b"), (3, None), (4, "he quick brown fox jumps ov"), (5, ""), (6, "zzz")], "query_id long, anchor string")
    assert sorted((r.query_id, r.doc_id) for r in evaluate.anchored(docs, asked, "doc_id", "query_id").collect()) == [(1, 1), (2, 3), (4, 1), (4, 2)]


def test_gold_measures(spark):
    sets = spark.createDataFrame([("e", ["a", "z"], ["b"], ["a"])], "name string, x array<string>, y array<string>, w array<string>")
    assert sorted((r.reason, *r.labels) for r in evaluate.partition_problems(sets, "name", ["x", "y", "w"], ["a", "b", "c"]).collect()) == [("in none", "c"), ("in x and w", "a"), ("unknown in x", "z")]
    hits = spark.createDataFrame([(1, 1, 2), (2, None, 1), (3, 3, 3)], "query_id long, d long, h long")
    assert {r.engine: (r.first, r.better, r.worse) for r in evaluate.first_places(hits, ["d", "h"]).collect()} == {"d": (1, 0, 0), "h": (1, 1, 1)}


def test_precision_recall(spark):
    rows = [(["a", "b", "q"], ["a"], ["q"]), ([], [], []), ([], ["a"], [])]
    got = evaluate.precision_recall(spark.createDataFrame(rows, "e array<string>, x array<string>, q array<string>"), "e", "x", "q").first()
    assert (got.precision, got.recall, got.distinct_sets) == (0.75, 0.5, 2)


def test_seed_upsert_and_vectors(spark):
    e = "nome string, site string, coletado_em string"
    old, new = spark.createDataFrame([("a", "s", "2020"), ("b", "t", "2020")], e), spark.createDataFrame([("a", "u", "2024"), ("c", "v", "2024")], e)
    d = "nome string, url_fonte string, titulo string"
    docs, more = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y")], d), spark.createDataFrame([("a", "2", "z"), ("c", "1", "w")], d)
    entities, documents = tables.seeded(old, docs, new, more)
    assert sorted(tuple(r) for r in entities.collect()) == [("a", "u", "2020"), ("b", "t", "2020"), ("c", "v", "2024")]
    assert sorted(tuple(r) for r in documents.collect()) == [("a", "1", "x"), ("a", "2", "z"), ("c", "1", "w")]
    parts = tables.nested(spark.range(50).selectExpr("'s' as source", "id as doc_id", "'en' as lang"), "source", "doc_id", ["lang"], most=10).collect()
    assert len(parts) > 1 and sorted(x.doc_id for r in parts for x in r.documents) == list(range(50))


def test_judges(spark):
    from lodestar.operators import providers

    found = spark.createDataFrame([("e", "k", "yes"), ("e", "k", "no"), ("f", "k", "no")], "name string, kind string, span string")
    keep = lambda question, spans: [i for i, s in enumerate(spans) if s == "yes"] + [9]
    assert providers.judged(found, "name", "q", None).count() == 3 and [r.span for r in providers.judged(found, "name", "q", keep).collect()] == ["yes"]

    def broken(question, spans):
        raise OSError

    assert providers.judged(found, "name", "q", broken).count() == 3
    claims = found.withColumn("text", F.lit("t"))
    assert [r.sustained for r in providers.sustained(claims, None).collect()] == [None] * 3
    assert sorted(r.sustained for r in providers.sustained(claims, keep).collect()) == [True] * 3


def test_tables(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted((r.k, r.v) for r in tables.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError):
        tables.run_path("/x", "../etc")
    tables.save_run(old, f"file://{tmp_path}", "run-1")
    assert spark.read.json(f"file://{tmp_path}/run-1").count() == 2


def test_payload_is_nested_by_source(spark, tmp_path):
    from lodestar.plans import rule_queries

    rows = [(1, "a", "s", "en"), (0, "b", "s", "fr"), (3, None, "s", None), (200_000, "c", "s", "de"), (2, "d", "t", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rule_queries.payload_drop_nested(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("s", 0, "0 fr,1 en", 3), ("s", 2, "200000 de", 1), ("t", 0, "2 en", 1)]
