import math

import pytest

from lodestar.operators import prospect, search, sweeps

SECTORS = {"health": ["hospital", "saude"], "energy": ["solar"]}
NEEDS = {"latency": ["slow", "latency"], "privacy": ["private"]}
DOCS = [
    (1, "a", "health", "slow patient records and private data"), (2, "a", "health", "patient patient latency latency"), (3, "b", "energy", "panels are slow"),
    (4, "c", "health", "nothing here"), (5, "d", "energy", None), (6, "b", "energy", "private private panels"),
]
ASKED = [(1, "Hospital patient records, slow!"), (2, "solar"), (3, "private"), (4, None), (5, ""), (6, "panels panels unknownword"), (7, "privately slow hospitals")]


def plain(asked):
    """The same with loops."""
    bags = {d: search_tokens(t) for d, _, _, t in DOCS}
    of = {d: (e, s) for d, e, s, _ in DOCS}
    df = {w: sum(w in b for b in bags.values()) for b in bags.values() for w in b}
    score = lambda words, d: sum(math.log(1 + len(DOCS) / df[w]) * bags[d].count(w) / (1 + bags[d].count(w)) for w in set(words) if w in bags[d])
    out = []
    for q, text in asked:
        words = search_tokens(text)
        name = lambda w, lexicon: next((n for n, terms in lexicon.items() if any(w.startswith(t) for t in terms)), None)
        sectors, needs = ([n for n in dict.fromkeys(name(w, lex) for w in words) if n] for lex in (SECTORS, NEEDS))
        keywords = [w for w in words if not name(w, SECTORS) and not name(w, NEEDS)]
        best: dict = {}
        if keywords:
            for d, (e, s) in of.items():
                if any(w in bags[d] for w in keywords) and (not sectors or s in sectors):
                    best[e] = max(best.get(e, 0), score(keywords, d))
        elif sectors:
            best = {e: 0.0 for e, s in of.values() if s in sectors}
        elif needs:
            best = {e: 0.0 for e in sorted({e for e, _ in of.values()})[:2]}
        for place, e in enumerate(sorted(best, key=lambda e: (-round(best[e], 6), e))[:2], start=1):
            for at, n in enumerate(needs or NEEDS, start=1):
                found = sorted((-round(score(NEEDS[n], d), 6), d) for d in bags if of[d][0] == e and any(w in bags[d] for w in NEEDS[n]))
                out += [(q, e, place, n, at, found[0][1], -found[0][0])] if found else []
    return sorted(out)


def search_tokens(text):
    import re

    return [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) > 1]


def test_answers_equal_loops(spark):
    documents = spark.createDataFrame(DOCS, "doc_id long, name string, sector string, text string").repartition(3)
    held = search.index(documents.selectExpr("doc_id", "coalesce(text, '') as text"), "doc_id")
    plans = prospect.planned(spark.createDataFrame(ASKED, "q long, text string"), "q", SECTORS, NEEDS)
    by = {r.q: r for r in plans.collect()}
    assert (by[1].sectors, by[1].needs, by[1].keywords) == (["health"], ["latency"], ["patient", "records"]) and by[4].keywords == by[5].needs == []
    answers = prospect.answered(plans, held, documents, NEEDS, "q", "doc_id", "name", "sector", entities=2)
    got = sorted((r.q, r.name, r.entity_place, r.need, r.need_place, r.doc_id, r.score) for r in answers.collect())
    want = plain(ASKED)
    assert [g[:6] for g in got] == [w[:6] for w in want] and all(abs(g[6] - w[6]) < 2e-6 for g, w in zip(got, want, strict=True))
    assert {g[0] for g in got} == {1, 2, 3, 6, 7}
    made = {(r.q, r.name): r for r in prospect.recommended(answers, documents, "q", "doc_id", "name", head=4).collect()}
    assert made[2, "b"].needs == "latency,privacy" and made[2, "b"].evidence == "[0] (latency) pane\n\n[1] (privacy) priv"


def test_no_requests_and_no_documents(spark):
    documents = spark.createDataFrame(DOCS, "doc_id long, name string, sector string, text string")
    held = search.index(documents.where("text is not null"), "doc_id")
    none = prospect.planned(spark.createDataFrame([], "q long, text string"), "q", SECTORS, NEEDS)
    assert prospect.answered(none, held, documents, NEEDS, "q", "doc_id", "name", "sector").count() == 0
    some = prospect.planned(spark.createDataFrame(ASKED, "q long, text string"), "q", SECTORS, NEEDS)
    empty = documents.where("false")
    assert prospect.answered(some, search.index(empty, "doc_id"), empty, NEEDS, "q", "doc_id", "name", "sector").count() == 0


@pytest.mark.parametrize("rows", [[], [(5, True), (5, False), (3, True), (0, False), (0, True)]])
def test_thresholds(spark, rows):
    df = spark.createDataFrame(rows, "deep int, gold boolean")
    got = {r.threshold: (r.reached, r.hits, r.precision, r.recall) for r in sweeps.thresholds(df, "deep", df.gold).collect()}
    want = {}
    for t in {d for d, _ in rows}:
        own = [g for d, g in rows if d >= t]
        want[t] = (len(own), sum(own), round(sum(own) / len(own), 6), round(sum(own) / sum(g for _, g in rows), 6))
    assert got == want
