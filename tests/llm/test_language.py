import random

import numpy as np

from lodestar.llm import language as L

ALPHABETS = {"aa": "abcde", "bb": "cdefg", "cc": "efghi", "dd": "xyzéü"}


def corpus(n=400):
    r = random.Random(2)
    out = []
    for i in range(n):
        lang = sorted(ALPHABETS)[i % 4]
        out.append((i, " ".join("".join(r.choice(ALPHABETS[lang]) for _ in range(r.randrange(2, 6))) for _ in range(40)), lang, "s"))
    return out


def test_codewords_tell_apart():
    for n in (2, 4, 6, 9, 30):
        code = L.codewords(n)
        assert len(np.unique(code, axis=0)) == n
    assert L.codewords(4).shape == (4, 7)


def test_held_out_accuracy_and_edges(spark):
    df = spark.createDataFrame([*corpus(), (1000, None, "aa", "s"), (1001, "123 !!", "aa", "s"), (1002, "abc", None, "s")], "doc_id long, text string, lang string, score string")
    codes = L.fit(df.where("doc_id % 5 != 0"), sample_rows=200)
    got = {r.doc_id: r for r in L.predict(df, codes).collect()}
    held = [i for i in range(0, 400, 5)]
    assert sum(got[i].lang_pred == sorted(ALPHABETS)[i % 4] for i in held) / len(held) > 0.95
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_decode_equals_a_plain_loop():
    r = np.random.default_rng(3)
    code = L.codewords(9)
    trust = r.random(code.shape)
    codes = L.Codes([f"l{i}" for i in range(9)], code, trust / trust.sum(axis=1, keepdims=True), np.zeros((1, 1)), np.zeros(1))
    margins = r.normal(size=(50, code.shape[1])) * 3
    margins[0] = 0  # a tie of the losses goes by trust, then to the first
    best, share, gap = L.decode(margins, codes)
    for i, m in enumerate(margins):
        far = [sum(codes.trust[k, b] * np.log1p(np.exp(-m[b] * code[k, b])) for b in range(len(m))) for k in range(9)]
        order = sorted(range(9), key=lambda k: (round(far[k], 12), k))
        assert best[i] == order[0] or abs(far[best[i]] - far[order[0]]) < 1e-12
        assert abs(gap[i] - (far[order[1]] - far[order[0]])) < 1e-9
        likely = [np.exp(-len(m) * (x - far[order[0]])) for x in far]
        assert abs(share[i] - 1 / sum(likely)) < 1e-9


def test_rare_and_many_languages(spark):
    rows = [(i, f"{chr(97 + i % 7)}{i} common words of a text", "aa", "s") for i in range(3000)] + [(5000 + i, "zzz xqx zxq", "rare", "s") for i in range(2)]
    rows += [(6000 + i, "one row again and again", "copied", "s") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    x, lang = L._sample(df, 60)
    assert len(x) == len(lang) <= 60 + 3 and set(lang) == {"aa", "rare", "copied"} and lang.count("aa") == 20
    many = spark.range(1500).selectExpr("id as doc_id", "concat('text', id) as text", "concat('l', id) as lang")
    assert len(set(L._sample(many, 100)[1])) == 1500


def test_no_rows_and_one_language(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert L.fit(docs) is None
    assert {r.lang_pred for r in L.predict(docs, None).collect()} == {"und"}
    one = spark.createDataFrame([(1, "abc", "aa"), (2, "abd", "aa")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.predict(one, L.fit(one)).collect()} == {"aa"}
    assert L.predict(docs.where("false"), None).count() == 0


def test_long_text_is_counted_whole():
    import pyarrow as pa

    long = "ab " * 800_000
    whole = L.features(pa.array([long + "zz " * 800_000, "x"]))
    half = L.features(pa.array([long, "x"]))
    assert abs(whole[0] - half[0]).max() > 0.1 and (whole[1] == half[1]).all()
