import random

from lodestar.llm import paragraphs as G


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)).capitalize() + "."


def corpus():
    r = random.Random(4)
    passage = " ".join(sentence(r, n) for n in (9, 12, 3, 10, 14, 8))
    words = passage.split()
    words[20] = "edited"
    own = lambda: " ".join(sentence(r, r.randrange(3, 15)) for _ in range(12))
    texts = {i: own() for i in range(20)}
    texts[20] = own()[:-1] + " " + passage + " " + own()
    texts[21] = own() + "\n" + passage + "\n" + own()
    texts[22] = own() + " and " + " ".join(words) + " " + own()
    texts[23] = texts[24] = own()
    texts[25] = sentence(r, 6) + " " + own()
    texts[26] = texts[25].split(".")[0] + ". " + own()  # a short shared sentence alone
    texts[27], texts[28] = None, ""
    return texts


def test_finds_passages_and_leaves_clean(spark):
    texts = corpus()
    df = spark.createDataFrame([(k, t, 9) for k, t in texts.items()], "doc_id long, text string, component int")
    rows = G.repeats(df).collect()
    assert {r.doc_id for r in rows} == {20, 21, 22, 23, 24}
    for r in rows:
        assert texts[r.doc_id].encode()[r.start : r.end].decode().split()
        assert r.component_doc <= r.doc_id and r.kept == (r.component_doc == r.doc_id and r.component_start == r.start)
    assert all(r.kept for r in rows if r.doc_id == 23) and not any(r.kept for r in rows if r.doc_id == 24)
    left = {r.doc_id: r.text for r in G.remove_repeats(df).collect()}
    assert set(left) == set(texts) and len(left[24].split()) < 5 and left[20] == texts[20] and left[0] == texts[0] and left[27] is None
    assert len(left[21]) < len(texts[21])


def test_passages_inside_text_without_sentence_ends(spark):
    """Passages of 51 to 80 words, exact or with one word edited, at random places between words of the host."""
    r = random.Random(7)
    plain = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    rows = []
    for i, n in enumerate([51, 55, 60, 66, 80] * 12):
        passage = plain(n)
        edited = list(passage)
        if i % 2:
            edited[r.randrange(n)] = "edited"
        for k, words in enumerate((passage, edited)):
            host = plain(160)
            at = r.randrange(20, 140)
            rows.append((2 * i + k, " ".join(host[:at] + words + host[at:])))
    rows += [(1000 + i, " ".join(plain(200))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in G.repeats(df).select("doc_id").distinct().collect()} == set(range(120))
    left = {x.doc_id: x.text for x in G.remove_repeats(df).collect()}
    assert all(left[i] == text for i, text in rows if i >= 1000 or i % 2 == 0) and all(len(left[i]) < len(text) for i, text in rows if i < 120 and i % 2)


def test_equals_a_search_for_shared_words(spark):
    """All documents that share 51 words in a row with another one are reported, and none that shares no 12."""
    r = random.Random(11)
    plain = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) + r.choice(["", "", "", "", "."]) for _ in range(n)]
    texts, passages = {}, [plain(n) for n in (51, 60, 75, 30, 11)]
    for i in range(60):
        words = plain(r.randrange(0, 300))
        for p in r.sample(passages, r.choice([0, 0, 1, 2])):
            at = r.randrange(len(words) + 1)
            words[at:at] = p
        texts[i] = " ".join(words) if i % 9 else "\n".join(words)
    windows = lambda n: {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    shared = lambda n: {i for w in [windows(n)] for i in w if any(w[i] & w[j] for j in w if j != i)}
    found = {x.doc_id for x in G.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert shared(51) and shared(51) <= found <= shared(12)


def test_reused_ids_clashing_columns_and_long_texts(spark):
    r = random.Random(5)
    passage = " ".join(sentence(r, 15) for _ in range(6))
    rows = [(1, "é " + passage, "a", 1), (1, "ü ü " * 30 + "own words only", "b", 2), (2, sentence(r, 20) + " " + passage, "c", 3), (2, None, "d", 4), (None, passage, "e", 5)]
    rows.append((3, "word " * 400_000 + passage + " again" * 300_000, "f", 6))
    df = spark.createDataFrame(rows, "doc_id long, text string, `__gone` string, start int")
    left = {x["__gone"]: x.text for x in G.remove_repeats(df).collect()}
    assert [left[k] for k in "abde"] == [rows[i][1] for i in (0, 1, 3, 4)]
    assert len(left["c"].split()) == 20 and len(left["f"]) < len(rows[5][1]) - len(passage) + 100


def test_edges(spark):
    assert G.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = [(1, "a b c d e f g h i j k l m n o p q r s t u v w. x"), (1, "a b c d e f g h i j k l m n o p q r s t u v w. x"), (None, "x")]
    assert G.repeats(spark.createDataFrame(same, "doc_id long, text string")).count() == 0


def test_bands():
    assert G.bands_for(0.8, 0.99) == 3 and G.bands_for(0.5, 0.99) == 7
