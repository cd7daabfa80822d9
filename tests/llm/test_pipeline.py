import itertools
import random

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm import scratch


def test_stages_over_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    docs, counts = documents, [documents.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf), "stage")
        assert docs.columns == documents.columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_rows_equal_a_plain_pass(spark, tmp_path):
    """Toxic pairs, near copies, a leaked item, personal numbers, nulls and reused ids, against the same steps in Python."""
    r = random.Random(9)
    words = [f"word{i}" for i in range(700)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = text(30)
    rows = [(i, text(60) + (" grumble" if i % 3 else "") + (" folk" if i % 3 != 1 else "")) for i in range(240)]  # toxic: both words
    rows += [(300, None), (301, ""), (302, "same id"), (302, "same id, other text"), (303, text(40) + " at 10.20.30.40 today"), (304, text(20) + " " + item + " " + text(20))]
    base = text(100).split()
    for i in range(310, 330):
        copy = list(base)
        copy[r.randrange(100)] = f"edit{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    toxic = {k for k, t in rows if k < 240 and k % 3 == 2}
    spark.createDataFrame([(k, int(k in toxic)) for k in range(240)], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")

    left = [(k, t) for k, t in rows if k not in toxic]
    sets, root = [_shingles(t) for _, t in left], list(range(len(left)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(left)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    left = [x for i, x in enumerate(left) if find(i) == i and item not in (x[1] or "")]
    assert len(toxic) == 80 and 304 not in {k for k, _ in left} and sum(310 <= k < 330 for k, _ in left) < 20

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((k, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for k, t in left if k != 303)
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    whole = {}
    for x in got:
        whole.setdefault((x.doc_id, x.doc_tokens), []).append((x.start, x.length))
    assert sorted(x for x in whole for _ in range(sum(s == 0 for s, _ in whole[x])) if x[0] != 303) == want
    assert 303 in {x.doc_id for x in got} and all(sum(n for _, n in v) == k[1] * sum(s == 0 for s, _ in v) for k, v in whole.items())


def test_empty_tables(spark, tmp_path):
    none = lambda schema, name: spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    none("doc_id long, text string, lang string, source string, n_chars long", "documents")
    none("doc_id long, toxic int", "labels")
    none("item_id long, text string", "benchmark")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
