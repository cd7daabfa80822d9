import numpy as np

from lodestar.llm import nndescent as N


def vectors():
    r = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1, 2):
        base = r.normal(size=(150, 16))
        for v in base:
            rows.append((n, v.tolist(), label))
            n += 1
        for _ in range(120):  # near copies of one vector, and some at the threshold
            noise = r.normal(size=16) * (0.05 if n % 3 else 0.28)
            rows.append((n, (base[0] + noise).tolist(), label))
            n += 1
        rows.append((n, rows[-1][1], label))
        n += 1
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [1.0, float("nan")] + [0.0] * 14, 0), (n + 3, rows[0][1], None), (n + 4, [1.0, None] + [0.0] * 14, 0), (n + 5, [1.0, 2.0], 0)]
    return rows


def brute(rows, cosine):
    good = [(i, np.array(v, float), y) for i, v, y in rows if y is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows}
    for a, (i, v, y) in enumerate(good):
        for j, u, z in good[:a]:
            if y == z and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= cosine:
                links[i].add(j)
                links[j].add(i)
    low = {}
    for i in sorted(links):
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in low:
                low[x] = i
                stack += links[x]
    return {i: (len(links[i]), low[i]) for i in links}


def test_equals_brute_force(spark, monkeypatch):
    from lodestar.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK", 64)  # blocks of hot groups are met as well
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, radius string")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in N.near_vectors(df).collect()}
    want = brute(rows, 0.93)
    found, true = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert true > 2000 and found >= 0.99 * true and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_dense_region_is_counted_whole(spark, monkeypatch):
    """Hundreds of vectors, no two within half the threshold's angle, of which nearly all pairs link."""
    from lodestar.llm import blocks

    monkeypatch.setattr(blocks, "BLOCK", 64)
    monkeypatch.setattr(N, "WHOLE_BLOCK", 128)
    r = np.random.default_rng(8)
    base, rows = r.normal(size=48), []
    base /= np.linalg.norm(base)
    for i in range(420):
        noise = r.normal(size=48)
        rows.append((i, (base + noise / np.linalg.norm(noise) * r.uniform(0.2, 0.3)).tolist(), 1))
    for i in range(420, 440):  # near copies of some of them
        rows.append((i, (np.array(rows[i - 420][1]) + r.normal(size=48) * 1e-3).tolist(), 1))
    rows += [(i, r.normal(size=48).tolist(), 1) for i in range(440, 500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows, 0.93)
    assert sum(n for n, _ in want.values()) > 60_000
    assert {x.vec_id: (x.n_links, x.component_id) for x in N.near_vectors(df, strict=True).collect()} == want


def test_a_recall_without_links_is_told(spark, monkeypatch):
    import pytest

    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, r.normal(size=16).tolist(), 0) for i in range(300)], "vec_id long, embedding array<double>, label int")
    assert N.near_vectors(df, audit=1024, strict=True).where("n_links > 0").count() == 0  # all rows asked: no link is known
    rows = df.selectExpr("vec_id", "label", "embedding as vec")
    none = spark.createDataFrame([], "vec_id long, n_links long")
    assert N._audit(rows, rows, none, 0.93, 16, most=64) is None
    monkeypatch.setattr(N, "_audit", lambda *_: None)
    with pytest.raises(RuntimeError):
        N.near_vectors(df, strict=True)


def test_edges(spark):
    assert N.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in N.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_hot_group_does_not_hide_lost_pairs(spark):
    r = np.random.default_rng(5)
    hot = r.normal(size=16)
    vectors, found = [], []
    for i in range(100):
        vectors.append((i, 0, (hot + r.normal(size=16) * 1e-3).tolist()))
        found.append((i, 99))
    for i in range(100, 200, 2):  # pairs of which no link is counted
        a = r.normal(size=16)
        vectors += [(i, 0, a.tolist()), (i + 1, 0, (a + 1e-3).tolist())]
        found += [(i, 0), (i + 1, 0)]
    rows = spark.createDataFrame(vectors, "vec_id long, label int, vec array<double>")
    counted = spark.createDataFrame(found, "vec_id long, n_links long")
    centres = rows.where("vec_id = 0 or vec_id >= 100")
    assert N._audit(rows, centres, counted, 0.93, 64) < 0.5
    right = spark.createDataFrame([(i, 99 if i < 100 else 1) for i in range(200)], "vec_id long, n_links long")
    assert N._audit(rows, centres, right, 0.93, 64) == 1.0


def test_tables_follow_the_bits():
    theta = float(np.arccos(0.93))
    for rows in (48, 100_000, 3_000_000, 30_000_000):
        bits = int(np.ceil(np.log2(rows / N.BUCKET)))
        n = N._tables_for(bits, theta, 16)
        assert n >= 16 and 1 - (1 - (1 - theta / np.pi) ** bits) ** n >= 0.99
