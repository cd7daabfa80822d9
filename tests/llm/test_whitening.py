import math

import numpy as np
import pytest

from lodestar.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int"


def measures(spark, rows, components=4, schema=SCHEMA):
    vectors = whitening.whole_vectors(spark.createDataFrame(rows, schema).repartition(3))
    transform, error = whitening.fit(vectors, components)
    return whitening.by_component(whitening.whiten(vectors, transform), transform, error, components).collect()


def test_equals_numpy(spark):
    rng = np.random.default_rng(3)
    many = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) / 9).astype(np.float32)
    many[7] = many[8] = many[0]
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(many)]
    rows += [(-1, None, 0, 0), (-2, [None, *many[0, 1:].tolist()], 0, 0), (-3, [math.nan, *many[0, 1:].tolist()], 0, 0), (-4, [math.inf] * 12, 0, 0)]
    got = measures(spark, rows)
    x = np.floor(256 * many.astype(np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    assert n == 298
    mean = s / n
    e, v = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == 4 * 300 and {r.vec_id for r in got} == set(range(300))
    for k in range(1, 5):
        mine = sorted((r for r in got if r.component == k), key=lambda r: r.vec_id)
        want = (x - mean) @ v[:, k - 1] / math.sqrt(e[k - 1])
        told = np.array([r.whitened for r in mine])
        assert min(np.abs(told - want).max(), np.abs(told + want).max()) < 1e-9
        assert all(abs(r.explained - e[k - 1] / e.sum()) < 1e-12 and r.n == n and r.identity_error < 1e-10 for r in mine)
        assert [r.deviation for r in mine] == [int(d) for d in ((n * x - s) ** 2).sum(axis=1)]


def test_merging_equals_one_pass():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (500, 6)) + 10**6
    parts = [whitening.summary(p.astype(np.float64)) for p in np.split(x, [1, 40, 333])]
    one = whitening.summary(x.astype(np.float64))
    left = whitening.merge(whitening.merge(parts[0], parts[1]), whitening.merge(parts[2], parts[3]))
    assert left.n == one.n and left.sums == one.sums == x.sum(axis=0).tolist()
    np.testing.assert_allclose(left.scatter, one.scatter, rtol=1e-12, atol=1e-3)
    np.testing.assert_allclose(left.scatter / 500, np.cov(x.T, bias=True), rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("rows", [[], [(1, None, 0, 0), (2, [None], 0, 0)]])
def test_nothing_left(spark, rows):
    assert measures(spark, rows) == []


def test_no_variance_and_other_lengths(spark):
    same = measures(spark, [(1, [0.5, 0.25], 0, 0), (2, [0.5, 0.25], 0, 0), (2, [0.5, 0.25], 0, 0), (3, [1.0], 0, 0), (4, [], 0, 0), (5, [-0.0, 0.0, 1.0], 0, 0), (6, [0.0, 0.0, 2.0], 0, 0)], components=2)
    # three numbers are the commonest length of distinct vectors
    by = {(r.vec_id, r.component): r for r in same}
    assert len(same) == 14 and by[1, 1].whitened is None and by[1, 1].deviation is None and by[4, 2].n == 2
    assert abs(abs(by[5, 1].whitened) - 1) < 1e-12 and by[5, 2].whitened is None and by[5, 1].explained == 1.0
    assert by[5, 1].deviation == (2 * 256 - 768) ** 2
    one = measures(spark, [(1, [0.5, 0.25], 0, 0), (2, [0.5, 0.25], 0, 0)])
    assert {(r.whitened, r.explained, r.deviation, r.n, r.identity_error) for r in one} == {(None, None, 0, 1, 0.0)} and len(one) == 4


def test_large_entries(spark):
    got = measures(spark, [(1, [1e30, 0.0], 0, 0), (2, [-1e30, 1.0], 0, 0), (3, [0.0, 0.5], 0, 0)])
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id < 3)
    top = [r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == 1]
    assert abs(top[0] + top[1]) < 1e-9


def test_fraction_of_doubles_and_all_components(spark):
    vectors = whitening.whole_vectors(spark.createDataFrame([(i, [i * 0.5, (i * i % 7) * 1.0]) for i in range(20)], "vec_id long, embedding array<double>"))
    transform, error = whitening.fit(vectors)
    assert transform.components.shape == (2, 2) and error < 1e-12
    assert abs(transform.variances.sum() - transform.total) < 1e-6
