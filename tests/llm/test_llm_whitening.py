"""The qd solver and whitening against numpy's own decompositions and exact integers."""

import math

import numpy as np
import pytest

from tallyline.llm import qd, queries, whitening


def matrices():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    gaps = rng.normal(size=(24, 24)) @ np.diag(10.0 ** -np.linspace(0, 6, 24))
    gone = rng.normal(size=(24, 24))
    gone[:, 5], gone[:, 8] = 0.0, gone[:, 9]
    yield from (rng.normal(size=(24, 24)), gaps, gaps[:, ::-1], gone, np.eye(24), turn * 3,
                turn @ np.diag([2.0] * 10 + [1.0] * 14) @ turn.T, np.zeros((24, 24)), np.array([[3.0]]),
                np.array([[1.0, 2.0], [0.0, 1e-9]]), rng.integers(-3, 4, (24, 24)).astype(float),
                np.diag(np.arange(24.0)) + np.eye(24, k=1))


@pytest.mark.parametrize("m", list(matrices()))
def test_singular_values_and_vectors(m):
    values, first, vectors = qd.right_singular(m)
    want = np.linalg.svd(m, compute_uv=False) ** 2
    top = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * top
    kept = first > 1e-14 * top if want[0] else first > 0
    v = vectors[:, kept]
    assert np.abs(m.T @ (m @ v) - v * first[kept]).max(initial=0.0) <= 1e-12 * top
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max(initial=0.0) < 1e-9


def test_small_singular_values_keep_their_digits():
    """dqds on a graded bidiagonal matrix, whose product is known: its determinant."""
    a, b = 10.0 ** -np.arange(12.0), 0.3 * 10.0 ** -np.arange(11.0)
    values = qd.qd_values(a * a, b * b)
    assert math.isclose(np.log(values).sum(), 2 * np.log(a).sum(), rel_tol=1e-14)


def test_bidiagonal_form_has_the_same_singular_values():
    m = np.random.default_rng(8).normal(size=(17, 17))
    a, b, v = qd.bidiagonalise(m)
    form = np.diag(a) + np.diag(b, 1)
    assert np.abs(v.T @ v - np.eye(17)).max() < 1e-14
    assert np.abs((m @ v).T @ (m @ v) - form.T @ form).max() < 1e-12


def vectors(n=700, d=40, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d)) * 0.2
    return (centres[rng.integers(0, 5, n)] + 0.1 * rng.normal(size=(n, d))).astype(np.float32)


def table(spark, path, rows):
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(7).write.parquet(
        f"{path}/embeddings.parquet")
    return path


def test_op12_against_eigenvectors_of_the_covariance(spark, scratch):
    made = vectors()
    rows = [(i, v.tolist(), 1) for i, v in enumerate(made)]
    rows += [(5, made[5].tolist(), 1), (None, made[6].tolist(), None)]  # a repeated row, and one without an id
    sound = np.array([r[1] for r in rows], dtype=np.float32)
    bad = [(900, None, 1), (901, [0.1] * 39 + [None], 1), (902, [float("nan")] + [0.0] * 39, 1),
           (903, [0.0] * 39 + [float("-inf")], 1), (904, [], 1), (905, [1.0, 2.0], 1)]
    got = queries.op12_whitening(spark, table(spark, scratch, rows + bad)).collect()
    x = np.floor(64.0 * sound.astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:32], v[:, ::-1][:, :32]
    assert len(got) == n * 32 and {r["n"] for r in got} == {n}
    exact = {(r[0]): sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for r, row in zip(rows, x)}
    assert all(r["deviation"] == exact[r["vec_id"]] for r in got)
    signs = {}
    white = centred @ v / np.sqrt(e)
    where = {r[0]: k for k, r in enumerate(rows)}
    for r in got:
        want = white[where[r["vec_id"]], r["component"] - 1]
        if abs(want) > 1e-3:
            sign = signs.setdefault(r["component"], np.sign(want * r["whitened"]))
            assert abs(sign * r["whitened"] - want) < 1e-8
        assert abs(r["explained"] - e[r["component"] - 1] / np.trace(cov)) < 1e-12
    assert {r["component"] for r in got} == set(range(1, 33))
    (error,) = {r["identity_error"] for r in got}
    y = np.zeros((n, 32))
    place = {}
    for r in got:
        key = (r["vec_id"], r["component"])
        copies = [k for k, row in enumerate(rows) if row[0] == r["vec_id"]]
        y[copies[place.get(key, 0)], r["component"] - 1] = r["whitened"]
        place[key] = place.get(key, 0) + 1
    y = y - y.mean(axis=0)
    assert error < 1e-10 and np.abs(y.T @ y / n - np.eye(32)).max() < 1e-10


def test_factors_join_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    x = (np.floor(64 * vectors(300, 12)) + 1000).astype(int)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<bigint>").repartition(11)
    white = whitening.fit(df, "x", 12)
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.abs(white.variances - want).max() < 1e-10 * want[0]


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [0.5, 0.25], 0)], [(1, [0.5] * 4, 0)] * 5])
def test_nothing_to_whiten(spark, scratch, rows):
    got = queries.op12_whitening(spark, table(spark, scratch, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.collect() == []


def test_dimensions_without_variance_have_no_component(spark, scratch):
    made = vectors(200, 6)
    made[:, 2], made[:, 4] = 0.5, made[:, 3]
    got = queries.op12_whitening(spark, table(spark, scratch, [(i, v.tolist(), 0) for i, v in enumerate(made)])).collect()
    assert {r["component"] for r in got} == {1, 2, 3, 4}
    assert got[0]["identity_error"] < 1e-9 and math.isclose(sum(
        r["explained"] for r in got if r["vec_id"] == 0), 1.0, rel_tol=1e-12)


def test_apply_keeps_other_columns_and_wide_deviations(spark):
    x = [[10**9 + 3**k, 7 * k] for k in range(12)]
    df = spark.createDataFrame([(v, "kept", "kept") for v in x], "`a.x` array<bigint>, Whitened string, vector_of string")
    rows, white, _ = whitening.whiten(df, "a.x", 2)
    assert rows.columns == ["a.x", "vector_of", "deviation", "whitened"]
    total = np.sum(x, axis=0)
    assert sorted(r["deviation"] for r in rows.collect()) == sorted(
        sum((12 * int(a) - int(s)) ** 2 for a, s in zip(v, total)) for v in x)
    assert whitening._squares(np.array([[2**32, 2**32], [1, 2]])) == [None, 5]
