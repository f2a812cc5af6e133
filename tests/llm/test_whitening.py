import math

import numpy as np
import pytest

from swathlake.llm import whitening


def brute(rows):
    """n, and by id: deviation and the whitened values, of the covariance's eigenvectors by numpy."""
    ok = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in ok), default=0)
    ok = [(i, v + [1000000] * (d - len(v))) for i, v in ok]
    fit = sorted({tuple(v) for _, v in ok})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in fit])
    e, x = np.linalg.eigh(y.T @ y / n)
    e, x = e[::-1][:16], x[:, ::-1][:, :16]
    return n, e, e / np.square(y).sum() * n, [(i, sum((n * a - b) ** 2 for a, b in zip(v, s)), np.array([(n * a - b) / n for a, b in zip(v, s)]) @ x / np.sqrt(e)) for i, v in ok]


def check(df, rows, tolerance=1e-7):
    n, e, explained, want = brute(rows)
    got = {}
    for r in df.collect():
        assert r["n"] == n and r["identity_error"] < 1e-8
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        got.setdefault((r["vec_id"], r["deviation"]), []).append((r["component"], r["whitened"]))
    assert sorted(got, key=repr) == sorted({(i, d) for i, d, _ in want}, key=repr)
    w = np.array([x for _, _, x in want])
    ours = np.array([[v for _, v in sorted(got[i, d])[:: len(got[i, d]) // len(e)]] for i, d, _ in want])
    sign = np.sign((w * ours).sum(0))
    assert np.abs(w - ours * sign).max() < tolerance


def test_every_table_equals_numpy(spark, sf):
    df = whitening.op12_embedding_whitening(spark, sf)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(df, rows)


def test_copies_count_once_and_many_dimensions_converge(spark):
    r = np.random.default_rng(1)
    d = 150
    basis = np.linalg.qr(r.normal(size=(d, d)))[0] * (0.93 ** np.arange(d))
    rows = [(i, [float(c) for c in r.normal(size=d) @ basis.T]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(7, rows[3][1])]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)), rows)


def test_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [1.0, 2.0, 0.5]), (2, [1.0]), (3, None), (4, [nan, 1.0, 1.0]), (5, [inf, 0.0, 0.0]), (6, [None, 1.0, 1.0]), (None, [-1.0, 4.0, 2.5]), (8, [-3.0, 0.25, 7.0]), (8, [-3.0, 0.25, 7.0]), (9, []), (10, [2.0, -5.0, 1.0])]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "vec_id long, embedding array<double>, x string, n int")
    check(whitening.whiten(df), rows)
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id in (3, 9)")).count() == 0
    assert whitening.whiten(df.where("vec_id = 8")).count() == 0  # one different vector has no variance
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(10)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}  # one direction with variance


def test_large_entries(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5e12, 7.0])], "vec_id string, embedding array<double>")
    out = whitening.whiten(df).collect()
    assert {r["vec_id"] for r in out} == {"1", "2", "3"} and all(r["deviation"] is None for r in out if r["vec_id"] != "3")


def test_lobpcg_certifies_residuals():
    r = np.random.default_rng(2)
    q = np.linalg.qr(r.normal(size=(400, 400)))[0]
    values = 1.0 / (1 + np.arange(400)) ** 0.5
    a = (q * values) @ q.T
    e, x, worst = whitening.lobpcg(lambda b: a @ b, 400, 16)
    assert worst <= whitening.CERTIFIED and np.abs(e - values[:16]).max() < 1e-12
    assert np.abs(np.abs((x * q[:, :16]).sum(0)) - 1).max() < 1e-9
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda b: a @ b, 400, 16, most=3)
