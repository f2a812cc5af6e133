import math

import numpy as np
from pyspark.sql import functions as F

from swathlake.llm import topk


def brute(q, c, k):
    out = set()
    for i, v in q.items():
        s = sorted(((-sum(int(a) * int(b) for a, b in zip(v, w)), j) for j, w in c if j != i))[:k]
        out |= {(i, r + 1, j, -s_) for r, (s_, j) in enumerate(s)}
    return out


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 300)
    monkeypatch.setattr(topk, "QUERIES", 7)
    r = np.random.default_rng(0)
    centres = r.normal(0, 20, (5, 40))
    vs = [(i, [float(round(x)) for x in centres[i % 5] + r.normal(0, 6, 40)]) for i in range(900)]
    vs += [(1000 + i, vs[3][1]) for i in range(30)]  # many equal vectors: ties go to the smaller id
    df = spark.createDataFrame(vs, "id long, v array<double>").repartition(3)
    assert rows(topk.top_k(df.where("id % 20 = 0"), df, 20)) == brute({i: v for i, v in vs if i % 20 == 0}, vs, 20)


def test_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    data = [(20, [1.0, 2.0]), (40, [1.0]), (1, [2.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [-1.0, 0.5, 3.0]), (8, [2e9, 3e9]), (9, [1.0, 1.0]), (9, [1.0, 1.0])]
    df = spark.createDataFrame([(*x, "clash", 1) for x in data], "vec_id long, embedding array<double>, rank string, c_block int")
    e = topk.usable(df, "vec_id", "embedding", lambda x: F.floor(x * 64).cast("double"))
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert rows(topk.top_k(e.where("id % 20 = 0"), e, 20)) == brute({i: v for i, v in ok if i % 20 == 0}, ok, 20)
    none = e.where("id < 0")
    assert topk.top_k(none, none, 20).count() == 0 and topk.top_k(e, none, 20).count() == 0 and topk.top_k(none, e, 20).count() == 0


def test_scores_beyond_64_bits_tie_at_the_bound(spark):
    vs = [(20, [1e12, 1.0])] + [(i, [1e17 * (1 + i % 2), float(i)]) for i in range(1, 9)] + [(9, [-1e17, 0.0])]
    df = spark.createDataFrame(vs, "id long, v array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df.where("id = 20"), df, 20).collect())
    assert got == [(i, i, 2**63 - 1) for i in range(1, 9)] + [(9, 9, -(2**63))]


def test_repeated_queries_take_the_smallest_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [5.0, 3.0])], "id long, v array<double>")
    assert rows(topk.top_k(df.where("id = 1"), df, 2)) == {(1, 1, 2, 3)}
