import numpy as np
from pyspark.sql import functions as F

from swathlake.llm import language


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    net = language.Network(3, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, mask = r.integers(0, 256, (7, 4)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones((7, 4))
    _, g = net.gradients(x, y, mask)
    for k, at in (("U", (0, 1, 2)), ("U", (1, 4, 0)), ("W", (1, 2, 1)), ("c", (0, 0)), ("E", (0, 2, int(x[3, 1])))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = net.gradients(x, y, mask)[0]
        net.p[k][at] = old - 1e-3
        down = net.gradients(x, y, mask)[0]
        net.p[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-4, (k, at)


def test_windows_cover_every_byte_once():
    data = np.arange(256, dtype=np.uint8).repeat(3)
    off = np.array([0, 0, 5, 128 + 5, 500, 768])
    x, mask, row = language.windows(data, off, 128)
    got = [[] for _ in range(5)]
    for j, i in enumerate(row):
        got[i] += x[mask[:, j], j].tolist()
    assert got == [data[a:b].tolist() for a, b in zip(off, off[1:])]


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    assert r.where("score < 0 or score > 1").count() == 0


def test_odd_rows(odd_docs, no_docs):
    model = language.fit(odd_docs)
    got = {r["doc_id"]: r for r in language.identify(odd_docs, model).collect()}
    assert len(got) == 12
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {4, 5, 6, 10}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(odd_docs, model, carry=("lang", "score", "lang_pred")).count() == odd_docs.count()
    assert language.fit(no_docs) is None
    assert language.identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd_docs, None).collect()} == {"und"}
