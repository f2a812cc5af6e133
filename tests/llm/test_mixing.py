import numpy as np
from pyspark.sql import functions as F

from swathlake.llm import mixing


def solve(n, p, targets, most=None, steps=20_000):
    """The same least squares by many small projected steps."""
    now = n @ p
    r = np.ones(len(n))
    for _ in range(steps):
        r = np.clip(r - 0.2 * p @ (((r * n) @ p - targets) / now), 0, most)
    return (r * n) @ p


def test_rates_reach_what_brute_force_reaches(spark):
    g = np.random.default_rng(0)
    p, n = g.dirichlet([0.05] * 4, 300), g.integers(1, 500, 300)
    t = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n long, p0 double, p1 double, p2 double, p3 double").cache()
    total = n.sum()
    for shares, most in (((0.25, 0.25, 0.25, 0.25), None), ((0.9, 0.1, 0, 0), None), ((0.1, 0.2, 0.3, 0.4), 1.5)):
        targets = np.array(shares) * total
        direction, reached = mixing.fit_rates(t, targets, most)
        want = solve(n.astype(float), p, targets, most)
        assert np.abs(reached - want).max() < 0.01 * total
        rates = [r[0] for r in mixing.with_rate(t, direction, most).select("rate").collect()]
        assert min(rates) >= 0 and (most is None or max(rates) <= most)


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.col("doc_id") % 4 == 0
    model = mixing.fit_classifier(docs, labels.where(~held))
    r = model.posteriors(mixing.described(docs, "text", model.lexicon, "doc_id")).join(labels.where(held), "doc_id")
    for label, p in (("toxic", F.col("p1") + F.col("p3")), ("quality", F.col("p2") + F.col("p3"))):
        assert r.agg(F.avg(((p > 0.5).cast("int") == F.col(label)).cast("int"))).first()[0] > 0.93


def test_main_path_is_native(spark, sf):
    text = mixing.op4_mixing_sources(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_targets_are_met_as_a_solver_on_the_same_posteriors_does(spark):
    """Within 1 % of every domain's own target, and no farther than many small projected steps of numpy."""
    for d in ("sf0.001", "sf0.01"):
        r = mixing.op4_mixing_sources(spark, f"/root/testdata/{d}").collect()
        n, rate = np.array([x["n_tokens"] for x in r], float), np.array([x["rate"] for x in r])
        p = np.array([[x[c] for c in mixing.DOMAINS] for x in r])
        targets = np.array([mixing.WEIGHTS[c] for c in mixing.DOMAINS]) * n.sum()
        got = (rate * n) @ p
        assert np.abs(got / targets - 1).max() < 0.01
        assert abs(r[0]["residual"] - mixing.residual(got, targets)) < 1e-6 and len({x["residual"] for x in r}) == 1
        now = n @ p
        loss = lambda x: (np.square(x - targets) / now).sum()
        assert loss(got) <= loss(solve(n, p, targets, steps=2000)) + 1e-6 * n.sum()
        assert rate.min() >= 0 and all(np.floor(x["rate"]) <= x["copies"] <= np.ceil(x["rate"]) for x in r)


def test_out_of_reach_is_told(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    r = mixing.mix(docs, labels, multiples={d: 3.0 for d in mixing.DOMAINS}, most=1.0)
    assert abs(r.agg(F.max("residual")).first()[0] - 2 / 3) < 1e-6 and r.where("rate <> 1").count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (7, 1, None), (None, 1, 1), (8, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["rate"] >= 0 and abs(sum(r[d] for d in mixing.DOMAINS) - 1) < 1e-6 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5, 6)} == {0}
    assert mixing.mix(no_docs, labels).count() == 0
    assert mixing.mix(odd_docs, labels.where("doc_id < 0")).count() == len(rows)
