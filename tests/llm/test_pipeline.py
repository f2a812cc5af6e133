"""The pipeline's stages against brute force on the small tables."""


import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as cp

from test_jaccard import brute  # isort: skip
from test_tokens import check_packing  # isort: skip


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    first = cp.language_id(spark, docs, d)
    assert first.columns == columns
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    all_texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(kept) >= 0.97 * len(all_texts)
    rows = sorted(kept.items())
    want = {i for i, _, c in brute(rows, 5, 80) if i == c}
    second = cp.near_duplicates(spark, first, d)
    assert second.columns == columns and {r["doc_id"] for r in second.collect()} == want
    third = cp.secret_scan(spark, second, d)
    assert third.columns == columns
    for r in third.collect():
        assert r["n_chars"] == len(r["text"]) and 'token = "' not in r["text"].replace('token = "[', "")
    fourth = cp.mixing_sources(spark, third, d)
    clean, _, after = decided(spark, d, third, fourth)
    assert fourth.columns == columns and len(clean & after) >= 0.97 * len(clean)
    texts = {r["doc_id"]: r["text"] for r in fourth.collect()}
    used, least = check_packing(cp.best_fit_packing(spark, fourth, d).collect(), texts)
    assert used <= least * 1.01 + 1


def decided(spark, d, before, after):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    before, after = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (before, after))
    return {i for i in before if toxic.get(i) == 0}, {i for i in before if toxic.get(i) == 1}, after


def test_mixing_drops_toxic_and_keeps_clean(spark):
    """On the table of 10 000 documents: the 51 toxic labels of the smaller one are too few to learn from."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean, bad, after = decided(spark, d, docs, cp.mixing_sources(spark, docs, d))
    assert len(clean & after) >= 0.97 * len(clean) and len(bad & after) <= 0.3 * len(bad)


def test_run(spark, sf):
    assert cp.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_odd_rows(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), no_docs.select("doc_id", "text", "lang", "source", "n_chars"), odd_docs):
        for _, stage in cp.STAGES[:-1]:
            columns = docs.columns
            docs = stage(spark, docs, sf)
            assert docs.columns == columns
            docs.count()
        cp.STAGES[-1][1](spark, docs, sf).count()


