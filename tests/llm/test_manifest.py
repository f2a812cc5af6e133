import hashlib
import zlib

import duckdb
import pytest

from swathlake.llm import manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def lower(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def grow(hashes):
    """The root of a list of hashes, and of each its [(siblings before, siblings after)] from the bottom to the top."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for path, i in zip(paths, at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            path.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees.append((own, *grow([leaf(r, r["text"]) for r in own])))
    root, high = grow([t[1] for t in trees])
    out = []
    for (own, sub, paths), top in zip(trees, high):
        for r, path in zip(own, paths):
            at = leaf(r, r["text"])
            fold = leaf(r, lower(r["text"])) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 else at
            for a, b in path + top:
                fold = sha(a + fold + b)
            out.append((r["doc_id"], at, sub, root, sha("".join(a + b for a, b in path + top)), fold, fold == root))
    return sorted(out, key=repr)


def ours(df):
    return sorted(map(tuple, df.collect()), key=repr)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def test_every_table_equals_brute_force_and_sql(spark, sf):
    df = manifest.op11_merkle_manifest(spark, sf)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = ours(df)
    assert got == brute(spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert 0 < sum(not r[-1] for r in got) < len(got)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(c.execute(manifest.ORACLE).fetchall(), key=repr) == got


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513, 600])
def test_sizes_of_trees(spark, n):
    df = docs(spark, [(i * 7 % 1000, "s", "en", i, f"Text {i}") for i in range(n)] + [(5000, None, None, None, None)]).repartition(3)
    assert ours(manifest.manifest(df)) == brute(df.collect())


def test_one_group_is_the_root(spark):
    df = docs(spark, [(i, "s", "en", i, f"Text {i}") for i in range(9)])
    got = ours(manifest.manifest(df))
    assert got == brute(df.collect()) and all(r[2] == r[3] for r in got)
    one = docs(spark, [(3, "s", None, 1, "A")])
    assert ours(manifest.manifest(one)) == brute(one.collect())


def test_many_groups_and_copies(spark):
    rows = [(i % 50, "s", f"l{i % 70}é" if i % 70 else "", i % 3, f"Größe A {i % 4}") for i in range(900)] + [(7, "s", "hot", 1, "X")] * 300
    df = docs(spark, rows).repartition(4)
    assert ours(manifest.manifest(df)) == brute(df.collect())


def test_odd_rows(spark, odd_docs, no_docs):
    assert ours(manifest.manifest(odd_docs)) == brute(odd_docs.collect())
    assert ours(manifest.manifest(no_docs)) == []
    named = odd_docs.withColumnsRenamed({"node": "tree", "key": "hash", "score": "leaf"})
    assert ours(manifest.manifest(named)) == brute(odd_docs.collect())


def test_a_changed_row_moves_the_root(spark, odd_docs):
    from pyspark.sql import functions as F

    roots = lambda d: {r["root"] for r in manifest.manifest(d).collect()}
    a, b = roots(odd_docs), roots(odd_docs.withColumn("text", F.when(F.col("doc_id") == 8, "Two words").otherwise(F.col("text"))))
    assert len(a) == len(b) == 1 and a != b
