import random

import numpy as np
import pyarrow as pa

from swathlake.llm import jaccard
from swathlake.llm.components import components
from swathlake.llm.shared import shingle_hashes, word_hashes

W = np.array([32, *range(9, 14)])


def sets_of(texts, n):
    out = []
    for t in texts:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)})
        for c in W:
            w = w.replace(chr(c), " ")
        w = [x for x in w.split(" ") if x]
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute(rows, n, percent):
    s = sets_of([t for _, t in rows], n)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d if d is not None else -1, len(s[i]), low.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in df.collect())


def chains(seed, families=12):
    """Families of texts that drift, so that links chain and many pairs lie near the threshold."""
    r, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(5000)]
    for _ in range(families):
        t = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 8, 20, 60, 200, 700]))]
        for _ in range(r.choice([1, 2, 12])):
            t = list(t)
            for _ in range(r.randint(0, max(1, len(t) // 60))):
                k = r.randrange(len(t) + 1)
                t[k : k + r.choice([0, 1, 1])] = r.choice([[], [r.choice(vocabulary)], [r.choice(vocabulary).upper()]])
            rows.append((len(rows), " ".join(t)))
    r.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark):
    for seed, n, percent in ((1, 4, 85), (2, 5, 80), (3, 4, 85)):
        rows = chains(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert got(jaccard.classes(df, n, percent)) == brute(rows, n, percent)


def test_links_always_share_a_key():
    r = random.Random(5)
    for percent in (80, 85):
        for _ in range(150):
            n = r.choice([6, 7, 9, 13, 30, 100, 400])
            a = [r.getrandbits(64) for _ in range(n)]
            d = (100 - percent) * n // percent
            drop = r.randint(0, d)
            b = a[: n - drop] + [r.getrandbits(64) for _ in range(max(0, d - drop) // 2)]
            x, y = (np.array(sorted(set(v)), np.uint64) for v in (a, b))
            both = len(set(a) & set(b))
            if 100 * both < percent * len(set(a) | set(b)) or set(a) == set(b):
                continue
            keys, rows = jaccard.pigeonhole_keys(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), percent)
            assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(jaccard.classes(odd_docs)) == brute(rows, 4, 85)
    assert jaccard.classes(no_docs).count() == 0


def test_words_and_shingles():
    texts = [b"One two  three\nfour FIVE", b"", b"a", b" \t ", b"one two three four five"]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    h, _, _, at = word_hashes(data, off)
    assert np.diff(at).tolist() == [5, 0, 1, 0, 5]
    assert h[:5].tolist() == h[-5:].tolist()
    s, s_at = shingle_hashes(h, at, 4)
    assert np.diff(s_at).tolist() == [2, 0, 1, 0, 2] and s[:2].tolist() == s[-2:].tolist()


def test_components(spark):
    r = random.Random(2)
    edges = [(r.getrandbits(62), r.getrandbits(62)) for _ in range(50)]
    nodes = [x for e in edges for x in e]
    edges += [(r.choice(nodes), r.choice(nodes)) for _ in range(60)] + [(nodes[0], x) for x in nodes[:30]]
    label = {n: n for n in nodes}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups, want = {}, {}
    for n in got:
        groups.setdefault(got[n], set()).add(n)
        want.setdefault(label[n], set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_of_many_keys_at_once_equal_brute_force():
    """Rows of different sizes, with and without others, sketches of different lengths; a pair is told at its smallest carried key."""
    r, rows, others, keys, want = random.Random(4), [], [], [], set()
    percent, kind = 80, pa.list_(pa.struct([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("firsts", pa.list_(pa.int64()))]))
    base = {n: np.random.default_rng(n).integers(0, 1 << 63, n, np.uint64) for n in (400, 500, 530, 900, 1100)}

    def member(key):
        n = r.choice(list(base))
        s = np.unique(np.concatenate([base[500][: min(n, 500)], base[n][500:]]) + np.where(np.arange(n) < r.randrange(90), np.uint64(r.randrange(50)), np.uint64(0)))
        return {"node": r.randrange(1 << 40), "root": r.randrange(4), "n": len(s), "sketch": jaccard.bit_sketches(s, np.array([0, len(s)]))[0], "firsts": sorted({key, *(r.randrange(60) for _ in range(2))})[: jaccard.FIRST_KEYS]}

    for k in range(40):
        keys.append(30 + k % 20)
        rows.append([member(keys[-1]) for _ in range(r.choice([0, 1, 2, 9, 40]))])
        others.append([member(keys[-1]) for _ in range(30)] if k % 3 == 0 else None)
        for i, x in enumerate(rows[-1]):
            for y in rows[-1][i + 1 :] if others[-1] is None else others[-1]:
                u, v = jaccard.folded([x["sketch"], y["sketch"]])
                near = jaccard._near(int(np.bitwise_count(u ^ v).sum()), x["n"] + y["n"], percent) and 100 * min(x["n"], y["n"]) >= percent * max(x["n"], y["n"])
                if near and x["root"] != y["root"] and min(set(x["firsts"]) & set(y["firsts"]), default=keys[-1]) >= keys[-1]:
                    want.add((min(x["node"], y["node"]), max(x["node"], y["node"])))
    for block in (jaccard.BLOCK, 7):
        jaccard.BLOCK, before = block, jaccard.BLOCK
        try:
            a, b = jaccard._pairs(pa.array([[], *rows], kind)[1:], pa.array([None, *others], kind)[1:], percent, np.array(keys))
        finally:
            jaccard.BLOCK = before
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want) > 20
