import random

import numpy as np

from swathlake.llm import passages as P

V = [f"word{i}" for i in range(4000)]


def brute_windows(v, least):
    out = []

    def down(l, r):
        if r - l >= least:
            c = l + int(np.argmin(v[l:r]))
            out.append((l, c, r))
            down(l, c)
            down(c + 1, r)

    down(0, len(v))
    return sorted(out)


def test_compact_windows():
    r = np.random.default_rng(0)
    rows = [r.integers(0, k, n).astype(np.uint64) for k, n in ((1 << 60, 400), (5, 60), (1 << 60, 9), (1 << 60, 0), (1 << 60, 10), (2, 300))]
    at = np.cumsum([0] + [len(x) for x in rows])
    rows = [np.left_shift(x + np.uint64(1), np.uint64(24)) if x.max(initial=0) < 1 << 32 else x for x in rows]
    v = np.concatenate(rows)
    got = sorted(zip(*(x.tolist() for x in P.compact_windows(v, at, 10))))
    assert got == sorted((l + a, c + a, q + a) for x, a in zip(rows, at) for l, c, q in brute_windows(x, 10))
    assert P.centres(v, at, 10).tolist() == sorted(c for _, c, _ in got)


def test_windows_that_meet_as_intervals():
    r, n = np.random.default_rng(4), 400
    least = P.LEAST_WORDS - P.SHINGLE + 1
    pair = np.sort(r.integers(0, 5, n))
    at = r.integers(0, 300, n)
    at = at[np.lexsort((at, pair))]
    other_at = np.maximum(at + r.integers(-3, 40, n), 0)
    windows = [np.stack([r.integers(0, 60, n), r.integers(1, 60, n)]) for _ in range(2)]
    h = r.integers(0, P.HASHES, n)
    got = P._agreeing(pair, at, windows[0][0] << 9 | windows[0][1] << 2 | h, other_at, windows[1][0] << 9 | windows[1][1] << 2 | h)

    def meet(x, y):
        for c, (left, right) in zip((at, other_at), windows):
            inside = set.intersection(*(set(range(c[k] - left[k], c[k] + right[k])) for k in (x, y)))
            if len(inside) < least or not {c[x], c[y]} <= inside:
                return False
        return pair[x] == pair[y] and h[x] != h[y]

    assert got.tolist() == [any(meet(x, y) for y in range(n) if y != x) for x in range(n)]
    assert 20 < got.sum() < n - 20


def test_all_rows_at_once_equal_row_by_row():
    r = np.random.default_rng(3)
    rows = []
    for k in range(600):
        a = r.integers(1, 1 << 31, r.integers(5, P.REACH * 2 + P.SHINGLE + 1)).astype(np.uint32)
        b = a.copy()
        for _ in range(int(r.integers(0, 6))):
            b[r.integers(0, len(b))] = 7 + r.integers(0, 3)
        if k % 5 == 0:
            cut = int(r.integers(0, len(b)))
            b = np.concatenate([b[:cut], [np.uint32(5)], b[cut:]])[: P.REACH * 2 + P.SHINGLE].astype(np.uint32)
        if k % 7 == 0:
            b[len(b) * 2 // 3 :] = r.integers(1, 1 << 31, len(b) - len(b) * 2 // 3)
        i = int(r.integers(0, min(P.REACH + 1, len(a), len(b))))
        if len(a) - i <= P.REACH + P.SHINGLE and len(b) - i <= P.REACH + P.SHINGLE:
            rows.append((a, b, i))
    import pyarrow as pa

    at = np.array([i for *_, i in rows])
    got = P.verify_all(*P._around(pa.array([a.tobytes() for a, _, _ in rows], pa.binary()), at), *P._around(pa.array([b.tobytes() for _, b, _ in rows], pa.binary()), at))
    for (a, b, i), g in zip(rows, got):
        assert g == P.verify(a, b, i, i)
    assert sum(g is not None for g in got) > 100


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: [r.choice(V) for _ in range(n)]
    shared, line = [text(n) for n in (52, 60, 80, 150)], text(30)
    docs = {k: text(r.randint(40, 300)) + (line if k % 3 == 0 else []) for k in range(120)}
    planted = {}
    for k in range(0, 60):
        p = shared[k % 4]
        at = r.randrange(len(docs[k]) + 1)
        docs[k] = docs[k][:at] + p + docs[k][at:]
        planted[k] = (at, at + len(p))
    docs[200] = docs[100][:200] + ["other"]
    docs[201] = list(docs[101])
    return {k: " ".join(v) for k, v in docs.items()}, planted


def test_repeated_lines_all_at_once_equal_row_by_row():
    """Rows of few different words, whose shingles repeat within a row: periods, lines said over and over, and words changed in them."""
    g = np.random.default_rng(11)
    side = P.REACH + P.SHINGLE
    a, b = [], []
    for k in range(600):
        line = g.integers(1, 4 if k % 3 else 40, int(g.integers(3, 30))).astype("<u4")
        x = np.resize(line, 2 * side)
        y = np.roll(x, int(g.integers(0, len(line)))) if k % 4 == 0 else x.copy()
        for _ in range(int(g.integers(0, 8))):
            y[g.integers(len(y))] = g.integers(1, 60)
        if k % 5 == 0:
            y[g.integers(0, side) :] = g.integers(100, 200)
        y[P.REACH] = x[P.REACH]
        a.append(x[: 2 * P.REACH + P.SHINGLE]), b.append(y[: 2 * P.REACH + P.SHINGLE])
    a, b, there = np.array(a), np.array(b), np.ones((600, 2 * P.REACH + P.SHINGLE), bool)
    got = P.verify_all(a, there, b, there)
    want = [P.verify(x, y, P.REACH, P.REACH) for x, y in zip(a, b)]
    assert [x is None for x in got] == [x is None for x in want]
    assert 50 < sum(x is None for x in want) < 550


def test_planted_passages_are_found_and_no_others(spark):
    for seed in (1, 2):
        docs, planted = corpus(seed)
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
        rows = P.repeated_passages(df).collect()
        hit = {}
        for x in rows:
            a, b = docs[x["doc_id"]].split()[x["begin"] : x["end"]], docs[x["other_id"]].split()[x["other_begin"] : x["other_begin"] + x["end"] - x["begin"]]
            assert len(a) >= 50 and sum(p == q for p, q in zip(a, b)) >= 0.8 * len(a)
            for d, p, q in ((x["doc_id"], x["begin"], x["end"]), (x["other_id"], x["other_begin"], x["other_begin"] + x["end"] - x["begin"])):
                hit.setdefault(d, []).append((p, q))
        for d, (p, q) in planted.items():
            assert any(a <= p and b >= q for a, b in hit[d]), (d, p, q, hit.get(d))
        assert set(hit) <= set(planted) | {100, 101, 200, 201} and {101, 201} <= set(hit)


def test_near_duplicates(spark):
    r = random.Random(3)
    rows, n, alike = [], 40, []
    for k in range(n):
        p = [r.choice(V) for _ in range(120)]
        q = [w if r.random() > 0.015 else r.choice(V) for w in p]
        x, y = ({tuple(v[i : i + 5]) for i in range(len(v) - 4)} for v in (p, q))
        if len(x & y) >= 0.8 * len(x | y):
            alike.append(k)
        rows += [(2 * k, " ".join([r.choice(V) for _ in range(100)] + p)), (2 * k + 1, " ".join(q + [r.choice(V) for _ in range(100)]))]
    got = {(x["doc_id"], x["other_id"]) for x in P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(alike) > n / 2 and sum((2 * k + 1, 2 * k) in got for k in alike) >= 0.95 * len(alike)
    assert all(a // 2 == b // 2 for a, b in got)


def test_inserted_and_deleted_words(spark):
    r, rows, alike = random.Random(5), [], []
    text = lambda n: [r.choice(V) for _ in range(n)]
    for k in range(60):
        p = text(80 if k % 3 == 0 else 300 if k % 3 == 1 else 120)
        cuts = [40] if k % 3 == 0 else range(45, 300, 45) if k % 3 == 1 else [40, 90]
        q = [w for i, x in enumerate(p) for w in ((*text(1), x) if i in cuts and (k % 3 < 2 or i < 50) else () if i in cuts else (x,))]
        x, y = ({tuple(v[i : i + 5]) for i in range(len(v) - 4)} for v in (p, q))
        assert len(x & y) >= 0.8 * len(x | y)
        alike.append(k)
        rows += [(2 * k, " ".join(text(100) + p)), (2 * k + 1, " ".join(q + text(100)))]
    docs = {k: v.split() for k, v in rows}
    found = P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(x["doc_id"], x["other_id"]) for x in found}
    assert all(a // 2 == b // 2 for a, b in got)
    for kind in range(3):
        mine = [k for k in alike if k % 3 == kind]
        assert sum((2 * k + 1, 2 * k) in got for k in mine) >= 0.95 * len(mine), (kind, len(got))
    for x in found:
        a, b = docs[x["doc_id"]][x["begin"] : x["end"]], docs[x["other_id"]][x["other_begin"] : x["other_end"]]
        g, h = ({tuple(v[i : i + 5]) for i in range(len(v) - 4)} for v in (a, b))
        assert len(a) >= 50 and len(b) >= 50 and len(g & h) >= 0.75 * len(g | h)


def test_hot_line_inside_passages(spark):
    r, rows = random.Random(7), {}
    text = lambda n: [r.choice(V) for _ in range(n)]
    want = []
    for k in range(60):
        line = text((30, 40, 46, 48, 49)[k % 5])
        n = r.randint(max(1, 50 - len(line)), 60 - len(line))
        before = r.randint(0, n)
        passage = text(before) + line + text(n - before)
        base = 10 * k
        rows[base] = text(60) + line + text(60) + (passage if k % 4 == 0 else [])
        for j in (1, 2, 3):
            rows[base + j] = text(50 + j) + passage + text(60)
            want.append(base + j)
    found = P.repeated_passages(spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], "doc_id long, text string")).collect()
    hit = {d for x in found for d in (x["doc_id"], x["other_id"])}
    assert set(want) <= hit, sorted(set(want) - hit)
    assert all(x["doc_id"] // 10 == x["other_id"] // 10 for x in found)
    assert not hit & {10 * k for k in range(60) if k % 4}


def alike(x, y):
    """Whether two texts share a stretch of 50 words or more on one diagonal with a shingle-set similarity of 0.8, ends on equal shingles: every diagonal, every pair of ends."""
    a, b = ([hash(tuple(v[i : i + 5])) for i in range(len(v) - 4)] for v in (x, y))
    where = {}
    for i, v in enumerate(a):
        where.setdefault(v, []).append(i)
    lines = {}
    for j, v in enumerate(b):
        for i in where.get(v, ()):
            lines.setdefault(i - j, []).append(j)
    best = 0.0
    for d, js in lines.items():
        if len(js) < 30:
            continue
        for p in range(len(js)):
            for q in range(len(js) - 1, p, -1):
                n = js[q] - js[p] + 1
                if n < 46:
                    break
                if q - p + 1 >= 0.8 * (2 * n - (q - p + 1)):
                    g, h = set(a[js[p] + d : js[q] + d + 1]), set(b[js[p] : js[q] + 1])
                    best = max(best, len(g & h) / len(g | h))
    return best


def test_equals_all_pairs_of_a_small_corpus(spark):
    """Documents with a passage that another has, by brute force over all pairs, and found: 0.9 or more of those at a similarity of 0.8 to 0.9, all others; and no document besides them."""
    r, rows = random.Random(11), {}
    text = lambda n: [r.choice(V) for _ in range(n)]
    line = text(20)
    for k in range(60):
        p = text(r.randint(55, 200))
        rows[3 * k] = text(30) + p + text(30) + (line if k % 2 else [])
        rows[3 * k + 1] = text(60) + [w if r.random() > (0.02 if k % 2 else 0.03) else r.choice(V) for w in p] + text(10)
        rows[3 * k + 2] = text(90) + line
    ids = sorted(rows)
    want = {}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s = alike(rows[a], rows[b])
            if s >= 0.8:
                want[a], want[b] = max(s, want.get(a, 0)), max(s, want.get(b, 0))
    found = P.repeated_passages(spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], "doc_id long, text string")).collect()
    hit = {d for x in found for d in (x["doc_id"], x["other_id"])}
    near = [d for d, s in want.items() if s < 0.9]
    assert len(near) > 20 and sum(d in hit for d in near) >= 0.9 * len(near), (len(near), sum(d in hit for d in near))
    high = [d for d, s in want.items() if s >= 0.9]
    assert sum(d in hit for d in high) >= 0.97 * len(high), (len(high), sum(d in hit for d in high))
    assert all(a // 3 == b // 3 for a, b in ((x["doc_id"], x["other_id"]) for x in found))


def test_exact_core_does_not_shrink_a_passage(spark):
    r = random.Random(4)
    p = [r.choice(V) for _ in range(110)]
    q = [w if k not in (60, 85, 100) else "changed" for k, w in enumerate(p)]
    rows = [(1, " ".join(["a1"] * 40 + p + ["b1"] * 40)), (2, " ".join(["a2"] * 30 + q + ["b2"] * 40))]
    x = P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(y["doc_id"], y["begin"], y["other_begin"]) for y in x] == [(2, 30, 40)] and 120 <= x[0]["end"] <= 140  # the core ends at 90


def test_repeated_ids_and_word_counts(spark):
    r = random.Random(6)
    p, w = " ".join(r.choice(V) for _ in range(60)), lambda n: " ".join(r.choice(V) for _ in range(n))
    rows = [(1, "a " + w(300) + " " + p), (1, "b " + w(60)), (2, w(400) + " " + p)]
    assert {(x["doc_id"], x["other_id"]) for x in P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(2, 1)}
    rows = [(1, "b " + w(60)), (1, "c " + w(300) + " " + p), (2, w(400) + " " + p)]
    assert P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    t = "\n" + w(49)
    assert P.repeated_passages(spark.createDataFrame([(1, t), (2, t)], "doc_id long, text string")).count() == 0
    t = "\n" + w(50) + "\t"
    assert [(x["begin"], x["end"]) for x in P.repeated_passages(spark.createDataFrame([(1, t), (2, t)], "doc_id long, text string")).collect()] == [(0, 50)]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = P.repeated_passages(odd_docs).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(2, 1), (3, 1)}
    assert P.repeated_passages(no_docs).count() == 0


def test_spent_tables_are_deleted(spark):
    """Tables that only candidates and their verification need are gone when the result is there."""
    import os

    from swathlake.llm import shared

    r = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    common = [r.choice(words) for _ in range(70)]
    rows = [(i, " ".join([r.choice(words) for _ in range(30)] + common + [r.choice(words) for _ in range(30)])) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    where = shared.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(where))
    found = P.repeated_passages(docs).collect()
    assert {x["doc_id"] for x in found} == {1, 2, 3}
    names = {x.rpartition("-")[0] for x in set(os.listdir(where)) - before}
    assert "held" in names and not names & {"shared", "occurrences", "candidates", "anchors", "stretches"}


def test_every_passage_with_a_word_changed_in_its_middle(spark):
    """Passages at the threshold, whose halves have half of the minima each: none is left to chance."""
    r, rows = random.Random(31), {}
    text = lambda n: [r.choice(V) for _ in range(n)]
    for k in range(250):
        p = text(51)
        q = [w if i != 25 else "changed" for i, w in enumerate(p)]
        x, y = ({tuple(v[i : i + 5]) for i in range(len(v) - 4)} for v in (p, q))
        assert len(x & y) >= 0.8 * len(x | y)
        rows[2 * k], rows[2 * k + 1] = text(40) + p + text(60), text(50) + q + text(40)
    found = P.repeated_passages(spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["other_id"]) for x in found} == {(2 * k + 1, 2 * k) for k in range(250)}


def test_pairs_with_a_run_pass_its_ends():
    r = np.random.default_rng(6)
    need, mid, context = P.RUN + P.SHINGLE - 1, P.RUN - 1, P.CONTEXT + P.SHINGLE - 1

    def told(left, right):
        x = r.integers(1, 1 << 32, (2, 2 * P.RUN + P.SHINGLE - 2), dtype=np.uint32)
        x[1, mid - left : mid + right] = x[0, mid - left : mid + right]
        return all(one[0] == one[1] or other[0] == other[1] for one, other in P._run_ends(x, mid))

    for left in range(mid + 1):
        assert all(told(left, right) for right in range(max(need - left, 1), need + 1))
    # nothing but a context in common
    assert not told(0, context + 1) and not told(P.CONTEXT, P.SHINGLE)


def test_repeated_words_are_told_by_their_line():
    """Windows of long runs of single words share few shingles: what is dropped before they are counted is what verify() would not find."""
    r, rows = random.Random(12), []
    for _ in range(120):
        w = [r.randrange(9) for _ in range(5) for _ in [0] * r.randint(8, 60)] + [100 + r.randrange(40) for _ in range(40)]
        at = r.randrange(10, 110)
        w = np.array([7] * (P.REACH + P.SHINGLE + P.REACH), "<u4") if r.random() < 0.1 else np.array(w, "<u4")[at : at + 2 * P.REACH + P.SHINGLE]
        row = np.zeros(2 * P.REACH + P.SHINGLE, "<u4")
        row[: len(w)] = w
        rows.append((row, np.arange(len(row)) < len(w)))
    words, there = (np.stack(x) for x in zip(*rows, strict=True))
    shingles = P._shingled_rows(words, there)
    different = P._sketches(shingles)[2]
    assert different.tolist() == [len(set(x[x > 0].tolist())) for x in shingles]
    i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    i, j = i[i < j], j[i < j]
    for shifted in (True, False):
        got = P.verify_all(words[i], there[i], words[j], there[j], shifted, (shingles, i, j, different))
        assert got == P.verify_all(words[i], there[i], words[j], there[j], shifted)
        for k in range(0, len(i), 9):
            one = P.verify(words[i[k]][there[i[k]]], words[j[k]][there[j[k]]], P.REACH, P.REACH, shifted)
            assert (got[k] is None) == (one is None)
    assert 20 < sum(x is not None for x in got) < len(got) / 2
