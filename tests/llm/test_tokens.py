import zlib

import numpy as np
import pytest

from swathlake.llm import codec, packing, tokens

TEXTS = ["Hello world", "", None, "  two  blanks \n\n x", "don't we'LL 'tis 12ab ½ ²", "naïve café ☕ 中文 \x1c x", "a" * 3000, "<|endoftext|> as text", "\x85 \xa0 nbsp", "ÀÖß×÷µª", "tab\t\ttab\r\n", "'s's 't"]


def library(texts):
    enc = tokens.encoder(tokens.vocabulary_path()).library
    return [enc.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids_equal_the_library():
    ids, off = tokens.Encoder(tokens.vocabulary_path()).encode(TEXTS)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == library(TEXTS)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", 5)
    e = tokens.Encoder(tokens.vocabulary_path())
    for k in range(20):
        texts = [f"word{k} other{k} " + "z" * 60, "same words here"]
        ids, off = e.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == library(texts)
        assert len(e.pieces) <= 5


def test_blocks_round_trip():
    r = np.random.default_rng(0)
    for ids in (np.array([5]), np.zeros(1000), r.integers(0, 700, 5000), np.tile(r.integers(0, 700, 50), 60), r.zipf(1.3, 3000) % 700, np.arange(257), np.full(300, 699)):
        block = codec.encode_block(ids.astype(np.uint32), 700)
        h, p = block[: codec.HEADER.size], block[codec.HEADER.size :]
        assert codec.decode_block(h, p).tolist() == ids.astype(int).tolist()
    assert len(codec.encode_block(np.tile(np.arange(50), 400).astype(np.uint32), 700)) < 20_000  # 16 bits an id would be 40 000
    with pytest.raises(OSError):
        codec.decode_block(h, p[:-1] + bytes([p[-1] ^ 1]))


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for (d, _), ids in zip(rows, library([t for _, t in rows])):
        raw = np.array([*ids, 0], "<u4").tobytes()
        out.append((d, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    return out


def test_token_files(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, codec.op10_token_ids(spark, d).collect())) == sorted(brute(rows))


def test_token_files_of_many_blocks(spark, monkeypatch):
    rows = [(k, f"text {k % 7} " * (k % 50)) for k in range(300, 0, -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(codec, "BLOCK_IDS", 1 << 10)
    assert sorted(map(tuple, codec.read_ids(codec.write_ids(df, tokens.vocabulary_path())).collect())) == sorted(brute(rows))


def test_odd_rows_in_files(odd_docs, no_docs):
    got = [tuple(r) for r in codec.read_ids(codec.write_ids(odd_docs, tokens.vocabulary_path())).collect()]
    want = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    key = lambda r: (r[1], r[2])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert codec.read_ids(codec.write_ids(no_docs, tokens.vocabulary_path())).count() == 0


def check_packing(rows, texts, capacity=2048):
    ids = {d: np.array([*x, 0], "<u4") for d, x in zip(texts, library(list(texts.values())))}
    seen, bins = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        seen.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, x in ids.items():
        assert [(s, n) for _, s, n in sorted(seen[d])] == packing.cut(len(x), capacity)
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), -(-sum(map(len, ids.values())) // capacity)


def test_packing(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    used, least = check_packing(packing.op8_best_fit_packing(spark, d).collect(), texts)
    assert used <= least * 1.01 + 1


def test_packing_odd_rows(spark, odd_docs, no_docs):
    from swathlake.llm.shared import written

    rows = packing.pack(written(packing.pieces(odd_docs.where("doc_id is not null"), tokens.vocabulary_path()), "p")).collect()
    once = {(r["doc_id"], r["piece"]): r for r in rows}
    check = [r for r in once.values() if r["doc_id"] != 2]
    assert len(rows) == len(once) + 1 and {r["doc_id"] for r in check} == {1, 3, 4, 5, 6, 7, 8, 9, 10, 11}
    spots = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spots, spots[1:]))
    assert packing.pack(written(packing.pieces(odd_docs, tokens.vocabulary_path()), "p")).count() == len(rows) + 1
    assert packing.pack(written(packing.pieces(no_docs, tokens.vocabulary_path()), "p")).count() == 0


def test_plan_uses_every_piece_once():
    r = np.random.default_rng(1)
    for top in (5, 300, 2048):
        counts = {int(n): int(r.integers(1, 50)) for n in np.unique(r.integers(1, top + 1, 200))}
        used = {}
        for pattern, times in packing.plan(counts):
            assert sum(pattern) <= 2048 and times > 0
            for n in pattern:
                used[n] = used.get(n, 0) + times
        assert used == counts
    assert packing.plan({2000: 3, 40: 3, 8: 3}) == [([2000, 40, 8], 3)]
    assert packing.plan({1024: 5}) == [([1024, 1024], 2), ([1024], 1)]


def test_a_table_finds_what_a_search_finds():
    m, r = codec.Model(700), np.random.default_rng(2)
    zero = np.zeros(50, np.int64)
    for _ in range(3):
        v = r.integers(0, 1 << codec.ORDER0_BITS, 4000)
        assert (m.at0(v) == np.searchsorted(m.low0, v, "right") - 1).all()
        ids = r.zipf(1.3, 50) % 700
        m.predict(zero, zero)
        m.learn(ids, m.which(ids))
