import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from swathlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def expected(library, rows):
    return sorted(((r["doc_id"], *digests(library, r["text"])) for r in rows), key=repr)


def ours(vocabulary, texts):
    out = [[] for _ in texts]
    for i, ids, raw in bpe.encoded(texts, bpe.Encoder(vocabulary), regex.compile(public_tokenizers.PATTERN)):
        out[i] += ids.tolist()
        assert bytes(raw) == b"".join(vocabulary.data[vocabulary.starts[t] : vocabulary.ends[t]].tobytes() for t in vocabulary.row[ids])
    return out


def test_the_hash_is_minimal_and_perfect(vocabulary):
    slots = vocabulary._slot(bpe.hashes(vocabulary.data, vocabulary.starts, vocabulary.ends))
    assert sorted(slots.tolist()) == list(range(len(vocabulary.ids)))
    assert (vocabulary.whole(vocabulary.data, vocabulary.starts, vocabulary.ends) == vocabulary.ids).all()


def test_every_table_equals_the_library(spark, sf, library):
    df = bpe.op13_byte_level_bpe(spark, sf)
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, df.collect()), key=repr) == expected(library, spark.read.parquet(f"{sf}/documents.parquet").collect())


def test_odd_rows(spark, odd_docs, no_docs, library, monkeypatch):
    want = expected(library, odd_docs.collect())
    run = lambda d: sorted(map(tuple, bpe.encode_decode(d, PATH, public_tokenizers.PATTERN).collect()), key=repr)
    assert run(odd_docs) == want and run(no_docs) == []
    named = odd_docs.selectExpr("cast(doc_id as string) as doc_id", "text", "1 as n_tokens", "'x' as ids")
    assert run(named) == expected(library, named.collect())


def test_long_texts_in_parts(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 50)
    monkeypatch.setattr(bpe, "PIECES", 7)
    texts = ["", "Überraschung 1234 — naïve   déjà-vu  " * 40, "x" * 400, "short one", "\n\n   \t " * 30, "don't we'll I'd"]
    assert ours(vocabulary, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_pieces_and_ties(vocabulary, library):
    r = np.random.default_rng(0)
    texts = ["a" * 5001, "ab" * 3000, "".join(map(chr, r.integers(97, 101, 20000))), "".join(map(chr, r.integers(0x4E00, 0x9FFF, 3000))), "é" * 999, "\U0001f600" * 300, "=" * 3000, " " * 2000]
    assert ours(vocabulary, texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeinrst '\t\n0129.-é")), max_size=60), max_size=5))
def test_any_text(texts):
    v = test_any_text.__dict__.setdefault("v", None) or bpe.Vocabulary.load(PATH)
    test_any_text.v = v
    lib = test_any_text.__dict__.get("lib")
    if lib is None:
        lib = test_any_text.lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    assert ours(v, texts) == [lib.encode_ordinary(t) for t in texts]


def test_small_vocabularies():
    tokens = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 299, b"abc": 298, b"aa": 310}
    v = bpe.Vocabulary(tokens)
    assert v.merged(b"abcaaab") == [298, 310, 300]  # bc before ab, then a and bc; ab before aa
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})
    with pytest.raises(ValueError):
        v.decode(np.array([257]))
