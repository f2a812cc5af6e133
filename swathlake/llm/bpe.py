"""Byte-level BPE by ranks: encoding in two tiers, and decoding.

A pre-token that is in the vocabulary as a whole is its rank: a minimal perfect hash over the vocabulary gives the one
slot where it can be, for all pre-tokens of a slice at once, and its bytes are compared there. The others are merged:
bytes form a linked list, and a heap holds the ranks of neighbouring parts, least first and leftmost among equal ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import _power_tables, _ranges, mix, slices
from .tokens import vocabulary_path

RANKS = "byte_bpe_50k.tiktoken"
#: Keys of a bucket of the perfect hash, on average.
LOAD = 3
#: Pre-tokens taken at once, bytes of a text beyond which its parts are written one after another, and merged pre-tokens that a task keeps with the longest of them.
PIECES, LONG, KEPT, KEPT_BYTES = 250_000, 1_000_000, 500_000, 64


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of data, all at once: differences of a running polynomial, and the lengths."""
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=c[1:])
        h = (c[ends] - c[starts]) * down[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def _slots(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h + displacement * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(n)).astype(np.int64)


def _buckets(h: np.ndarray, count: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(count)).astype(np.int64)


def displacements(h: np.ndarray) -> np.ndarray:
    """A minimal perfect hash of different 64-bit keys, by hash and displace: for each bucket the displacement that puts its keys into free slots of as many as there are keys; -1 - slot for a bucket of one key."""
    n = len(h)
    if len(np.unique(h)) != n:
        raise ValueError("two tokens have one hash")
    count = max(1, n // LOAD)
    bucket = _buckets(h, count)
    order, size = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=count)
    at = np.concatenate([[0], np.cumsum(size)])
    free, out = np.ones(n, bool), np.zeros(count, np.int64)
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        keys, base, tries = h[order[at[b] : at[b + 1]]], 0, 32
        while True:
            s = np.sort(_slots(keys[:, None], np.arange(base, base + tries, dtype=np.uint64)[None, :], n), axis=0)
            ok = free[s].all(0) & (s[1:] != s[:-1]).all(0)
            if ok.any():
                k = int(ok.argmax())
                out[b] = base + k
                free[s[:, k]] = False
                break
            base, tries = base + tries, min(2 * tries, 8192)
    single = np.flatnonzero(size == 1)
    out[single] = -1 - np.flatnonzero(free)
    return out


class Vocabulary:
    """Tokens by rank, as one run of bytes with offsets, and the perfect hash over them. Its size is the vocabulary's."""

    def __init__(self, tokens: dict[bytes, int]):
        if any(bytes([b]) not in tokens for b in range(256)):
            raise ValueError("every single byte must have a rank")
        names = list(tokens)
        self.ids = np.fromiter(tokens.values(), np.int64, len(names))
        self.data = np.frombuffer(b"".join(names), np.uint8)
        self.ends = np.cumsum([len(x) for x in names])
        self.starts = np.concatenate([[0], self.ends[:-1]])
        h = hashes(self.data, self.starts, self.ends)
        self.displacement = displacements(h)
        self.at = np.zeros(len(names), np.int64)  # slot -> token
        self.at[self._slot(h)] = np.arange(len(names))
        self.row = np.full(self.ids.max() + 1, -1)  # id -> token
        self.row[self.ids] = np.arange(len(names))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, f) if t})

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ranks", "names")}

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        raw = self.data.tobytes()
        return {raw[s:e]: i for s, e, i in zip(self.starts.tolist(), self.ends.tolist(), self.ids.tolist(), strict=True)}

    @cached_property
    def names(self) -> list[bytes]:
        """Each id in decimal."""
        return [b"%d" % i for i in range(len(self.row))]

    def _slot(self, h: np.ndarray) -> np.ndarray:
        d = self.displacement[_buckets(h, len(self.displacement))]
        return np.where(d < 0, -1 - d, _slots(h, d.astype(np.uint64), len(self.ids)))

    def whole(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The id of each span that is a token as a whole, else -1."""
        token = self.at[self._slot(hashes(data, starts, ends))]
        n = ends - starts
        same = np.flatnonzero(n == self.ends[token] - self.starts[token])
        out = np.full(len(starts), -1)
        for k in np.unique(n[same]):
            these, step = same[n[same] == k], np.arange(k)
            for part in np.array_split(these, max(1, len(these) * int(k) // 4_000_000)):
                equal = (data[starts[part, None] + step] == self.data[self.starts[token[part], None] + step]).all(1)
                out[part[equal]] = self.ids[token[part[equal]]]
        return out

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token by merging neighbouring parts, the least rank first and leftmost among equal ones."""
        ranks, n = self.ranks, len(piece)
        if n == 1:
            return [ranks[piece]]
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\x01") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            middle = end[i]
            if not alive[i] or middle >= n or end[middle] != stop:
                continue  # one of the two parts has been merged since
            end[i], alive[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            p = before[i]
            if p >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after another, and n + 1 offsets."""
        t = self.row[ids]
        if len(t) and t.min() < 0:
            raise ValueError("an id is not in the vocabulary")
        n = self.ends[t] - self.starts[t]
        return self.data[_ranges(self.starts[t], n)], np.concatenate([[0], np.cumsum(n)])


class Encoder:
    """Encodes lists of pre-tokens; a task's merged pre-tokens are kept, within a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.kept = vocabulary, {}

    def encode(self, pieces: list[str], text: str) -> tuple[np.ndarray, np.ndarray]:
        """ids of the pieces, which one after another are the text, and n + 1 offsets of each piece's."""
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
        at = chars if len(raw) == len(text) else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(raw))[chars]
        whole = self.vocabulary.whole(data, at[:-1], at[1:])
        missed = np.flatnonzero(whole < 0)
        more, counts = [], np.ones(len(pieces), np.int64)
        for i, s, e in zip(missed.tolist(), at[missed].tolist(), at[missed + 1].tolist(), strict=True):
            piece = raw[s:e]
            ids = self.kept.get(piece)
            if ids is None:
                ids = self.vocabulary.merged(piece)
                if len(piece) <= KEPT_BYTES:
                    self.kept[piece] = ids
            counts[i] = len(ids)
            more += ids
        if len(self.kept) > KEPT:
            self.kept.clear()
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(offsets[-1], np.int64)
        out[offsets[:-1][whole >= 0]] = whole[whole >= 0]
        out[_ranges(offsets[missed], counts[missed])] = more
        return out, offsets


class _Digest:
    """n_tokens, sha256 of the ids in decimal and of the decoded bytes, of a text whose ids come in parts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.n, self.ids, self.bytes = vocabulary, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, decoded) -> None:
        if len(ids):
            names = self.vocabulary.names
            self.ids.update((b" " if self.n else b"") + b" ".join([names[i] for i in ids.tolist()]))
            self.bytes.update(decoded)
            self.n += len(ids)

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.bytes.hexdigest()


def encoded(texts: list[str], encoder: Encoder, pattern) -> Iterator[tuple[int, np.ndarray, bytes | memoryview]]:
    """(number of the text, ids, their bytes): a part a text, or one after another for long texts."""
    v = encoder.vocabulary
    short = [i for i, t in enumerate(texts) if 0 < len(t) <= LONG]
    found = [pattern.findall(texts[i]) for i in short]
    if short:
        ids, at = encoder.encode([p for f in found for p in f], "".join([texts[i] for i in short]))
        raw, to = v.decode(ids)
        raw, ends = raw.tobytes(), at[np.cumsum([0] + [len(f) for f in found])]
        for i, a, b in zip(short, ends.tolist(), ends[1:].tolist(), strict=False):
            yield i, ids[a:b], memoryview(raw)[to[a] : to[b]]
    for i, t in enumerate(texts):
        if len(t) > LONG:
            pieces = (m.group() for m in pattern.finditer(t))
            while some := list(islice(pieces, PIECES)):
                ids, _ = encoder.encode(some, "".join(some))
                yield i, ids, v.decode(ids)[0].tobytes()


def encode_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: the whole text's ids, and the bytes decoded from them.

    ranks: a file of tokens in base64 and their ranks; pattern: a regular expression whose matches are encoded
    separately, and which must match every character. Null text is empty: no ids, and digests of nothing. Ids of any
    type, null and repeated ones stay as they are; other columns are not read. A text of more than LONG characters is
    encoded in parts of PIECES pre-tokens, so memory doesn't grow with it, but for a single pre-token without an end.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(ranks))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled, encoder = regex.compile(pattern), Encoder(vocabulary.value)
        for b in slices(batches, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            digests = [_Digest(vocabulary.value) for _ in texts]
            for i, ids, raw in encoded(texts, encoder, compiled):
                digests[i].add(ids, raw)
            n, ids, raw = zip(*[d.row() for d in digests], strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text encoded and decoded by the ranks of the public vocabulary."""
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary_path(RANKS), public_tokenizers.PATTERN)
