"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A block's ids are dealt into lanes of STEPS ids, coded side by side with one model that is reset at the block's begin and
learns after every step from all lanes. Predictions of order 2 and order 1 are the ids last seen after the two ids or
the one id before; order 0 is the table of id counts. Counts by both predictions' confidence mix the three; a range coder
with 64-bit bounds codes which of them holds, and an id that neither predicts by its order-0 frequency.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, slices, written
from .tokens import END_ID, encoder, vocabulary_path, with_end

STEPS, BLOCK_IDS = 128, 1 << 20
MIX_BITS, ORDER0_BITS, TABLE2_BITS, CONFIDENCE = 16, 20, 18, 15
HEADER = struct.Struct("<4sIIIIII")
FOOTER = struct.Struct("<4sQQI")
_U = np.uint64
TOP, BOTTOM = _U(1 << 48), _U(1 << 32)
#: A prediction's next confidence by the one it has, where it failed and where it held.
_SURE = np.array([[c // 2 if c else 1 for c in range(CONFIDENCE + 1)], [min(c + 1, CONFIDENCE) for c in range(CONFIDENCE + 1)]], np.int8).reshape(-1)


class Model:
    """Predictions of orders 0 to 2 for all lanes of a block. Every change depends on coded ids alone, so a reader repeats it."""

    def __init__(self, size: int):
        self.size, self.step = size, 0
        self.id1, self.sure1 = np.zeros(size, np.int32), np.zeros(size, np.int8)
        self.id2, self.sure2 = np.zeros(1 << TABLE2_BITS, np.int32), np.zeros(1 << TABLE2_BITS, np.int8)
        self.mix = np.ones((CONFIDENCE + 1) ** 2 * 3, np.int64)
        self.counts = np.zeros(size, np.int64)
        self._order0()

    def _order0(self) -> None:
        free = (1 << ORDER0_BITS) - self.size
        freq = 1 + self.counts * free // max(int(self.counts.sum()), 1)
        freq[0] += (1 << ORDER0_BITS) - int(freq.sum())
        self.low0 = np.concatenate([[0], np.cumsum(freq)]).astype(np.int64)
        self.freq0, self.of0 = freq, None

    def at0(self, values: np.ndarray) -> np.ndarray:
        """The ids whose order-0 ranges hold the values; a table that is made when first asked for."""
        if self.of0 is None:
            self.of0 = np.repeat(np.arange(self.size, dtype=np.int32), self.freq0)
        return self.of0[np.minimum(values, (1 << ORDER0_BITS) - 1)].astype(np.int64)

    def predict(self, before2: np.ndarray, before1: np.ndarray) -> None:
        self.at1 = before1
        self.at2 = ((before2 * 0x9E3779B1 + before1 * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - TABLE2_BITS)
        self.guess1, self.guess2 = self.id1[self.at1], self.id2[self.at2]
        self.was1, self.was2 = self.sure1[self.at1], self.sure2[self.at2]
        self.context = (self.was2.astype(np.int64) * (CONFIDENCE + 1) + self.was1) * 3
        w = self.mix.reshape(-1, 3)
        share = ((1 << MIX_BITS) - 3) * w // w.sum(1, keepdims=True) + 1
        share[:, 2] += (1 << MIX_BITS) - share.sum(1)
        self.mix_freq = share.reshape(-1).astype(_U)
        self.mix_low = np.stack([np.zeros(len(share), np.int64), share[:, 0], share[:, 0] + share[:, 1]], 1).reshape(-1).astype(_U)

    def which(self, ids: np.ndarray) -> np.ndarray:
        """0: the order-2 prediction holds, 1: the order-1 prediction, 2: neither."""
        return np.where(ids == self.guess2, 0, np.where(ids == self.guess1, 1, 2))

    def learn(self, ids: np.ndarray, which: np.ndarray) -> None:
        self.mix += 8 * np.bincount(self.context + which, minlength=len(self.mix))
        if self.mix.max() > 1 << 24:
            self.mix = (self.mix + 1) // 2
        np.add.at(self.counts, ids, 1)
        for at, guess, s, sure, table in ((self.at1, self.guess1, self.was1, self.sure1, self.id1), (self.at2, self.guess2, self.was2, self.sure2, self.id2)):
            new = np.flatnonzero(s == 0)  # a prediction that has no confidence left is replaced
            table[at[new]] = ids[new]
            sure[at] = _SURE[(guess == ids) * np.int8(CONFIDENCE + 1) + s]
        self.step += 1
        if self.step <= 8 or self.step % 8 == 0:
            self._order0()


def _deal(ids: np.ndarray) -> tuple[np.ndarray, int]:
    lanes = max(1, -(-len(ids) // STEPS))
    x = np.zeros(lanes * STEPS, np.int64)
    x[: len(ids)] = ids
    return np.ascontiguousarray(x.reshape(lanes, STEPS).T), lanes


def encode_block(ids: np.ndarray, size: int) -> bytes:
    """One block; ids below `size`, BLOCK_IDS at most, one at least."""
    x, lanes = _deal(ids)
    low, rng = np.zeros(lanes, _U), np.full(lanes, ~_U(0), _U)
    model, zero = Model(size), np.zeros(lanes, np.int64)
    who: list[np.ndarray] = []
    what: list[np.ndarray] = []

    def settle(lo: np.ndarray, r: np.ndarray, lane: np.ndarray) -> None:
        out = np.arange(len(lo))
        while True:
            x, y = lo[out], r[out]
            done = (x ^ (x + y)) < TOP
            small = ~done & (y < BOTTOM)
            s = out[small]
            out = out[done | small]  # only these may have more to settle
            if not len(out):
                return
            r[s] = (_U(0) - lo[s]) & (BOTTOM - _U(1))
            who.append(lane[out])
            what.append((lo[out] >> _U(48)).astype("<u2"))
            lo[out] <<= _U(16)
            r[out] <<= _U(16)

    every = np.arange(lanes, dtype=np.uint16 if lanes <= 1 << 16 else np.int32)  # short numbers are sorted faster
    with np.errstate(over="ignore"):
        for t in range(STEPS):
            model.predict(x[t - 2] if t > 1 else zero, x[t - 1] if t else zero)
            which = model.which(x[t])
            k = model.context + which
            rng >>= _U(MIX_BITS)
            low += model.mix_low[k] * rng
            rng *= model.mix_freq[k]
            settle(low, rng, every)
            miss = np.flatnonzero(which == 2)
            if len(miss):
                v = x[t][miss]
                lo, r = low[miss], rng[miss] >> _U(ORDER0_BITS)
                a = model.low0[v]
                lo += a.astype(_U) * r
                r *= (model.low0[v + 1] - a).astype(_U)
                settle(lo, r, every[miss])
                low[miss], rng[miss] = lo, r
            model.learn(x[t], which)
        last = (low + (BOTTOM - _U(1))) >> _U(32)
    for shift in (16, 0):
        who.append(every)
        what.append(((last >> _U(shift)) & _U(0xFFFF)).astype("<u2"))
    lane, word = np.concatenate(who), np.concatenate(what)
    payload = np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + word[np.argsort(lane, kind="stable")].tobytes()
    raw = ids.astype("<u4").tobytes()
    return HEADER.pack(b"TCM1", len(ids), lanes, size, len(payload), zlib.crc32(raw), zlib.crc32(payload)) + payload


def decode_block(header: bytes, payload: bytes) -> np.ndarray:
    """The ids of a block; raises where a checksum is wrong."""
    magic, n, lanes, size, length, crc, payload_crc = HEADER.unpack(header)
    if magic != b"TCM1" or len(payload) != length or zlib.crc32(payload) != payload_crc:
        raise OSError("a token block fails its checksum")
    count = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(payload, "<u2", offset=4 * lanes), np.zeros(4, "<u2")]).astype(_U)
    end = np.cumsum(count)
    at = end - count
    none = len(words) - 1

    def word(lane: np.ndarray | slice) -> np.ndarray:
        p = at[lane]
        out = words[np.where(p < end[lane], p, none)]
        at[lane] = p + 1
        return out

    low, rng, code = np.zeros(lanes, _U), np.full(lanes, ~_U(0), _U), np.zeros(lanes, _U)
    every = np.arange(lanes)
    for _ in range(4):
        code = (code << _U(16)) | word(every)
    model, zero = Model(size), np.zeros(lanes, np.int64)
    x = np.zeros((STEPS, lanes), np.int64)

    def settle(lo: np.ndarray, r: np.ndarray, c: np.ndarray, lane: np.ndarray) -> None:
        out = np.arange(len(lo))
        while True:
            x, y = lo[out], r[out]
            done = (x ^ (x + y)) < TOP
            small = ~done & (y < BOTTOM)
            s = out[small]
            out = out[done | small]
            if not len(out):
                return
            r[s] = (_U(0) - lo[s]) & (BOTTOM - _U(1))
            c[out] = (c[out] << _U(16)) | word(lane[out])
            lo[out] <<= _U(16)
            r[out] <<= _U(16)

    with np.errstate(over="ignore"):
        for t in range(STEPS):
            model.predict(x[t - 2] if t > 1 else zero, x[t - 1] if t else zero)
            rng >>= _U(MIX_BITS)
            value = (code - low) // rng
            k0 = model.context
            which = (value >= model.mix_low[k0 + 1]).astype(np.int64) + (value >= model.mix_low[k0 + 2])
            k = k0 + which
            low += model.mix_low[k] * rng
            rng *= model.mix_freq[k]
            settle(low, rng, code, every)
            ids = np.where(which == 0, model.guess2, model.guess1).astype(np.int64)
            miss = np.flatnonzero(which == 2)
            if len(miss):
                lo, r, c = low[miss], rng[miss] >> _U(ORDER0_BITS), code[miss]
                v = model.at0(((c - lo) // r).astype(np.int64))
                a = model.low0[v]
                lo += a.astype(_U) * r
                r *= (model.low0[v + 1] - a).astype(_U)
                settle(lo, r, c, miss)
                low[miss], rng[miss], code[miss] = lo, r, c
                ids[miss] = v
            x[t] = ids
            model.learn(ids, which)
    out = x.T.reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise OSError("decoded ids fail their checksum")
    return out


class TokenFile:
    """A file of blocks, then an index of (document, ids) in the order written, then a footer."""

    def __init__(self, folder: str, size: int):
        system, path = fs.FileSystem.from_uri(folder)
        name = f"{uuid.uuid4().hex}.tcm"
        self.path, self.size, self.out = f"{folder}/{name}", size, system.open_output_stream(f"{path}/{name}")
        self.held: list[np.ndarray] = []
        self.ids = self.waiting = self.bytes = 0
        self.docs: list[int | None] = []
        self.lengths: list[np.ndarray] = []

    def add(self, docs: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs += docs
        self.lengths.append(lengths)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            self._write(False)

    def _write(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) if all_of_it else len(ids) // BLOCK_IDS * BLOCK_IDS
        for at in range(0, whole, BLOCK_IDS):
            block = encode_block(ids[at : min(at + BLOCK_IDS, whole)], self.size)
            self.out.write(block)
            self.bytes += len(block)
        self.ids += whole
        self.held, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[str, int, int, int]:
        self._write(True)
        named = np.array([x is not None for x in self.docs], np.uint8)
        index = np.array([x or 0 for x in self.docs], "<i8").tobytes() + named.tobytes() + np.concatenate([*self.lengths, np.zeros(0, np.int64)]).astype("<u8").tobytes()
        self.out.write(index + FOOTER.pack(b"TCMX", len(self.docs), self.bytes, zlib.crc32(index)))
        self.out.close()
        return self.path, self.ids, len(self.docs), self.bytes


def read_file(path: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(documents, ids, lengths) of a file, some documents at a time."""
    system, where = fs.FileSystem.from_uri(path)
    with system.open_input_file(where) as f:
        size = f.size()
        magic, n, blocks, crc = FOOTER.unpack(f.read_at(FOOTER.size, size - FOOTER.size))
        index = f.read_at(size - FOOTER.size - blocks, blocks)
        if magic != b"TCMX" or zlib.crc32(index) != crc:
            raise OSError(f"{path}: the index fails its checksum")
        docs = np.frombuffer(index, "<i8", n)
        named = np.frombuffer(index, np.uint8, n, 8 * n)
        ends = np.cumsum(np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64))
        at, doc, first, held = 0, 0, 0, np.zeros(0, np.uint32)
        while at < blocks:
            header = f.read_at(HEADER.size, at)
            length = HEADER.unpack(header)[4]
            held = np.concatenate([held, decode_block(header, f.read_at(length, at + HEADER.size))])
            at += HEADER.size + length
            to = int(np.searchsorted(ends, first + len(held), "right"))
            if to > doc:
                used = int(ends[to - 1]) - first
                yield [int(d) if k else None for d, k in zip(docs[doc:to], named[doc:to], strict=True)], held[:used], np.diff(ends[doc:to], prepend=first)
                held, doc, first = held[used:], to, first + used


def write_ids(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every document's ids with the end id, in ascending id order over all files; the written manifest (part, file, ids, docs, bytes, base).

    Documents are dealt by ranges of the id, so that files follow one another; ties are broken by the text's hash and
    the row's place, so repeated rows spread. base: ids in the files before. Only files of tasks that succeeded are listed.
    """
    folder = new_path(docs.sparkSession, "token-files")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, file = encoder(vocabulary), None
        for b in slices(batches, "text"):
            file = file or TokenFile(folder, enc.size)
            ids, off = with_end(*enc.encode(b.column("text").to_pylist()), END_ID)
            file.add(b.column("doc_id").to_pylist(), ids, np.diff(off))
        if file:
            p, ids, n, size = file.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "file": [p], "ids": [ids], "docs": [n], "bytes": [size]}, pa.schema([("part", pa.int64()), ("file", pa.string()), ("ids", pa.int64()), ("docs", pa.int64()), ("bytes", pa.int64())]))

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", "h", "place"]
    d = d.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = written(d.mapInArrow(store, "part long, file string, ids long, docs long, bytes long"), "token-manifest")
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return written(files.withColumn("base", F.coalesce(before, F.lit(0))), "token-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest. Each file is read by one task, block by block."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                for docs, ids, lengths in read_file(path):
                    raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])

    files = manifest.count()
    m = manifest.select("part", "file", "base")
    if files > 1:
        m = m.repartitionByRange(files, "part")
    return m.select("file", "base").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to token files and read back. Null text is empty: its one id is the end id."""
    return read_ids(write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary_path()))
