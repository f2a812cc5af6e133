"""Best-fit packing of token pieces into sequences by exact-complement hashing.

Pieces are counted by length: a table of at most `capacity` rows, whatever the input. From it the plan is made: lengths
are taken from long to short, and the gap that one leaves is filled exactly by a single length, a pair or a triple whose
sum is indexed and still available; where none is, the best-fitting single length goes in and the rest of the gap is
tried again. A pattern is used as often as its lengths last. Pieces then get their rank among those of their length
(counted in buckets, so a common length is spread), and the plan's runs turn a rank into a sequence and an offset.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, written
from .tokens import END_ID, encoder, vocabulary_path, with_end

CAPACITY = 2048
#: Pieces of one length and bucket, about.
BUCKET = 50_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what the whole ones leave."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces, ids with the end id."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in slices(batches, "text"):
            ids, off = with_end(*enc.encode(b.column("text").to_pylist()), END_ID)
            raw = ids.astype("<u4").tobytes()
            row, out = [], []
            for i, (p, q) in enumerate(zip(off.tolist(), off[1:].tolist(), strict=False)):
                for k, (s, n) in enumerate(cut(q - p, capacity)):
                    row.append(i)
                    out.append((k, s, n, zlib.crc32(raw[4 * (p + s) : 4 * (p + s + n)])))
            k, s, n, c = (list(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class _Left:
    """How many pieces of each length are left, and exact complements of a gap under those counts."""

    def __init__(self, counts: np.ndarray):
        self.c = counts.astype(np.int64)

    def _free(self, used: list[int]) -> np.ndarray:
        if not used:
            return self.c
        c = self.c.copy()
        for x in used:
            c[x] -= 1
        return c

    def _pair(self, c: np.ndarray, gap: int) -> tuple[int, int] | None:
        if gap < 2:
            return None
        x = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = (c[x] > 0) & (c[gap - x] > 0) & ((x != gap - x) | (c[x] > 1))
        k = int(ok.argmax()) if len(ok) else 0
        return (int(x[k]), gap - int(x[k])) if len(ok) and ok[k] else None

    def complement(self, used: list[int], gap: int) -> list[int] | None:
        """Lengths that fill the gap exactly: one, two or three."""
        c = self._free(used)
        if c[gap] > 0:
            return [gap]
        if two := self._pair(c, gap):
            return list(two)
        for z in np.flatnonzero(c[: gap - 1] > 0)[::-1].tolist():
            if 3 * z < gap:
                break
            c[z] -= 1
            two = self._pair(c, gap - z)
            c[z] += 1
            if two:
                return [z, *two]
        return None

    def largest(self, used: list[int], most: int) -> int:
        fit = np.flatnonzero(self._free(used)[: most + 1] > 0)
        return int(fit[-1]) if len(fit) else 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths, times) patterns that use every piece once; none sums to more than the capacity."""
    c = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        c[n] = k
    left, out = _Left(c), []
    for n in range(capacity, 0, -1):
        while left.c[n] > 0:
            pattern, gap = [n], capacity - n
            while gap:
                if more := left.complement(pattern, gap):
                    pattern += more
                    break
                fit = left.largest(pattern, gap)
                if not fit:
                    break
                pattern.append(fit)
                gap -= fit
            need = Counter(pattern)
            times = min(int(left.c[x]) // k for x, k in need.items())
            for x, k in need.items():
                left.c[x] -= k * times
            out.append((pattern, times))
    return out


def runs(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its runs, the sequence of each run's first rank, and the offset there."""
    out: dict[int, tuple[list, list, list]] = {}
    used: Counter = Counter()
    base = 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            r = out.setdefault(n, ([], [], []))
            r[0].append(used[n])
            r[1].append(base)
            r[2].append(offset)
            used[n] += times
            offset += n
        base += times
    return {n: tuple(np.array(x, np.int64) for x in r) for n, r in out.items()}


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset. cut_pieces (doc_id, piece, length, ...) must be a written table, as it is read twice.

    Every row is placed once, repeated ones too; empty tables stay empty. Only counts by length, `capacity` at most, and
    the plan's runs go through the driver.
    """
    counts = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}
    table = cut_pieces.sparkSession.sparkContext.broadcast(runs(plan(counts, capacity)))
    buckets = max(16, -(-sum(counts.values()) // BUCKET))
    p = cut_pieces.withColumn("bucket", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "piece"), F.lit(buckets)))
    before = p.groupBy("length", "bucket").count()
    before = before.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    p = p.withColumn("own", own).join(before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["length", "bucket"])
    p = p.withColumn("rank", F.col("before") + F.col("own") - 1).drop("bucket", "own", "before")
    columns = [c for c in cut_pieces.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            values, first = np.unique(n[order], return_index=True)
            for v, rows in zip(values.tolist(), np.split(order, first[1:]), strict=True) if len(n) else ():
                starts, base, at = table.value[v]
                k = np.searchsorted(starts, rank[rows], "right") - 1
                sequence[rows], offset[rows] = base[k] + rank[rows] - starts[k], at[k]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema)
    return p.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens. Null text is empty: its one token is the end id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(written(pieces(docs, vocabulary_path()), "pieces"))
