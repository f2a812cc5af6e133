"""What the operators share: the shared folder, written intermediate tables, Arrow text access and vectorised hashes."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an id table may have to be broadcast (8 bytes each, 32 for digests); beyond it a shuffled join is used.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset, a temporary one on a single machine, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there and lost executors lose nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables that written() made, when what was derived from them is itself written."""
    from pyarrow import fs

    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
            system.delete_dir(path)


def semi_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (distinct, one column of that name): broadcast only below BROADCAST_ROWS, counted first."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, "left_semi")


def anti_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in ids; rows with a null key stay. Broadcast as in semi_by_id."""
    n = ids.count()
    return df if not n else df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, key, "left_anti")


def join_split(left: DataFrame, right: DataFrame, key: str, size: str = "size") -> DataFrame:
    """left joined with right, which has one row a key and in `size` how many rows of left have it. Both are written tables.

    Keys that more than a thousandth of left's rows have, a thousand at most, are broadcast, so that no task gets a hot
    key's rows; the rest is shuffled.
    """
    total = right.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.col(size) * 1000 > total
    few, rest = right.where(hot).drop(size), right.where(~hot).drop(size)
    if few.isEmpty():
        return left.join(rest, key)
    return left.join(F.broadcast(few), key).unionByName(left.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(*columns) if columns else d


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after another, and n + 1 offsets; null is empty."""
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches, column: str, most: int = 1_000_000):
    """Arrow batches cut so that the text of each has about `most` bytes at most; one longer row stands alone."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 over unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + _A
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


_P = 0x5851F42D4C957F2D
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, p in enumerate((_P, pow(_P, -1, 1 << 64))):
            t = np.full(n, p, np.uint64)
            t[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(t, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased: 64-bit hashes, their starts and ends in data, and n + 1 offsets of each row's words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    last[offsets[1:]] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    ends[:-1] &= ~word[1:] | last[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=c[1:])
        h = (c[e] - c[s]) * down[s]
        h = mix(h ^ ((e - s).astype(np.uint64) << np.uint64(48)))
    return h, s, e, np.searchsorted(s, offsets)


def shingle_hashes(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each row, and n + 1 offsets; a row with fewer words has one, of all its words; one without words has none."""
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        if len(words) >= size:
            m = len(words) - size + 1
            h = np.zeros(m, np.uint64)
            for k in range(size):
                h = (h + words[k : k + m]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            h = mix(h)
        else:
            h = np.zeros(0, np.uint64)
        out = np.empty(out_at[-1], np.uint64)
        full = np.flatnonzero(n >= size)
        src = np.repeat(at[:-1][full] - out_at[:-1][full], count[full]) + _ranges(out_at[:-1][full], count[full])
        out[_ranges(out_at[:-1][full], count[full])] = h[src]
        for d in np.flatnonzero((n > 0) & (n < size)):
            v = np.uint64(n[d])
            for w in words[at[d] : at[d + 1]]:
                v = (v + w) * np.uint64(0xD6E8FEB86659FD93)
                v ^= v >> np.uint64(32)
            out[out_at[d]] = mix(np.array([v ^ np.uint64(0xABCDEF)]))[0]
    return out, out_at


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start, as many as counts says."""
    if not len(starts) or not counts.sum():
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
