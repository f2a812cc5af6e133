"""Media columns: payloads as 8-bit grey PNG members of zip archives, read by a Spark data source over byte ranges.

Archives are written by tasks into the shared folder; a manifest lists those of tasks that succeeded, so a lost or
repeated task leaves nothing that is read. Directory entries have one size, so the planner cuts each archive's
directory into byte ranges without reading it. A reader takes its range of the directory, streams the payload bytes
that it covers, and reads a member again by its own offset when its checksum is wrong.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import new_path, slices, text_bytes, written

WIDTH = 64
ARCHIVE_BYTES, ARCHIVE_MEMBERS = 256_000_000, 60_000
#: Members of one partition of the reader, at most.
RANGE_MEMBERS = 4_000
READ_BYTES, BATCH_BYTES, TRIES = 4_000_000, 2_000_000, 3
NAME = 36
LOCAL, CENTRAL, END = struct.Struct("<IHHHHHIIIHH"), struct.Struct("<IHHHHHHIIIHHHHHII"), struct.Struct("<IHHHHIIH")
ENTRY = CENTRAL.size + NAME
PNG = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    """text and bytes 0 up to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def png(payload: bytes) -> bytes:
    """8-bit grey PNG of WIDTH columns."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """The samples of an image made by png(), checksums verified."""
    if image[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, height = 8, [], 0
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("checksum of a PNG chunk")
        if kind == b"IHDR":
            height = struct.unpack(">IIBBBBB", body)[1]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("only filter 0 is written")
    return rows[:, 1:].reshape(-1)


def feature(x: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and their shares in eight equal ranges."""
    n = np.bincount(x, minlength=256)
    share = n / len(x)
    mean = float(share @ np.arange(256))
    dev = float(np.sqrt(max(share @ np.arange(256) ** 2.0 - mean**2, 0)))
    some = share[share > 0]
    return f"mean={mean:.4f};dev={dev:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f};hist=" + ",".join(f"{v:.4f}" for v in n.reshape(8, 32).sum(1) / len(x))


class Archive:
    """A zip archive of stored members with names of one length, written from front to back."""

    def __init__(self, folder: str, name: str):
        system, path = fs.FileSystem.from_uri(folder)
        self.path, self.out = f"{folder}/{name}", system.open_output_stream(f"{path}/{name}")
        self.at, self.entries = 0, []

    def add(self, name: str, data: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(data)
        if len(raw) != NAME:
            raise ValueError(f"name of {len(raw)} bytes")
        self.out.write(LOCAL.pack(0x04034B50, 20, 0, 0, 0, 33, crc, len(data), len(data), NAME, 0) + raw + data)
        self.entries.append(CENTRAL.pack(0x02014B50, 20, 20, 0, 0, 0, 33, crc, len(data), len(data), NAME, 0, 0, 0, 0, 0, self.at) + raw)
        self.at += LOCAL.size + NAME + len(data)

    @property
    def full(self) -> bool:
        return self.at >= ARCHIVE_BYTES or len(self.entries) >= ARCHIVE_MEMBERS

    def close(self) -> tuple[str, int, int]:
        n = len(self.entries)
        self.out.write(b"".join(self.entries) + END.pack(0x06054B50, 0, 0, n, n, n * ENTRY, self.at, 0))
        self.out.close()
        return self.path, n, self.at


def write_archives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every row's text (null: empty) as a member; returns the written manifest (archive, members, directory)."""
    folder = new_path(docs.sparkSession, "archives")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for b in slices(batches, "text"):
            data, off = text_bytes(b.column("text"))
            raw = data.tobytes()
            for i, key in enumerate(b.column("doc_id").to_pylist()):
                archive = archive or Archive(folder, f"{uuid.uuid4().hex}.zip")
                text = raw[off[i] : off[i + 1]]
                archive.add(f"{'null' if key is None else format(key, '+d'):>20}-{len(text):011d}.png", png(padded(text)))
                if archive.full:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("archive", "members", "directory"), x, strict=True)) for x in done], pa.schema([("archive", pa.string()), ("members", pa.int64()), ("directory", pa.int64())]))

    d = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text")
    return written(d.mapInArrow(store, "archive string, members long, directory long"), "manifest")


class Range(InputPartition):
    def __init__(self, archive: str, begin: int, end: int):
        self.archive, self.begin, self.end = archive, begin, end


class ArchiveReader(DataSourceReader):
    def __init__(self, manifest: str):
        self.manifest = manifest

    def partitions(self) -> list[Range]:
        """Byte ranges of the archives' directories. The manifest has a row for each archive, not for each member."""
        import pyarrow.dataset as ds

        system, path = fs.FileSystem.from_uri(self.manifest)
        files = [x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")]
        rows = ds.dataset(files, filesystem=system, format="parquet").to_table().to_pylist() if files else []
        step = RANGE_MEMBERS * ENTRY
        out = [Range(r["archive"], at, min(at + step, r["directory"] + r["members"] * ENTRY)) for r in rows for at in range(r["directory"], r["directory"] + r["members"] * ENTRY, step)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.begin == partition.end:
            return
        system, path = fs.FileSystem.from_uri(partition.archive)

        def again(offset: int, size: int) -> bytes:
            with system.open_input_file(path) as f:
                return f.read_at(size, offset)

        entries = again(partition.begin, partition.end - partition.begin)
        members = []
        for at in range(0, len(entries), ENTRY):
            e = CENTRAL.unpack_from(entries, at)
            members.append((e[16] + LOCAL.size + NAME, e[8], e[7], entries[at + CENTRAL.size : at + ENTRY].decode()))
        at = 0
        while at < len(members):  # a stretch of about READ_BYTES at a time
            to, first = at + 1, members[at][0]
            while to < len(members) and members[to][0] + members[to][1] - first <= READ_BYTES:
                to += 1
            stretch = memoryview(again(first, members[to - 1][0] + members[to - 1][1] - first))
            ids, sizes, media, held = [], [], [], 0
            for offset, size, crc, name in members[at:to]:
                data = bytes(stretch[offset - first : offset - first + size])
                for k in range(TRIES):
                    if len(data) == size and zlib.crc32(data) == crc:
                        break
                    if k == TRIES - 1:
                        raise OSError(f"{partition.archive}: member at {offset} fails its checksum")
                    data = again(offset, size)
                key, n = name[:20].strip(), name[21:32]
                ids.append(None if key == "null" else int(key))
                sizes.append(int(n))
                media.append(data)
                held += size
                if held >= BATCH_BYTES:
                    yield _batch(ids, sizes, media)
                    ids, sizes, media, held = [], [], [], 0
            if ids:
                yield _batch(ids, sizes, media)
            at = to


def _batch(ids: list, sizes: list, media: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


class MediaArchives(DataSource):
    """spark.read.format("media_archives").load(manifest folder)"""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


def read_archives(manifest: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every member of the archives in a written manifest."""
    spark = manifest.sparkSession
    files = manifest.inputFiles()
    spark.dataSource.register(MediaArchives)
    if not files:
        return spark.createDataFrame([], "doc_id long, n_bytes long, media binary")
    return spark.read.format("media_archives").load(files[0].rpartition("/")[0])


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of the payload that each image holds; equal images get equal values. Empty tables stay empty."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for image in b.column("media").to_pylist():
                x = samples(image)
                raw = x.tobytes()
                out.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(x)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as an image, read back through the data source and described. Null text is empty; repeated rows each get a row."""
    return describe(read_archives(write_archives(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
