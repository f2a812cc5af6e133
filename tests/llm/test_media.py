import hashlib
import io
import zipfile
import zlib

import numpy as np
import pytest
from pyarrow import fs

from swathlake.llm import media


def test_image_round_trip():
    for text in (b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 33):
        p = media.padded(text)
        assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(text) and not p[len(text) :].strip(b"\0")
        assert media.samples(media.png(p)).tobytes() == p
    with pytest.raises(ValueError):
        media.samples(media.png(media.padded(b"abc"))[:-20] + b"0" * 20)


def test_documents_round_trip(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = media.op5_media_columns(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        p = media.padded(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]]), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:])
        image = media.png(p)
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        assert r["feature"] == media.feature(np.frombuffer(p, np.uint8))


def test_ranges_members_and_retries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "RANGE_MEMBERS", 2)
    a = media.Archive(f"file://{tmp_path}", "x.zip")
    images = {k: media.png(media.padded(str(k).encode() * k)) for k in range(5)}
    for k, v in images.items():
        a.add(f"{k:>+20d}-{len(str(k)) * k:011d}.png", v)
    path, members, directory = a.close()
    with zipfile.ZipFile(io.BytesIO((tmp_path / "x.zip").read_bytes())) as z:
        assert z.testzip() is None and len(z.namelist()) == 5
    spark.createDataFrame([(path, members, directory)], "archive string, members long, directory long").coalesce(1).write.parquet(f"{tmp_path}/m")
    reader = media.ArchiveReader(f"file://{tmp_path}/m")
    parts = reader.partitions()
    assert len(parts) == 3
    got = {i: m for p in parts for b in reader.read(p) for i, m in zip(b.column(0).to_pylist(), b.column(2).to_pylist())}
    assert got == images
    raw = bytearray((tmp_path / "x.zip").read_bytes())
    raw[80] ^= 255  # in the first member's data: its checksum fails, and only its range does
    (tmp_path / "x.zip").write_bytes(raw)
    with pytest.raises(OSError):
        list(reader.read(parts[0]))
    assert sum(b.num_rows for b in reader.read(parts[1])) == 2
    assert fs.FileSystem.from_uri(path)


def test_odd_rows(odd_docs, no_docs):
    rows = media.describe(media.read_archives(media.write_archives(odd_docs))).collect()
    assert len(rows) == odd_docs.count()
    assert len({(r["payload_sha256"], r["feature"]) for r in rows if r["doc_id"] in (1, 2, 4, 5)}) == 2
    assert sum(r["doc_id"] is None for r in rows) == 1
    assert media.describe(media.read_archives(media.write_archives(no_docs))).count() == 0
