"""A watched folder: files that grow, come back and vanish."""

import os
import shutil
import time

from swathlake.streaming import folder


def wait(until, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if until():
            return True
        time.sleep(0.2)
    return False


def listings(query):
    return query.lastProgress["batchId"] if query.lastProgress else -1


def some_parquet(spark, path, rows):
    """A Parquet file's bytes."""
    out = f"{path}.dir"
    spark.createDataFrame(rows, "time double, v long").coalesce(1).write.parquet(out)
    (name,) = [f for f in os.listdir(out) if f.endswith(".parquet")]
    with open(os.path.join(out, name), "rb") as f:
        data = f.read()
    shutil.rmtree(out)
    return data


def test_a_growing_file_is_read_once_and_whole(spark, tmp_path):
    src, inner = tmp_path / "in", tmp_path / "in" / "day1"
    inner.mkdir(parents=True)
    a, b, c = (some_parquet(spark, str(tmp_path / n), [(float(i), i * k) for i in range(50)]) for n, k in (("a", 1), ("b", 2), ("c", 3)))
    read, gone = [], []
    (src / "whole.parquet").write_bytes(a)
    (src / ".hidden.parquet").write_bytes(a)
    (src / "empty.parquet").write_bytes(b"")
    handle = lambda df, n: read.append(sorted((r["time"], r["v"]) for r in df.collect()))
    q = folder.watch(spark, str(src), "time double, v long", handle, str(tmp_path / "check"), seconds=0.5, missing=4.0, gone=lambda df, n: gone.extend(r["path"] for r in df.collect()))
    try:
        growing = inner / "growing.parquet"
        for part in range(1, 4):  # a third more at each listing or later: never twice one size before it is whole
            with open(growing, "ab") as f:
                f.write(b[len(b) * (part - 1) // 3 : len(b) * part // 3])
            n = listings(q)
            if part < 3:
                assert wait(lambda n=n: listings(q) > n)
        assert wait(lambda: len(read) >= 2), q.exception()
        n = listings(q)
        assert wait(lambda: listings(q) >= n + 2)  # nothing is told again
        assert sorted(map(len, read)) == [50, 50] and sorted(r[1][1] for r in read) == [1, 2]
        os.remove(growing)
        assert wait(lambda: len(gone) == 1) and gone[0].endswith("day1/growing.parquet")
        growing.write_bytes(c)  # one that comes back is new
        assert wait(lambda: len(read) == 3) and read[2][1] == (1.0, 3)
        assert q.exception() is None
    finally:
        q.stop()
    # a restart goes on where it was: nothing is read again, a new file is
    read.clear()
    q = folder.watch(spark, str(src), "time double, v long", handle, str(tmp_path / "check"), seconds=0.5, missing=60.0)
    try:
        (src / "later.parquet").write_bytes(b)
        assert wait(lambda: read) and [r[1] for r in read] == [(1.0, 2)]
    finally:
        q.stop()


def test_one_file_at_a_time_in_order(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in (3, 1, 2):
        (src / f"line{k}.parquet").write_bytes(some_parquet(spark, str(tmp_path / f"x{k}"), [(0.0, k)]))
    read = []
    q = folder.watch(spark, str(src), "time double, v long", lambda df, n: read.append([r["v"] for r in df.collect()]), str(tmp_path / "check"), seconds=0.5, files=1)
    try:
        assert wait(lambda: len(read) == 3) and read == [[1], [2], [3]]
    finally:
        q.stop()


def test_the_service_processes_what_comes(spark, tmp_path):
    from swathlake.plans import runner
    from swathlake.plans import stage_queries as Q

    sf, src, table = "/root/testdata/sf0.001", tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    s = Q.soundings(spark, sf).where("dataset = '3'").limit(40)
    out = str(tmp_path / "rows")
    s.coalesce(1).write.parquet(out)
    ddl = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema)
    q = folder.serve(spark, str(src), ddl, table, lambda: Q.settings(spark), lambda: Q.attitude(spark, sf), lambda: Q.casts(spark), str(tmp_path / "check"), seconds=0.5)
    try:
        (name,) = [f for f in os.listdir(out) if f.endswith(".parquet")]
        shutil.copy(os.path.join(out, name), src / "a.parquet")
        assert wait(lambda: os.path.exists(table + "__versions"), 180), q.exception()
        assert wait(lambda: not os.path.exists(table + "__stage"))
    finally:
        q.stop()
    assert runner.table(spark, table).where("processing_status = 5 and x is not null").count() == 40
