"""A watched folder: files flow into keyed tables once they are whole; vanished ones are told.

Listings are a stream of their own: each trigger lists the folder anew, its parts on the executors. Of every path the
size of the listing before is kept as state, and a file is told when two listings in a row give it one size; a timer,
put off by every listing that has the path, tells when it is gone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import upsert

LISTING = "path string, length long, modified timestamp"
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:/") else (fs.LocalFileSystem(), folder)


def _hidden(name: str) -> bool:
    return name.startswith((".", "_"))


class _ListingReader(DataSourceStreamReader):
    """An offset is a time; every trigger has a new one, and its batch is the folder as it is then. The files beside each other and each folder in it are listed by a task of their own."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"at": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow import fs

        system, path = _system(self.folder)
        below = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [_Folder(path, False), *[_Folder(f.path, True) for f in below if f.type == fs.FileType.Directory and not _hidden(f.base_name)]]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = _system(self.folder)
        for f in system.get_file_info(fs.FileSelector(partition.path, recursive=partition.deep, allow_not_found=True)):
            if f.type == fs.FileType.File and not any(_hidden(n) for n in f.path[len(partition.path) :].strip("/").split("/")):
                yield f.path, f.size, f.mtime


class FolderListing(DataSource):
    """Streaming source "folder_listing": LISTING of the files in option("path"); names that begin with a dot or underscore are hidden."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTING

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _ListingReader(self.options["path"])


def _event(path: str, event: str, length: int):
    import pandas as pd

    return pd.DataFrame({"path": pd.Series([path], dtype=object), "event": pd.Series([event], dtype=object), "length": [length]})


class Settled(StatefulProcessor):
    """(path, event, length): 'created' of a file whose size, above 0, two listings in a row agree in, once until it is gone; 'deleted' of one that no listing of the last `missing` seconds had, if it was told."""

    def __init__(self, missing: float):
        self.missing = int(missing * 1000)

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("seen", "length long, told boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        length = max(int(v) for df in rows for v in df["length"])
        before, told = self.state.get() if self.state.exists() else (-1, False)
        whole = not told and length == before and length > 0
        self.state.update((length, told or whole))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.missing)
        if whole:
            yield _event(key[0], "created", length)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        length, told = self.state.get() if self.state.exists() else (0, False)
        self.state.clear()
        if told:
            yield _event(key[0], "deleted", length)

    def close(self) -> None:
        pass


def file_events(listings: DataFrame, missing: float = 5.0) -> DataFrame:
    """A stream of listings (path, length, ...) as a stream of (path, event, length)."""
    return listings.groupBy("path").transformWithStateInPandas(Settled(missing), "path string, event string, length long", "append", "processingTime")


def events(spark: SparkSession, folder: str, missing: float = 5.0) -> DataFrame:
    spark.dataSource.register(FolderListing)
    return file_events(spark.readStream.format("folder_listing").option("path", folder).load(), missing)


def watch(
    spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 1.0, files: int = 5, missing: float | None = None,
    gone: Callable[[DataFrame, int], None] | None = None, form: str = "parquet",
) -> StreamingQuery:
    """Calls handle(new rows, batch number) for files that have come and are whole, `files` at a time in order of path; one at a time processes line after line. gone gets (path, event, length) of vanished files.

    A batch that was cut off is done again, so a file may be handled twice, never missed: handle should upsert. The
    folder is listed every `seconds`; a file is missing after five listings if not said otherwise. What is still being
    written waits; a file that changes after it was handled is not handled again before it has been gone.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        paths = [r["path"] for r in batch.where("event = 'created'").orderBy("path").select("path").collect()]  # names of the files of some seconds
        for i in range(0, len(paths), files):
            handle(spark.read.schema(schema).format(form).load(paths[i : i + files]), number)
        if gone is not None:
            vanished_ = batch.where("event = 'deleted'")
            if not vanished_.isEmpty():
                gone(vanished_, number)
        batch.unpersist()

    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)  # state of arbitrary operators needs it; a running query keeps what it started with
    try:
        w = events(spark, folder, 5 * seconds if missing is None else missing).writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)
        return w.trigger(processingTime=f"{seconds} seconds").start()
    finally:
        spark.conf.set(ROCKS[0], before) if before else spark.conf.unset(ROCKS[0])


def arrived(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, files: int = 5) -> StreamingQuery:
    """Calls handle(new rows, batch number) for all files that are there and were not handled before, then ends: the batch form, for files moved in whole."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(folder)
    return s.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_table(spark: SparkSession, folder: str, schema: str, table: str, keys: list[str], partition: str, checkpoint: str, once: bool = True, seconds: float = 1.0) -> StreamingQuery:
    """Upserts what appears in a folder into a Parquet table: late and out-of-order rows replace those of equal keys. Once: what is there; else for ever, and only whole files."""
    put = lambda df, _: upsert.upsert(spark, table, df, keys, partition)
    return arrived(spark, folder, schema, put, checkpoint) if once else watch(spark, folder, schema, put, checkpoint, seconds)


def serve(spark: SparkSession, folder: str, schema: str, table: str, settings: Callable[[], DataFrame], attitude: Callable[[], DataFrame], casts: Callable[[], DataFrame], checkpoint: str, seconds: float = 1.0, files: int = 5) -> StreamingQuery:
    """The service: converted soundings (dataset, chunk, ...) that come into a folder are stored, and the stages that are then stale are run, for ever. Settings, attitude and casts are read anew each time."""
    from ..plans import runner

    def handle(rows: DataFrame, _: int) -> None:
        runner.store(rows, table)
        runner.run(spark, table, settings(), attitude(), casts())

    return watch(spark, folder, schema, handle, checkpoint, seconds, files)


def vanished(seen: DataFrame, listing: DataFrame) -> DataFrame:
    """Files seen before that a listing no longer has."""
    return seen.join(listing, "path", "left_anti")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return f.select("path", "length", "modificationTime")


def settled(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files of a listing whose size has not changed since the listing before: only these are whole."""
    return now.join(before.select("path", "length"), ["path", "length"], "left_semi")


def event_windows(events: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of an event stream by window and kind; rows later than the watermark are left out. An extension: batch tables work too."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
