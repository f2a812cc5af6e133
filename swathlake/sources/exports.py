"""Exports of soundings: text by line or by identifiers, LAS points, and tracks as WKT."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.subset import REJECTED


def export_rows(soundings: DataFrame, accepted_only: bool = True, z_down: bool = True) -> DataFrame:
    df = soundings.where(F.col("x").isNotNull())
    if accepted_only:
        df = df.where(F.col("detectioninfo") != REJECTED)
    return df if z_down else df.withColumn("z", -F.col("z"))


def xyz_text(df: DataFrame, delimiter: str = " ", form: str = "xyz") -> DataFrame:
    """One text column of easting, northing, depth with three decimals; xyzv adds the vertical, xyzhv both uncertainties."""
    names = {"xyz": ["x", "y", "z"], "xyzv": ["x", "y", "z", "tvu"], "xyzhv": ["x", "y", "z", "thu", "tvu"]}[form]
    keep = [c for c in df.columns if c in ("line", "frequency", "sector")]
    return df.select(*keep, F.format_string(delimiter.join(["%.3f"] * len(names)), *[F.col(c).cast("double") for c in names]).alias("value"))


def write_text(df: DataFrame, path: str, by: tuple[str, ...] = (), **options) -> None:
    """Text files in a folder for each line, or each frequency and sector."""
    t = xyz_text(df, **options)
    (t.repartition(*by).write.partitionBy(*by) if by else t.select("value").write).text(path)


def las_class(flag: Column) -> Column:
    """Classification of a detection flag: below 2 accepted (1), 2 rejected (7), 3 stays."""
    return F.when(flag < 2, 1).when(flag == 2, 7).otherwise(flag).cast("int")


def las_files(soundings: DataFrame) -> DataFrame:
    """(name, content) of LAS 1.4 files, one a task, z up, scaled to millimetres from the task's least values."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        x, y, z, k = (t.column(c).to_numpy() for c in ("x", "y", "z", "class"))
        low = [float(v.min()) for v in (x, y, z)]
        rec = np.zeros(len(x), np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("i", "<u2"), ("r", "u1"), ("f", "u1"), ("c", "u1"), ("u", "u1"), ("a", "<i2"), ("s", "<u2"), ("t", "<f8")]))
        for n, v, o in zip("xyz", (x, y, z), low, strict=True):
            rec[n] = np.rint((v - o) * 1000)
        rec["r"], rec["c"] = 0x11, k
        head = bytearray(375)
        struct.pack_into("<4s", head, 0, b"LASF")
        struct.pack_into("<BB", head, 24, 1, 4)
        struct.pack_into("<HIIBH", head, 94, 375, 375, 0, 6, rec.itemsize)
        struct.pack_into("<6d", head, 131, 0.001, 0.001, 0.001, *low)
        struct.pack_into("<6d", head, 179, x.max(), x.min(), y.max(), y.min(), z.max(), z.min())
        struct.pack_into("<Q", head, 247, len(x))
        yield pa.RecordBatch.from_arrays([pa.array([f"part-{TaskContext.get().partitionId():05d}.las"]), pa.array([bytes(head) + rec.tobytes()], pa.binary())], ["name", "content"])

    s = soundings.where("x is not null and y is not null and z is not null").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (-F.col("z").cast("double")).alias("z"), las_class(F.col("detectioninfo")).alias("class"))
    return s.mapInArrow(make, "name string, content binary")


def tracks(positions: DataFrame, by: str = "line", time: str = "time", every: int = 1) -> DataFrame:
    """(by, wkt): each line's track in order of time."""
    from ..operators.series import every_nth

    p = every_nth(positions, every, by, time) if every > 1 else positions
    points = F.array_sort(F.collect_list(F.struct(time, "lon", "lat")))
    text = F.array_join(F.transform(points, lambda q: F.format_string("%.6f %.6f", q["lon"].cast("double"), q["lat"].cast("double"))), ", ")
    return p.where("lat is not null and lon is not null").groupBy(by).agg(F.concat(F.lit("LINESTRING ("), text, F.lit(")")).alias("wkt"))
