"""Choosing soundings and pings: by time, line, beam, polygon and flag; setting variables where a filter holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import timejoin

REJECTED, AMPLITUDE, PHASE, REACCEPTED = 2, 0, 1, 3


def snapped(samples: DataFrame, at: float | None, time: str = "time") -> float | None:
    """The sample time nearest to `at`; ties go to the earlier."""
    if at is None:
        return None
    return samples.agg(F.min_by(time, F.struct(F.abs(F.col(time) - at), F.col(time)))).first()[0]


def by_time(df: DataFrame, start: float | None = None, end: float | None = None, time: str = "time") -> DataFrame:
    """Rows between the samples nearest to both bounds, both ends included; none if both bounds snap to one end of the series."""
    a, b = snapped(df, start, time), snapped(df, end, time)
    if start is not None and end is not None and a == b:
        low, high = df.agg(F.min(time), F.max(time)).first()
        if a in (low, high) and not (start <= a <= end):
            return df.limit(0)
    out = df
    if a is not None:
        out = out.where(F.col(time) >= a)
    return out.where(F.col(time) <= b) if b is not None else out


def by_windows(df: DataFrame, windows: list[tuple[float, float]], time: str = "time") -> DataFrame:
    """Rows in any of some windows, each row once."""
    keep = F.lit(False)
    for a, b in windows:
        a, b = snapped(df, a, time), snapped(df, b, time)
        keep = keep | F.col(time).between(a, b)
    return df.where(keep)


def by_lines(df: DataFrame, lines: DataFrame, names: list[str], by: str = "system", time: str = "time") -> DataFrame:
    """Rows within the spans of the named lines, with the line's name."""
    chosen = lines.where(F.col("line").isin(names))
    return timejoin.line_of(df, chosen, by, time, slack=0.0).where("line is not null")


def mark_pairs(soundings: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ("time", "beam"), name: str = "selected") -> DataFrame:
    """A column that says which soundings are among the (time, beam) pairs."""
    p = pairs.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return soundings.join(p, list(keys), "left").withColumn(name, F.col("__hit").isNotNull()).drop("__hit")


def drop_rejected(soundings: DataFrame, flag: str = "detectioninfo", needs: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Accepted soundings with a value in the first of `needs` that there is; the flag goes."""
    first = next((c for c in needs if c in soundings.columns), None)
    x = soundings.where(F.col(flag) != REJECTED).drop(flag)
    return x if first is None else x.where(F.col(first).isNotNull() & ~F.isnan(F.col(first).cast("double")))


def variables(soundings: DataFrame, names: list[str], accepted_only: bool = False, flag: str = "detectioninfo") -> DataFrame:
    """Projection in order of time, without rejected soundings if wanted."""
    df = soundings.where(F.col(flag) != REJECTED) if accepted_only else soundings
    return df.select(*names).orderBy("time")


def in_polygon(soundings: DataFrame, polygon: list[tuple[float, float]], lon: str = "lon", lat: str = "lat", hashes: str | None = None, precision: int = 7) -> DataFrame:
    """Soundings in a ring of (lon, lat), its edge included. With a geohash column, cells prune first: inner ones are taken whole, others tested by point."""
    inside = geo.in_polygon(F.col(lon), F.col(lat), polygon) > 0
    if hashes:
        inner, meets = geo.polygon_cover(polygon, precision)
        return soundings.where(F.col(hashes).isin(meets)).where(F.col(hashes).isin(inner) | inside if inner else inside)
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    return soundings.where(F.col(lon).between(min(xs), max(xs)) & F.col(lat).between(min(ys), max(ys))).where(inside)


def in_polygon_with_lines(soundings: DataFrame, lines: DataFrame, polygon: list[tuple[float, float]], by: str = "system", head: int | None = None, **where) -> DataFrame:
    """Soundings of all datasets of a project, or of one of their heads, in a ring, with the line of each (null between lines). lines: by, line, start_time, end_time."""
    from . import timejoin

    x = soundings if head is None else soundings.where(F.col("head") == head)
    return timejoin.line_of(in_polygon(x, polygon, **where), lines, by)


def read_where(soundings: DataFrame, columns: list[str], condition: Column, attitude: DataFrame | None = None, by: str = "system") -> DataFrame:
    """Values of some variables where a condition holds; those that only `attitude` has come from its sample nearest in time."""
    from . import timejoin

    own = [c for c in columns if c in soundings.columns]
    x = soundings.where(condition)
    if attitude is None or len(own) == len(columns):
        return x.select(*columns)
    keys = [c for c in (by, "time") if c not in own]
    return timejoin.nearest(x.select(*own, *keys), attitude, [c for c in columns if c not in own], by, suffix="").select(*columns)


def set_where(df: DataFrame, column: str, condition: Column, value) -> DataFrame:
    new = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(column, F.when(condition, new.cast(df.schema[column].dataType)).otherwise(F.col(column)))


def lines_in_box(positions: DataFrame, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> DataFrame:
    """Lines that lie wholly inside a box, its edge left out."""
    e = positions.groupBy("line").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    return e.where((F.col("a") > min_lat) & (F.col("b") < max_lat) & (F.col("c") > min_lon) & (F.col("d") < max_lon)).select("line")


def clipped_lines(lines: DataFrame, start: float, end: float) -> DataFrame:
    """Lines that meet a window, cut to it."""
    x = lines.where((F.col("start_time") <= end) & (F.col("end_time") >= start))
    return x.withColumns({"start_time": F.greatest(F.col("start_time"), F.lit(float(start))), "end_time": F.least(F.col("end_time"), F.lit(float(end)))})


def bit_set(value: Column, position: int) -> Column:
    """Whether a bit, counted from 1, is set."""
    return F.shiftright(value, position - 1).bitwiseAND(1) == 1
