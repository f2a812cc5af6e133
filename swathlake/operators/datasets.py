"""Datasets of a project as tables: their lines, status, times and settings, and how files, casts and solutions belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import timejoin

#: Names of a sounding's processing status.
STATUS = ("converted", "orientation", "beamvector", "soundvelocity", "georeference", "tpu")
#: Fixed value: orders of magnitude to which frequencies are rounded, by the largest.
ROUNDING = ((1e5, -5), (1e4, -4))


# --- lines


def line_navigation(positions: DataFrame, lines: DataFrame, by: str = "system", time: str = "time") -> DataFrame:
    """positions with the line that holds their time, ends included; those in none go."""
    span = lines.select(by, F.col("start_time").alias(time), "line", F.col("end_time").alias("until"))
    x = timejoin.asof(positions, span, ["line", "until"], by, time, suffix="")
    return x.where(F.col(time) <= F.col("until")).drop("until")


def line_processed(soundings: DataFrame, lines: DataFrame, by: str = "system", time: str = "time", status: str = "processing_status") -> DataFrame:
    """(by, line, processed): whether all beams of the ping nearest to a line's middle have the last status."""
    pings = soundings.groupBy(by, time).agg(F.min(status).alias("least"))
    middle = lines.select(by, "line", ((F.col("start_time") + F.col("end_time")) / 2).alias(time))
    x = timejoin.nearest(middle, pings, ["least"], by, time, suffix="")
    return x.select(by, "line", F.coalesce(F.col("least") >= len(STATUS) - 1, F.lit(False)).alias("processed"))


def next_unprocessed(lines: DataFrame, processed: DataFrame, by: str = "system") -> DataFrame:
    """(by, line): each system's first line in time that is not processed."""
    x = lines.join(processed, [by, "line"]).where(~F.col("processed"))
    return x.groupBy(by).agg(F.min_by("line", F.struct("start_time", "line")).alias("line"))


def owners(lines: DataFrame, wanted: DataFrame, by: str = "system") -> DataFrame:
    """(line, by): the datasets that hold each wanted line."""
    return lines.join(wanted.select("line").distinct(), "line", "left_semi").select("line", by).distinct()


def selected_spans(points: DataFrame, by: str = "system", time: str = "time") -> DataFrame:
    """Lines, systems and time span of some points."""
    return points.groupBy("line", by).agg(F.min(time).alias("start"), F.max(time).alias("end"))


# --- what a dataset holds


def bounds(series: DataFrame, by: str = "system", time: str = "time") -> DataFrame:
    """(by, first, last, n): each dataset's time bounds and samples."""
    return series.groupBy(by).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))


def time_text(seconds: Column) -> Column:
    """UTC seconds as text."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd HH:mm:ss")


def extents(positions: DataFrame, by: str, columns: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    return positions.groupBy(by).agg(*[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))])


def overlapping(extents_: DataFrame, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> DataFrame:
    """Datasets whose extent meets a box."""
    return extents_.where((F.col("min_lat") <= max_lat) & (F.col("max_lat") >= min_lat) & (F.col("min_lon") <= max_lon) & (F.col("max_lon") >= min_lon))


def least_status(soundings: DataFrame, by: str = "system", status: str = "processing_status") -> DataFrame:
    """(by, status, label): the least status over all heads of a dataset and its name."""
    names = F.array(*map(F.lit, STATUS))
    return soundings.groupBy(by).agg(F.min(status).cast("int").alias("status")).withColumn("label", F.get(names, F.col("status")))


def last_operation(log: DataFrame, by: str = "system") -> DataFrame:
    """(by, operation, at): the latest of a dataset's logged operations, ties to the greater name."""
    return log.groupBy(by).agg(F.max(F.struct("at", "operation")).alias("x")).select(by, "x.operation", "x.at")


def most_common(settings: DataFrame, value: str) -> DataFrame:
    """One row: the value that most datasets have, ties to the smaller, and in how many."""
    n = settings.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), value).limit(1)


def agree(settings: DataFrame, *columns: str) -> DataFrame:
    """One row: for each column whether all datasets have one value of it, as a surface of them needs."""
    return settings.agg(*[(F.countDistinct(c) + F.max(F.col(c).isNull().cast("int")) == 1).alias(f"one_{c}") for c in columns])


def heads(pings: DataFrame, by: str = "system", serial: str = "serial") -> DataFrame:
    """(by, heads, dual): how many serial numbers a dataset's records come from."""
    return pings.groupBy(by).agg(F.countDistinct(serial).alias("heads")).withColumn("dual", F.col("heads") > 1)


def in_force(parameters: DataFrame, times: DataFrame, names: list[str]) -> DataFrame:
    """times (system, ts, ...) with the last value of each named parameter at or before them: a row a set, with what holds carried on, meets them once."""
    p = parameters.where(F.col("param").isin(*names) & F.col("value").isNotNull()).groupBy("system", "ts").agg(*[F.max(F.when(F.col("param") == n, F.col("value"))).alias(n) for n in names])
    run = Window.partitionBy("system").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # the sets of a system
    return timejoin.asof(times, p.withColumns({n: F.last(n, True).over(run) for n in names}), names, time="ts", suffix="")


def with_offsets(beams: DataFrame, offsets: DataFrame, sector: str = "sector") -> DataFrame:
    """beams with the additional lever arm (x, y, z) of their sector, 0 where a sector has none."""
    o = offsets.select(F.col(sector), *[F.col(c).alias(f"offset_{c}") for c in "xyz"])
    return beams.join(o, sector, "left").fillna(0.0, ["offset_x", "offset_y", "offset_z"])


def rounded_frequency(soundings: DataFrame, frequency: str = "frequency") -> DataFrame:
    """(frequency, rounded, n): frequencies rounded to the magnitude that the largest asks for."""
    n = soundings.where(F.col(frequency).isNotNull()).groupBy(frequency).agg(F.count("*").alias("n"))
    top = n.agg(F.max(frequency).alias("__top"))
    x = n.join(F.broadcast(top), F.lit(True))  # one row
    size = F.when(F.col("__top") >= ROUNDING[0][0], 1e5).when(F.col("__top") >= ROUNDING[1][0], 1e4).otherwise(1e3)
    return x.select(frequency, (F.bround(F.col(frequency) / size) * size).cast("long").alias("rounded"), "n")


def group_of_test(soundings: DataFrame, mode: str = "mode", second: str = "modetwo", frequency: str = "rounded") -> Column:
    """The group of an accuracy or extinction test: mode, second mode and rounded frequency."""
    return F.concat_ws("_", *[F.col(c).cast("string") for c in (mode, second, frequency)])


# --- conversion of decoded records


def blocks(records: DataFrame, by: str = "system", serial: str = "serial", time: str = "time") -> DataFrame:
    """Decoded records by system and head: one dataset a serial number, first of equal times, times of 0 left out. Files may overlap: of a sample in two files the later file's counts."""
    x = records.where((F.col(time) > 0) & F.col(time).isNotNull()).withColumn("__system", F.concat_ws("_", F.col(by).cast("string"), F.col(serial).cast("string")))
    rest = [c for c in records.columns if c not in (by, serial, time)]
    best = x.groupBy("__system", by, serial, time).agg(F.max(F.struct("file", *[c for c in rest if c != "file"])).alias("r"))
    return best.select(F.col("__system").alias("dataset"), by, serial, time, *[f"r.{c}" for c in rest])


def byte_ranges(files: DataFrame, least: int = 40_000_000, most: int = 20) -> DataFrame:
    """(path, start, length): parts of raw files for their decoders, of 40 MB at least, 20 a file at most."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("length") / least))).cast("long")
    size = F.ceil(F.col("length") / n).cast("long")
    x = files.select("path", "length", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    return x.select("path", (F.col("k") * F.col("size")).alias("start"), F.least(F.col("size"), F.col("length") - F.col("k") * F.col("size")).alias("length"))


def nearest_settings(chunks: DataFrame, runtime: DataFrame, values: list[str]) -> DataFrame:
    """chunks with the runtime settings nearest in time."""
    return timejoin.nearest(chunks, runtime, values, suffix="")


# --- files, casts and solutions of a project


def dataset_key(files: DataFrame) -> DataFrame:
    """files with dataset: model, serial number and date."""
    day = F.date_format(F.timestamp_seconds(F.floor("start")), "MM_dd_yyyy")
    return files.withColumn("dataset", F.concat_ws("_", "model", F.col("serial").cast("string"), day))


def grouped_files(files: DataFrame, datasets: DataFrame) -> DataFrame:
    """files with the dataset of their serial numbers (serial, and serial2 of a second head, 0 if there is no such column) and day of the year, or else the key of a new one, and whether it is new."""
    day = lambda t: F.date_format(F.timestamp_seconds(F.floor(t)), "DDD")
    both = lambda x: x if "serial2" in x.columns else x.withColumn("serial2", F.lit(0))
    known = both(datasets).groupBy("serial", "serial2", day("start").alias("day")).agg(F.min("name").alias("known"))
    x = both(dataset_key(files)).withColumn("day", day("start")).join(known, ["serial", "serial2", "day"], "left")
    x = x.withColumn("new", F.col("known").isNull()).withColumn("dataset", F.coalesce("known", "dataset")).drop("known", "day")
    return x if "serial2" in files.columns else x.drop("serial2")


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files of which no known one has the name and size."""
    return found.join(known.select("name", "size").distinct(), ["name", "size"], "left_anti")


def casts_to_import(casts: DataFrame, held: DataFrame, datasets: DataFrame) -> DataFrame:
    """(dataset, cast): every cast (digest, cast) whose content a dataset doesn't hold (dataset, digest), whatever its day. Datasets that hold all casts are told by counts; only what others lack is written out."""
    known = casts.select("digest", "cast").distinct()
    one = known.agg(F.countDistinct("digest").alias("n"), F.collect_set("digest").alias("all"))  # a project's casts, once
    have = held.select("dataset", "digest").distinct().join(known.select("digest").distinct(), "digest", "left_semi")
    own = datasets.select("dataset").distinct().join(have, "dataset", "left").groupBy("dataset").agg(F.collect_set("digest").alias("own"))
    x = own.join(F.broadcast(one), F.lit(True)).where(F.size("own") < F.col("n"))
    return x.select("dataset", F.explode(F.array_except("all", "own")).alias("digest")).join(known, "digest").select("dataset", "cast").distinct()


def imported_casts(held: DataFrame, new: DataFrame, used: DataFrame, datasets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Casts after an import (an identical cast replaces the older), and (dataset, status) of datasets that must be ray traced again.

    These are the ones that use a cast that came in, be it new or in place of an identical one, and had been traced: their
    status of 3 or more becomes 2. datasets: dataset, status; without it all have been traced.
    """
    old = held.select("dataset", "digest", "cast", F.lit(0).alias("age"))
    both = old.unionByName(new.select("dataset", "digest", "cast", F.lit(1).alias("age")))
    after = both.groupBy("dataset", "digest").agg(F.max_by("cast", F.struct("age", "cast")).alias("cast"))
    fresh = new.join(held.select("dataset", "cast").distinct(), ["dataset", "cast"], "left_anti")
    again = fresh.join(used.select("dataset", "cast").distinct(), ["dataset", "cast"], "left_semi").select("dataset").distinct()
    if datasets is not None:
        again = again.join(datasets.where("status >= 3").select("dataset").distinct(), "dataset", "left_semi")
    return after, again.withColumn("status", F.lit(2))


def without_cast(held: DataFrame, cast: DataFrame, used: DataFrame, datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Casts without those removed (dataset, cast), and datasets with status 2 where a removed one was in use and had been traced with."""
    gone = cast.select("dataset", "cast").distinct()
    hit = gone.join(used.select("dataset", "cast").distinct(), ["dataset", "cast"], "left_semi").select(F.col("dataset").alias("__d")).distinct()
    x = datasets.join(hit, F.col("dataset") == F.col("__d"), "left")
    return held.join(gone, ["dataset", "cast"], "left_anti"), x.withColumn("status", F.when(F.col("__d").isNotNull(), F.least("status", F.lit(2))).otherwise(F.col("status"))).drop("__d")


def imported_navigation(raw: DataFrame, solution: DataFrame, values: list[str], gap: float = 1.0) -> DataFrame:
    """The solution interpolated at the raw times, in columns named post_.

    Up to `gap` seconds beyond its ends the solution goes on; farther out it is null. Inside its gaps longer than `gap`
    that raw doesn't share, raw's own value of that name stays, or null where raw has none.
    """
    from . import series

    x = timejoin.interpolate(raw, solution, values, suffix="__post")
    ends = solution.groupBy(F.col("system").alias("__s")).agg(F.min("time").alias("__first"), F.max("time").alias("__last"))
    x = x.join(ends, F.col("system").eqNullSafe(F.col("__s")), "left").drop("__s")
    holes = series.new_gaps(raw.select("system", "time"), solution.select("system", "time"), gap).select("system", F.col("start").alias("time"), F.col("start").alias("__from"), F.col("end").alias("__to"))
    x = timejoin.asof(x, holes, ["__from", "__to"], suffix="")
    inside = F.coalesce((F.col("time") > F.col("__from")) & (F.col("time") < F.col("__to")), F.lit(False))
    covered = (F.col("time") >= F.col("__first") - gap) & (F.col("time") <= F.col("__last") + gap)
    own = lambda v: F.col(v) if v in raw.columns else F.lit(None)
    return x.select(*raw.columns, *[F.when(inside, own(v)).when(covered, F.col(f"{v}__post")).alias(f"post_{v}") for v in values])


def overwritten_navigation(raw: DataFrame, solution: DataFrame, values: list[str], gap: float = 1.0) -> DataFrame:
    """raw with the solution's values in place of its own wherever the solution has some."""
    x = imported_navigation(raw, solution, values, gap)
    return x.select(*[F.coalesce(f"post_{c}", c).alias(c) if c in values else c for c in raw.columns])


def without_navigation(pings: DataFrame, status: str = "processing_status") -> DataFrame:
    """pings without their solution's columns; what was placed with it goes back to status 3."""
    x = pings.drop(*[c for c in pings.columns if c.startswith("post_")])
    return x.withColumn(status, F.least(F.col(status), F.lit(3)))
