"""Sound velocity cast files: several casts a file, each a header line and depth and speed pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import angles, times


def read_svp(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(source, cast_time, lat, lon, layers) of every cast in the .svp files at a path. Files are small: each is read whole by a task.

    A cast begins with `Section year-day h:m:s latitude longitude`; a layer at depth 0 is added with the first speed
    where there is none, and layers are put in order of depth.
    """
    t = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter="*.svp")
    return parse_svp(t.select(F.col("_metadata.file_name").alias("source"), F.col("value")))


def parse_svp(files: DataFrame) -> DataFrame:
    c = files.select("source", F.posexplode(F.split("value", r"(?m)^Section\s+")).alias("k", "cast")).where("k > 0")
    row = F.lit(r"(?m)^[ \t]*([0-9.]+)[ \t]+([0-9.]+)[ \t\r]*$")
    depth, sv = (F.regexp_extract_all(F.col("cast"), row, F.lit(k)) for k in (1, 2))
    c = c.select("source", depth.alias("depth"), sv.alias("sv"), F.split(F.regexp_extract("cast", r"^([^\r\n]*)", 1), r"\s+").alias("head"))
    day, clock = F.split(F.col("head")[0], "-"), F.split(F.col("head")[1], ":")
    utc = times.year_day_to_utc(day[0].cast("int"), day[1].cast("int"), clock[0].cast("int"), clock[1].cast("int"), clock[2].cast("double"))
    layers = F.zip_with("depth", "sv", lambda d, v: F.struct(d.cast("double").alias("depth"), v.cast("double").alias("sv")))
    c = c.select("source", utc.alias("cast_time"), angles.parse_dms(F.col("head")[2]).alias("lat"), angles.parse_dms(F.col("head")[3]).alias("lon"), F.sort_array(layers).alias("layers"))
    top = F.when((F.size("layers") > 0) & (F.col("layers")[0]["depth"] > 0), F.concat(F.array(F.struct(F.lit(0.0).alias("depth"), F.col("layers")[0]["sv"].alias("sv"))), F.col("layers"))).otherwise(F.col("layers"))
    return c.withColumn("layers", top)


def simplified(layers, most: int = 80):
    """A profile of at most `most` evenly spaced depths by linear interpolation; shorter ones stay."""
    first, last = F.element_at(layers, 1)["depth"], F.element_at(layers, -1)["depth"]

    def at(k):
        d = first + (last - first) * k / (most - 1)
        before = F.element_at(F.filter(layers, lambda p: p["depth"] <= d), -1)
        after = F.element_at(F.filter(layers, lambda p: p["depth"] >= d), 1)
        span = after["depth"] - before["depth"]
        return F.struct(d.alias("depth"), F.when(span > 0, before["sv"] + (after["sv"] - before["sv"]) * (d - before["depth"]) / F.when(span > 0, span)).otherwise(before["sv"]).alias("sv"))

    return F.when(F.size(layers) <= most, layers).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), at))
