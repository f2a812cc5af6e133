"""Aggregates over soundings, pings and lines, and acceptance tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUS = {0: "converted", 1: "orientation", 2: "beamvector", 3: "soundvelocity", 4: "georeference", 5: "tpu"}


def dashboard(soundings: DataFrame, by: str = "system", status: str = "processing_status") -> DataFrame:
    """Soundings of every system in every status, those without any as 0."""
    systems = soundings.select(by).distinct()
    kinds = F.explode(F.array(*map(F.lit, STATUS)))
    n = soundings.groupBy(by, F.col(status).cast("int").alias("status")).agg(F.count("*").alias("n"))
    return systems.select(by, kinds.alias("status")).join(n, [by, "status"], "left").select(by, "status", F.coalesce("n", F.lit(0)).alias("soundings"))


def rounded_frequencies(soundings: DataFrame, column: str = "frequency") -> DataFrame:
    """Distinct frequencies of the greatest number of digits, rounded to one significant digit."""
    f = soundings.select(F.col(column).cast("long").alias("f")).where("f is not null").distinct()
    digits = F.length(F.col("f").cast("string"))
    top = f.agg(F.max(digits).alias("d"))
    x = f.join(F.broadcast(top), digits == F.col("d"))
    unit = F.pow(F.lit(10.0), F.col("d") - 1)
    return x.select((F.rint(F.col("f") / unit) * unit).cast("long").alias("frequency")).distinct()


def reduce_beams(soundings: DataFrame, column: str, how: str, by: str = "system", time: str = "time", beam: str = "beam") -> DataFrame:
    """One value a ping: mean, nadir, port_outer_beam, starboard_outer_beam, or the last valid one (starboard_valid)."""
    if how == "mean":
        return soundings.groupBy(by, time).agg(F.avg(column).alias(column))
    if how == "port_outer_beam":
        return soundings.where(F.col(beam) == 0).select(by, time, column)
    if how == "starboard_valid":
        v = F.col(column)
        ok = v.isNotNull() & (v != 0)
        return soundings.groupBy(by, time).agg(F.coalesce(F.max_by(F.when(ok, v), F.when(ok, F.col(beam))), F.max(F.when(F.col(beam) == 0, v))).alias(column))
    n = soundings.groupBy(by).agg((F.max(beam) + 1).alias("__n"))
    at = F.greatest(F.floor(F.col("__n") / 2 - 1), F.lit(0)) if how == "nadir" else F.col("__n") - 1
    return soundings.join(F.broadcast(n), by).where(F.col(beam) == at).select(by, time, column)


def extents(soundings: DataFrame) -> DataFrame:
    return soundings.agg(*[f(c).alias(f"{n}_{c}") if c != "z" else F.bround(f(c).cast("double"), 3).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def bin_of(v: Column, low: float, high: float, bins: int) -> Column:
    """Half-open bin, null outside."""
    i = F.floor((v - low) * (bins / (high - low)))
    return F.when((i >= 0) & (i < bins), i).cast("int")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    return df.select(bin_of(F.col(column), low, high, bins).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: tuple[int, int], ranges: tuple[tuple[float, float], tuple[float, float]]) -> DataFrame:
    """Counts of half-open bins; points on an upper edge are left out."""
    b = df.select(bin_of(F.col(x), *ranges[0], bins[0]).alias("i"), bin_of(F.col(y), *ranges[1], bins[1]).alias("j"))
    return b.where("i is not null and j is not null").groupBy("i", "j").agg(F.count("*").alias("n"))


def digitize(v: Column, edges: list[float]) -> Column:
    """Number of edges at or below a value; NaN and null count as beyond the last."""
    e = F.array(*[F.lit(float(x)) for x in edges])
    return F.when(v.isNull() | F.isnan(v), len(edges)).otherwise(F.size(F.filter(e, lambda x: x <= v)))


def extinction(soundings: DataFrame, group: str, bin_size: float = 10.0, two_sided: bool = True, across: str = "acrosstrack", depth: str = "depth") -> DataFrame:
    """Per depth bin the outermost soundings to port and starboard, with their group; bins without both sides can be left out."""
    a = F.col(across)
    s = F.struct(a.alias("across"), F.col(depth).alias("depth"), F.col(group).alias("group"))
    x = soundings.where(F.col(depth) > 0).groupBy(F.floor(F.col(depth) / bin_size).alias("bin")).agg(F.min(s).alias("port"), F.max(s).alias("starboard"))
    if two_sided:
        x = x.where((F.col("port.across") < 0) & (F.col("starboard.across") > 0))
    return x.select("bin", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("port", "starboard") for c in ("across", "depth", "group")])


def ping_period(pings: DataFrame, group: str, bin_size: float = 5.0, depth: str = "depth") -> DataFrame:
    """Mean ping period of every group and depth bin."""
    return pings.groupBy(F.col(group).alias("group"), F.floor(F.col(depth) / bin_size).alias("bin")).agg(F.avg("dt").alias("period"), F.count("*").alias("n"))


def difference_to_grid(soundings: DataFrame, cells: DataFrame, resolution: float) -> DataFrame:
    """Soundings with diff, their depth less their cell's; those without a cell are left out."""
    from .grid import cell

    x = soundings.withColumns({"cell_x": cell("x", resolution), "cell_y": cell("y", resolution)})
    return x.join(cells.where("depth is not null").select("cell_x", "cell_y", F.col("depth").alias("grid_depth")), ["cell_x", "cell_y"]).withColumn("diff", F.col("z") - F.col("grid_depth"))


def accuracy(differences: DataFrame, by: Column, name: str = "bin") -> DataFrame:
    """Per bin: mean and population deviation of the differences less their overall mean."""
    mean = differences.agg(F.avg("diff").alias("__m"))
    x = differences.join(F.broadcast(mean)).withColumn("__d", F.col("diff") - F.col("__m"))
    return x.groupBy(by.alias(name)).agg(F.avg("__d").alias("mean"), F.stddev_pop("__d").alias("std"), F.count("*").alias("n"))


def accuracy_by_group(differences: DataFrame, group: Column, by: Column, name: str = "bin") -> DataFrame:
    """The same for every group of a test, such as lines of one mode and frequency: differences less their group's mean, which is joined as a row a group."""
    x = differences.withColumn("group", group)
    mean = x.groupBy(F.col("group").alias("__g")).agg(F.avg("diff").alias("__m"))
    x = x.join(mean, F.col("group").eqNullSafe(F.col("__g"))).withColumn("__d", F.col("diff") - F.col("__m"))
    return x.groupBy("group", by.alias(name)).agg(F.avg("__d").alias("mean"), F.stddev_pop("__d").alias("std"), F.count("*").alias("n"))


def compared_solution(pings: DataFrame, other: DataFrame, values: list[str], every: int = 1, by: str = "system", within: float | None = None) -> DataFrame:
    """(by, variable, mean, std, most, n): how a solution of another source, at its sample nearest to every so-manieth ping, differs from the pings' own values."""
    from . import series, timejoin

    x = series.every_nth(pings, every, by) if every > 1 else pings
    x = timejoin.nearest(x, other, values, by, within=within, suffix="__o")
    d = x.select(by, F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), (F.col(f"{v}__o") - F.col(v)).alias("d")) for v in values])).alias("p")).select(by, "p.*").where("d is not null")
    return d.groupBy(by, "variable").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.max(F.abs("d")).alias("most"), F.count("*").alias("n"))


#: Fixed and depth-dependent parts of the vertical limits.
ORDERS = {"special": (0.25, 0.0075), "order_1": (0.5, 0.013)}


def order_limit(depth: Column, order: str) -> Column:
    a, b = ORDERS[order]
    return F.sqrt(F.lit(a * a) + F.pow(depth * b, 2))


def line_metadata(positions: DataFrame, by: str = "line", time: str = "time") -> DataFrame:
    """Per line: times, first and last valid position, and the track's length in whole metres."""
    from ..functions import geo

    p = positions.where("lat is not null and lon is not null")
    w = Window.partitionBy(by).orderBy(time)
    p = p.withColumns({"__lat": F.lag("lat").over(w), "__lon": F.lag("lon").over(w)})
    p = p.withColumn("__d", F.when(F.col("__lat").isNotNull(), geo.geodesic_m(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon"))).otherwise(0.0))
    return p.groupBy(by).agg(
        F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.min_by("lat", time).alias("start_lat"), F.min_by("lon", time).alias("start_lon"),
        F.max_by("lat", time).alias("end_lat"), F.max_by("lon", time).alias("end_lon"), F.bround(F.sum("__d"), 0).alias("distance_m"),
    )


def merged_attributes(attributes: DataFrame, by: str = "name") -> DataFrame:
    """One value for each name over many datasets: the least for min*, the greatest for max*, else the first by dataset."""
    number = F.col("value").try_cast("double")
    first = F.min_by("value", "dataset")
    low, high = F.min_by("value", number), F.max_by("value", number)
    return attributes.groupBy(by).agg(F.when(F.col(by).startswith("min"), low).when(F.col(by).startswith("max"), high).otherwise(first).alias("value"))


def points_view(soundings: DataFrame) -> DataFrame:
    """One row of statistics of a selection of soundings."""
    return soundings.agg(
        F.count("*").alias("points"), *[f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
        F.sum((F.col("detectioninfo") == 2).cast("long")).alias("rejected"), F.min("beam").alias("min_beam"), F.max("beam").alias("max_beam"),
    )
