"""Ordered time series within systems: gaps, sessions, resets, fills, duplicates, filters and regressions.

A series of one system is split: windows run within a system and day, and what a day needs of the others (the row before
it, the sum so far, the last value) comes from a table with a row a day. Filters over a fixed number of rows run within
blocks of consecutive rows that also hold the rows just outside.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import nearest
from .timejoin import BUCKET, neighbours

#: Rows of a block.
BLOCK = 16_384


def _daily(df: DataFrame, by: list[str], time: str) -> tuple[DataFrame, Window]:
    return df.withColumn("__bucket", F.floor(F.col(time) / BUCKET)), Window.partitionBy(*by, "__bucket").orderBy(time)


def _edges(days: DataFrame, by: list[str], **columns: Column) -> DataFrame:
    """A row a system and day with the columns, windows over the days of a system."""
    return days.select(*[F.col(c).alias(f"__e_{c}") for c in by], F.col("__bucket").alias("__e_bucket"), *[c.alias(k) for k, c in columns.items()])


def _joined(x: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    on = [x[c].eqNullSafe(edges[f"__e_{c}"]) for c in by] + [x["__bucket"].eqNullSafe(edges["__e_bucket"])]
    return x.join(edges, on, "left").drop("__e_bucket", *[f"__e_{c}" for c in by])


def _beside(df: DataFrame, columns: list[str], by: str, time: str, step: int) -> DataFrame:
    """df with __beside: (time, columns) of the row before (step -1) or after (1) in the system."""
    row = F.struct(F.col(time).alias("time"), *[F.col(c).alias(c) for c in columns])
    x, w = _daily(df, [by], time)
    days = x.where(F.col(time).isNotNull()).groupBy(by, "__bucket").agg((F.max if step < 0 else F.min)(row).alias("__row"))
    order = Window.partitionBy(by).orderBy("__bucket")
    edge = _edges(days, [by], __edge=(F.lag if step < 0 else F.lead)("__row").over(order))
    x = _joined(x.withColumn("__beside", (F.lag if step < 0 else F.lead)(row).over(w)), edge, [by])
    return x.withColumn("__beside", F.coalesce("__beside", "__edge")).drop("__edge", "__bucket")


def _so_far(df: DataFrame, value: Column, by: list[str], time: str, name: str) -> DataFrame:
    """df with the sum of a value over the rows of the system up to each."""
    x, w = _daily(df.withColumn("__value", value), by, time)
    days = x.groupBy(*by, "__bucket").agg(F.sum("__value").alias("__sum"))
    edge = _edges(days, by, __edge=F.sum("__sum").over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
    x = _joined(x.withColumn("__run", F.sum("__value").over(w.rowsBetween(Window.unboundedPreceding, 0))), edge, by)
    return x.withColumn(name, F.col("__run") + F.coalesce("__edge", F.lit(0))).drop("__edge", "__bucket", "__run", "__value")


def numbered(df: DataFrame, by: str = "system", time: str = "time", name: str = "__k") -> DataFrame:
    """df with each row's number in its system, from 0."""
    return _so_far(df, F.lit(1).cast("long"), [by], time, "__n").withColumn(name, F.col("__n") - 1).drop("__n")


def consecutive(df: DataFrame, before: int, after: int, by: str, time: str, reflected: bool = False) -> DataFrame:
    """Rows numbered by __k in blocks of consecutive ones, with the rows up to `before` and `after` a block in it too, where __own is false. Reflected: the series goes on at its ends as its mirror image."""
    x = numbered(df, by, time).withColumn("__own", F.lit(True))
    if reflected:
        n = x.groupBy(by).agg(F.count("*").alias("__rows"))
        x = x.join(n, by)
        mirror = F.filter(F.array(F.col("__k"), F.when((F.col("__k") > 0) & (F.col("__k") <= before), -F.col("__k")), F.when((F.col("__k") < F.col("__rows") - 1) & (F.col("__k") >= F.col("__rows") - 1 - after), 2 * (F.col("__rows") - 1) - F.col("__k"))), lambda v: v.isNotNull())
        x = x.withColumn("__place", F.explode(mirror)).withColumn("__own", F.col("__place") == F.col("__k")).withColumn("__k", F.col("__place")).drop("__place")
    size = max(BLOCK, 2 * (before + after))
    own, first, last = (F.floor((F.col("__k") + d) / size) for d in (0, -after, before))
    return x.withColumn("__block", F.explode(F.sequence(first, last))).withColumn("__own", F.col("__own") & (F.col("__block") == own))


def steps(df: DataFrame, most: float = 3.0, by: str = "system", time: str = "time") -> DataFrame:
    """Adds dt, the time since the row before, and leaves out rows without one in (0, most)."""
    return _beside(df, [], by, time, -1).withColumn("dt", F.col(time) - F.col("__beside.time")).drop("__beside").where((F.col("dt") > 0) & (F.col("dt") < most))


def dual_swath(df: DataFrame, by: str = "system", time: str = "time") -> DataFrame:
    """Adds period: dt, or the mean with the next one where the first differences alternate (two swaths a ping); the last stays."""
    x = numbered(df, by, time)
    d = F.array_sort(F.collect_list(F.struct("__k", "dt"))).alias("__d")
    first = x.where(F.col("__k").between(1, 4)).groupBy(by).agg(d)  # four rows a system
    at = lambda i: F.get(F.col("__d"), F.lit(i))["dt"]
    alternate = ((at(0) > at(1)) & (at(2) > at(1)) & (at(2) > at(3))) | ((at(0) < at(1)) & (at(2) < at(1)) & (at(2) < at(3)))
    x = _beside(df, ["dt"], by, time, 1).join(first.select(by, F.coalesce(alternate, F.lit(False)).alias("__alternate")), by, "left")
    mean = F.when(F.col("__beside").isNotNull(), (F.col("dt") + F.col("__beside.dt")) / 2).otherwise(F.col("dt"))
    return x.withColumn("period", F.when(F.col("__alternate"), mean).otherwise(F.col("dt"))).drop("__beside", "__alternate")


def sessions(df: DataFrame, gap: float = 5.0, by: str = "system", time: str = "time") -> DataFrame:
    """Adds segment, from 0: a new one begins where the time since the row before exceeds the gap."""
    x = _beside(df, [], by, time, -1)
    new = F.when(F.col(time) - F.col("__beside.time") > gap, 1).otherwise(0)
    return _so_far(x.withColumn("__new", new).drop("__beside"), F.col("__new"), [by], time, "segment").drop("__new")


def gaps(df: DataFrame, most: float = 1.0, by: str = "system", time: str = "time") -> DataFrame:
    """(by, start, end) of stretches longer than `most` without a sample."""
    x = _beside(df.select(by, time), [], by, time, -1).select(by, F.col("__beside.time").alias("start"), F.col(time).alias("end"))
    return x.where(F.col("end") - F.col("start") > most)


def new_gaps(source: DataFrame, new: DataFrame, most: float = 1.0, by: str = "system", time: str = "time") -> DataFrame:
    """Gaps in `new` that `source` does not have: its gaps, late start and early end, less the source's gaps. An event sweep over both sides' ends."""
    ends = source.groupBy(by).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    own = new.groupBy(by).agg(F.min(time).alias("p"), F.max(time).alias("q"))
    e = ends.join(own, by)
    late = e.where(F.col("p") - F.col("a") > most).select(by, F.col("a").alias("start"), F.col("p").alias("end"))
    early = e.where(F.col("b") - F.col("q") > most).select(by, F.col("q").alias("start"), F.col("b").alias("end"))
    g = gaps(new, most, by, time).unionByName(late).unionByName(early).withColumn("side", F.lit(1))
    s = gaps(source, most, by, time).withColumn("side", F.lit(2))
    both = g.unionByName(s)
    ev = both.select(by, F.col("start").alias("t"), F.when(F.col("side") == 1, 1).otherwise(0).alias("g"), F.when(F.col("side") == 2, 1).otherwise(0).alias("s"))
    ev = ev.unionByName(both.select(by, F.col("end").alias("t"), F.when(F.col("side") == 1, -1).otherwise(0).alias("g"), F.when(F.col("side") == 2, -1).otherwise(0).alias("s")))
    ev = ev.groupBy(by, "t").agg(F.sum("g").alias("g"), F.sum("s").alias("s"))
    w = Window.partitionBy(by).orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.select(by, F.col("t").alias("start"), F.lead("t").over(w).alias("end"), F.sum("g").over(run).alias("g"), F.sum("s").over(run).alias("s"))
    return ev.where((F.col("g") > 0) & (F.col("s") == 0) & F.col("end").isNotNull()).select(by, "start", "end")


def unreset(df: DataFrame, counter: str = "counter", size: int = 65536, by: str = "system", time: str = "time", head: str | None = None, near: float = 2.0) -> DataFrame:
    """Adds to a counter that falls back what it lost at each fall.

    With `head`, a column of a system's heads: falls of several heads less than `near` seconds after the one before are
    one reset, which each head has at its own fall, and a head without one from the first of them on.
    """
    if head is None:
        x = _beside(df, [counter], by, time, -1).withColumn("__fall", F.when(F.col(counter) < F.col(f"__beside.{counter}"), 1).otherwise(0)).drop("__beside")
        return _so_far(x, F.col("__fall"), [by], time, "__falls").withColumn(counter, F.col(counter) + size * F.col("__falls")).drop("__fall", "__falls")
    both = df.withColumn("__head", F.struct(by, head))
    falls = _beside(both, [counter], "__head", time, -1).where(F.col(counter) < F.col(f"__beside.{counter}")).select(by, "__head", F.col(time).alias("time"))
    events = sessions(falls, near - 1e-9, by, "time")
    own = events.groupBy("__head", by, "segment").agg(F.min("time").alias("at"))
    starts = events.groupBy(by, "segment").agg(F.min("time").alias("start")).join(both.select(by, "__head").distinct(), by)
    starts = starts.join(own, ["__head", by, "segment"], "left").select("__head", F.coalesce("at", "start").alias("time"))
    k = starts.groupBy("__head", "time").agg(F.count("*").alias("n"))
    k = k.withColumn("falls", F.sum("n").over(Window.partitionBy("__head").orderBy("time")))  # a row a reset
    x = neighbours(both, k.select("__head", F.col("time").alias(time), "falls"), ["falls"], "__head", time)
    return x.select(*[(F.col(c) + size * F.coalesce("before.falls", F.lit(0))).alias(c) if c == counter else F.col(c) for c in df.columns])


def fill(df: DataFrame, column: str, by: str = "system", time: str = "time") -> DataFrame:
    """Zeros and nulls take the value before, or at the beginning the first one after."""
    x, w = _daily(df.withColumn("__v", F.when(F.col(column) != 0, F.col(column))), [by], time)
    known = F.when(F.col("__v").isNotNull(), F.struct(F.col(time).alias("t"), F.col("__v").alias("v")))
    days = x.groupBy(by, "__bucket").agg(F.max(known).alias("last"), F.min(known).alias("first"))
    order = Window.partitionBy(by).orderBy("__bucket")
    edge = _edges(days, [by], __back=F.last("last.v", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), __ahead=F.last("first.v", True).over(Window.partitionBy(by).orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)))
    down = Window.partitionBy(by, "__bucket").orderBy(F.desc(time))
    x = x.withColumn("__a", F.last("__v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__b", F.last("__v", True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(x, edge, [by]).withColumn(column, F.coalesce("__a", "__back", "__b", "__ahead")).drop("__a", "__b", "__back", "__ahead", "__v", "__bucket")


def unwrap(df: DataFrame, heading: str, by: str = "system", time: str = "time", name: str = "unwrapped") -> DataFrame:
    """Headings without jumps of a turn; a step of exactly half a turn keeps its sign."""
    x = _beside(df, [heading], by, time, -1)
    step = F.col(heading) - F.col(f"__beside.{heading}")
    short = F.pmod(step + 180.0, F.lit(360.0)) - 180.0
    short = F.when((short == -180.0) & (step > 0), 180.0).otherwise(short)
    turn = F.when(F.abs(step) < 180.0, 0.0).otherwise(short - step)
    x = _so_far(x.withColumn("__turn", F.coalesce(turn, F.lit(0.0))).drop("__beside"), F.col("__turn"), [by], time, "__turns")
    return x.withColumn(name, F.col(heading) + F.col("__turns")).drop("__turn", "__turns")


def chunks(df: DataFrame, size: int = 3000, by: str = "system", version: str | None = None, time: str = "time") -> DataFrame:
    """Adds chunk: runs of `size` consecutive pings within a system and parameter version."""
    x = _so_far(df, F.lit(1).cast("long"), [by, version] if version else [by], time, "__n")
    return x.withColumn("chunk", F.floor((F.col("__n") - 1) / size)).drop("__n")


def nudge(df: DataFrame, by: str = "system", time: str = "time", order: str = "counter") -> DataFrame:
    """Equal times of a system move on by a microsecond each."""
    return df.withColumn(time, F.col(time) + 1e-6 * (F.row_number().over(Window.partitionBy(by, time).orderBy(order)) - 1))


def first_of_equal(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in an explicit order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def every_nth(df: DataFrame, n: int, by: str = "system", time: str = "time") -> DataFrame:
    return numbered(df, by, time).where(F.col("__k") % n == 0).drop("__k")


def rate(df: DataFrame, column: str, by: str = "system", time: str = "time") -> DataFrame:
    """Adds rate: the change to the next row in a second."""
    x = _beside(df, [column], by, time, 1)
    return x.withColumn("rate", (F.col(f"__beside.{column}") - F.col(column)) / (F.col("__beside.time") - F.col(time))).drop("__beside")


def high_pass(max_period: float, step: float, taps: int = 101) -> list[float]:
    """Coefficients of a Hann-windowed high-pass filter, unit gain at the highest frequency."""
    cut = 2 * step / max_period
    m = (taps - 1) / 2
    low = []
    for k in range(taps):
        x = k - m
        sinc = cut if x == 0 else math.sin(math.pi * cut * x) / (math.pi * x)
        low.append(sinc * (0.5 - 0.5 * math.cos(2 * math.pi * k / (taps - 1))))
    total = sum(low)
    low = [-v / total for v in low]
    low[int(m)] += 1
    return low


def filtered(df: DataFrame, column: str, coefficients: list[float], name: str = "filtered", by: str = "system", time: str = "time") -> DataFrame:
    """Causal filter over the rows before, which count 0 before the first."""
    n = len(coefficients)
    w = Window.partitionBy(by, "__block").orderBy("__k").rowsBetween(1 - n, 0)
    taps = F.expr("array(" + ",".join(f"{c!r}D" for c in coefficients) + ")")
    x = consecutive(df, n - 1, 0, by, time).withColumn("__x", F.reverse(F.collect_list(F.coalesce(F.col(column).cast("double"), F.lit(0.0))).over(w))).where("__own")
    return x.withColumn(name, F.aggregate(F.zip_with("__x", taps, lambda v, c: F.coalesce(v, F.lit(0.0)) * c), F.lit(0.0), lambda a, v: a + v)).drop("__x", "__k", "__own", "__block")


WINDOWS = {
    "flat": lambda n: [1.0] * n,
    "hanning": lambda n: [0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)],
    "hamming": lambda n: [0.54 - 0.46 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)],
    "bartlett": lambda n: [1 - abs(2 * k / (n - 1) - 1) for k in range(n)],
    "blackman": lambda n: [0.42 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) + 0.08 * math.cos(4 * math.pi * k / (n - 1)) for k in range(n)],
}


def smooth(df: DataFrame, column: str, size: int = 20, window: str = "hanning", name: str = "smooth", by: str = "system", time: str = "time") -> DataFrame:
    """Weighted mean over `size` rows around each, with the series reflected at its ends. Nulls count 0; systems with fewer rows get null."""
    k = WINDOWS[window](size)
    after = int(size / 2 - 1)
    before = size - 1 - after
    w = Window.partitionBy(by, "__block").orderBy("__k")
    v = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    terms = sum(F.coalesce(F.lag(v, before - i).over(w), F.lit(0.0)) * (c / sum(k)) for i, c in enumerate(k))
    x = consecutive(df, before, after, by, time, reflected=True).withColumn(name, F.when(F.col("__rows") >= size, terms)).where("__own")
    return x.drop("__k", "__own", "__block", "__rows")


def regression(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Per key: slope, intercept, standard error (n - 1) and its percentage of the mean of y."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    s = df.where(ok).groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"), F.avg(y).alias("mean_y"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"),
    )
    rest = F.greatest(F.col("syy") - F.pow("sxy", 2) / F.when(F.col("sxx") > 0, F.col("sxx")), F.lit(0.0))
    s = s.withColumn("std_error", F.sqrt(rest / F.when(F.col("n") > 1, F.col("n") - 1)))
    return s.select(*keys, "slope", "intercept", "std_error", (F.abs(F.col("std_error") / F.col("mean_y")) * 100).alias("percent_deviation"), "n")


def period(df: DataFrame, column: str, by: str = "system", time: str = "time", most: int = 4096) -> DataFrame:
    """(by, period) of a series: lag of the highest autocorrelation peak among lags of less than `most` samples, times the mean step; null without a peak.

    Every sample counts: blocks of consecutive ones, with the `most` after them, give partial sums by lag, which add up.
    """
    kind = df.schema[by].dataType.simpleString()
    x = df.select(F.col(by).alias("k"), F.col(time).cast("double").alias("t"), F.col(column).cast("double").alias("v"))
    about = x.groupBy("k").agg(F.avg("v").alias("mean"), ((F.max("t") - F.min("t")) / (F.count("*") - 1)).alias("step"), F.count("*").alias("n"))
    x = consecutive(x, 0, most, "k", "t").join(about.select("k", "mean"), "k")

    def sums(p):
        import numpy as np
        import pandas as pd

        p = p.sort_values("__k")
        v = (p["v"] - p["mean"]).fillna(0.0).to_numpy(float)
        own = np.where(p["__own"].to_numpy(bool), v, 0.0)
        size = 2 * len(v)
        c = np.fft.irfft(np.conj(np.fft.rfft(own, size)) * np.fft.rfft(v, size), size)[: min(len(v), most)]
        return pd.DataFrame({"k": [p["k"].iloc[0]] * len(c), "lag": range(len(c)), "c": c})

    c = x.select("k", "__k", "__own", "__block", "v", "mean").groupBy("k", "__block").applyInPandas(lambda key, p: sums(p), f"k {kind}, lag long, c double")
    c = c.groupBy("k", "lag").agg(F.sum("c").alias("c"))  # `most` rows a system
    w = Window.partitionBy("k").orderBy("lag")
    peak = c.withColumns({"a": F.lag("c").over(w), "b": F.lead("c").over(w)}).where((F.col("c") > F.col("a")) & (F.col("c") >= F.col("b")))
    best = peak.groupBy("k").agg(F.max(F.struct("c", -F.col("lag"))).alias("best")).select("k", (-F.col("best.col2")).alias("lag"))
    return about.where("n >= 4").join(best, "k", "left").select(F.col("k").alias(by), (F.col("lag") * F.col("step")).alias("period"))


def _nearest_in_time(means: DataFrame, casts: DataFrame, keys: list[str], hours: float | None) -> DataFrame:
    right = casts.groupBy(F.col("cast_time").alias("time")).agg(F.min("cast_id").alias("cast_id")).withColumn("__all", F.lit(0))
    x = neighbours(means.withColumn("__all", F.lit(0)), right, ["cast_id"], "__all")
    back, ahead = F.col("time") - F.col("before.time"), F.col("after.time") - F.col("time")
    near = F.least(F.when(F.col("before").isNotNull(), F.struct(back.alias("d"), F.col("before.cast_id").alias("id"))), F.when(F.col("after").isNotNull(), F.struct(ahead.alias("d"), F.col("after.cast_id").alias("id"))))
    x = x.select(*keys, near.alias("near"))
    return x.select(*keys, (F.col("near.id") if hours is None else F.when(F.col("near.d") <= hours * 3600, F.col("near.id"))).alias("cast_id"))


def _met(means: DataFrame, casts: DataFrame, keys: list[str], on: list[str], where: Callable | None = None) -> DataFrame:
    """keys, near: (km, cast_id) of the nearest of the casts that share `on`, null where there is none."""
    from ..functions import geo

    x = means.join(casts.select(*on, "cast_id", "cast_time", F.col("lat").alias("__lat"), F.col("lon").alias("__lon")), on, "left")
    km = geo.haversine_km(F.col("lon"), F.col("lat"), F.col("__lon"), F.col("__lat"))
    ok = F.col("cast_id").isNotNull() if where is None else F.col("cast_id").isNotNull() & where()
    return x.groupBy(*keys).agg(F.min(F.when(ok, F.struct(km.alias("km"), F.col("cast_id").alias("id")))).alias("near"))


#: Degrees of the cells in which the nearest cast is sought, one size after another.
CELLS = (0.5, 4.0, 30.0)


def _nearest_in_distance(means: DataFrame, casts: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks meet the casts of their cell and the eight around it; where the nearest found is nearer than any cast outside can be, it is the nearest of all; the others go on with larger cells, and at last meet all."""
    left, out = means, None
    for s in CELLS:
        n = int(360 / s)
        y = lambda c, s=s: F.floor((F.col(c) + 90.0) / s)
        x = lambda c, s=s, n=n: F.pmod(F.floor(F.pmod(F.col(c), F.lit(360.0)) / s), F.lit(n))
        around = F.flatten(F.array(*[F.array(*[F.struct((y("lat") + dy).alias("y"), F.pmod(x("lon") + dx, F.lit(n)).alias("x")) for dx in (-1, 0, 1)]) for dy in (-1, 0, 1)]))
        cells = left.withColumn("__cell", F.explode(around))
        met = _met(cells, casts.withColumn("__cell", F.struct(y("lat").alias("y"), x("lon").alias("x"))), keys, ["__cell"])
        safe = 6371.0 * F.least(F.lit(math.radians(s)), F.asin(F.cos(F.radians("lat")) * math.sin(math.radians(s))))
        met = met.toDF(*[f"__m_{c}" for c in keys], "near")
        same = F.lit(True)
        for c in keys:  # keys may be null
            same = same & left[c].eqNullSafe(met[f"__m_{c}"])
        met = left.join(met, same).drop(*[f"__m_{c}" for c in keys]).withColumn("__safe", F.coalesce(F.col("near.km") <= safe * (1 - 1e-9), F.lit(False)))
        done = met.where("__safe").select(*keys, F.col("near.id").alias("cast_id"))
        out = done if out is None else out.unionByName(done)
        left = met.where(~F.col("__safe")).drop("near", "__safe")
    met = _met(left.withColumn("__cell", F.lit(0)), casts.withColumn("__cell", F.lit(0)), keys, ["__cell"])
    return out.unionByName(met.select(*keys, F.col("near.id").alias("cast_id")))


def nearest_cast(chunk_means: DataFrame, casts: DataFrame, method: str = "nearest_in_time", hours: float = 4.0) -> DataFrame:
    """Each chunk (time, lat, lon and its keys) with the id of its cast: the nearest in time or distance, in all or within some hours of the chunk; ties to the smaller id. Null where there is none, or where the chunk has no time or position.

    For distances, casts go to every task as a tree as long as they are few enough, and chunks are not moved; more of
    them meet by cells of the earth, one size after another, or by time slots.
    """
    keys = chunk_means.columns
    if "time" in method:
        return _nearest_in_time(chunk_means, casts, keys, hours if "fourhours" in method else None)
    span, kind = hours * 3600, casts.schema["cast_id"].dataType.simpleString()
    within = "fourhours" in method
    # of casts of one place (and time) only the smallest id can be the nearest, so a place counts once whatever number of casts it has
    place = ["lat", "lon", "cast_time"] if within else ["lat", "lon"]
    casts = casts.groupBy(*place).agg(F.min("cast_id").alias("cast_id"), *([] if within else [F.min("cast_time").alias("cast_time")]))
    few = nearest.held(casts, ["cast_id", "lat", "lon", "cast_time"] if within else ["cast_id", "lat", "lon"])
    if few is not None:
        return nearest.in_space_and_time(chunk_means, few, span, kind, "cast_id") if within else nearest.in_space(chunk_means, few, kind, "cast_id")
    casts = casts.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    # chunks without a time or position meet nothing, but stay
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("time").isNotNull() if within else F.lit(True))
    rest = chunk_means.where(~known).withColumn("cast_id", F.lit(None).cast(kind))
    x = chunk_means.where(known)
    if not within:
        found = _nearest_in_distance(x, casts, keys)
    else:
        x = x.withColumn("__slot", F.explode(F.array(*[F.floor(F.col("time") / span) + d for d in (-1, 0, 1)])))
        met = _met(x, casts.withColumn("__slot", F.floor(F.col("cast_time") / span)), keys, ["__slot"], lambda: F.abs(F.col("time") - F.col("cast_time")) <= span)
        found = met.select(*keys, F.col("near.id").alias("cast_id"))
    return found.select(*keys, "cast_id").unionByName(rest)


def zero_centred(df: DataFrame, column: str) -> DataFrame:
    """df with the column less its mean: one aggregate, whose one number is joined to every row."""
    return df.join(F.broadcast(df.agg(F.avg(column).alias("__mean"))), F.lit(True)).withColumn(column, F.col(column) - F.col("__mean")).drop("__mean")
