"""As-of, nearest and interpolating joins of time series, and intervals that hold times.

Both sides are stacked and carried forward by window functions within a system and time bucket, so a long series of one
system is split: the last sample before a bucket and the first one after it come from a table with a row a bucket.
Times are seconds (double).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket: the unit of parallel work within a system.
BUCKET = 86_400.0
#: That of dense series, so that a day of one system is not one task's.
SHORT = 600.0


def _two(samples: DataFrame, descending: bool) -> DataFrame:
    """(__by, one, two): each system's two least samples, or greatest. Every task keeps two a system before anything is shuffled."""
    w = Window.partitionBy("__by").orderBy(F.desc("__sample") if descending else F.asc("__sample"))
    x = samples.withColumn("k", F.row_number().over(w)).where("k <= 2")
    return x.groupBy("__by").agg(F.max(F.when(F.col("k") == 1, F.col("__sample"))).alias("one"), F.max(F.when(F.col("k") == 2, F.col("__sample"))).alias("two"))


def neighbours(left: DataFrame, right: DataFrame, values: list[str], by: str = "system", time: str = "time", bucket: float = BUCKET, ends: bool = False) -> DataFrame:
    """left with `before` and `after`: structs (time, values) of the right samples at or before, and at or after, its time. Right times should be unique in a system; of equal ones the greatest values count before, the smallest after.

    With `ends` also the first two and the last two samples of the system: first, second, penultimate, last. Both
    directions are running windows, one in ascending and one in descending time, so the cost follows the rows.
    """
    return _beside(left, right, values, by, time, {time: ""}, bucket, ends=ends)


def _beside(left: DataFrame, right: DataFrame, values: list[str], by: str, time: str, times: dict[str, str], bucket: float, reach: float = 0.0, ends: bool = False) -> DataFrame:
    """neighbours() of several times of a left row at once: before and after with the suffix that `times` gives each of these columns.

    The first time sets a row's bucket; the others lie at most `reach` seconds after it, so a bucket also has the samples
    of so many seconds behind it. Left columns stay columns, so those that nobody asks for later are not moved.
    """
    first, kinds = next(iter(times)), dict(left.dtypes)
    sample = F.struct(F.col(time).alias("time"), *[F.col(v).alias(v) for v in values])
    r = right.where(F.col(time).isNotNull()).select(F.col(by).alias("__by"), F.col(time).alias("__t"), sample.alias("__sample"), F.floor(F.col(time) / bucket).alias("__bucket"))
    low = F.floor((F.col("__t") - reach) / bucket) if reach else F.col("__bucket")
    l = left.select("*", F.col(by).alias("__by"), F.floor(F.col(first) / bucket).alias("__bucket"), F.lit(True).alias("__left"))  # noqa: E741
    if kinds[by] == dict(right.dtypes)[by]:
        l = l.drop(by)  # noqa: E741
    last = r.groupBy("__by", "__bucket").agg(F.max("__sample").alias("__last"))
    edges = r.groupBy("__by", low.alias("__bucket")).agg(F.min("__sample").alias("__first")).unionByName(last, allowMissingColumns=True)
    edges = edges.unionByName(l.select("__by", "__bucket").distinct(), allowMissingColumns=True)
    edges = edges.groupBy("__by", "__bucket").agg(F.max("__first").alias("__first"), F.max("__last").alias("__last"))
    w = Window.partitionBy("__by").orderBy("__bucket")
    late = Window.partitionBy("__by").orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        F.col("__by").alias("__of"), F.col("__bucket").alias("__in"),
        F.last("__last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__prior"),
        F.last("__first", ignorenulls=True).over(late).alias("__next"),
    )
    extra = []
    if ends:
        extra = ["first", "second", "penultimate", "last"]
        for two, names in ((_two(r, False), extra[:2]), (_two(r, True), extra[:1:-1])):
            two = two.toDF("__whose", *names)
            edges = edges.join(two, edges["__of"].eqNullSafe(two["__whose"]), "left").drop("__whose")
    if reach:
        r = r.withColumn("__bucket", F.explode(F.sequence(low, F.col("__bucket"))))
    both = l.unionByName(r, allowMissingColumns=True)
    for column, suffix in times.items():
        at = F.coalesce(F.col(column).cast("double"), F.col("__t").cast("double")) if kinds[column] != "double" or dict(r.dtypes)["__t"] != "double" else F.coalesce(column, "__t")
        up, down = (Window.partitionBy("__by", "__bucket").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (at.asc(), at.desc()))
        both = both.withColumn(f"before{suffix}", F.max("__sample").over(up)).withColumn(f"after{suffix}", F.min("__sample").over(down))
    # max and min of the structs are the latest and the earliest, as time comes first
    out = both.where("__left").join(edges, (F.col("__by").eqNullSafe(F.col("__of"))) & (F.col("__bucket").eqNullSafe(F.col("__in"))), "left")
    found = [F.coalesce(f"{n}{x}", e).alias(f"{n}{x}") for x in times.values() for n, e in (("before", "__prior"), ("after", "__next"))]
    return out.select(*[F.col("__by").alias(by) if c == by and by not in l.columns else F.col(c) for c in left.columns], *found, *extra)


def asof(left: DataFrame, right: DataFrame, values: list[str], by: str = "system", time: str = "time", within: float | None = None, suffix: str = "_asof") -> DataFrame:
    """Backward as-of: the right values at or before each left time, null beyond `within` seconds."""
    x = neighbours(left, right, values, by, time)
    ok = F.lit(True) if within is None else F.col(time) - F.col("before.time") <= within
    return x.select(*left.columns, *[F.when(ok, F.col(f"before.{v}")).alias(v + suffix) for v in values])


def nearest(left: DataFrame, right: DataFrame, values: list[str], by: str = "system", time: str = "time", within: float | None = None, suffix: str = "_near") -> DataFrame:
    """The values of the right sample nearest in time; ties go to the earlier one; null beyond `within` seconds."""
    x = neighbours(left, right, values, by, time)
    back, ahead = F.col(time) - F.col("before.time"), F.col("after.time") - F.col(time)
    first = ahead.isNull() | (back <= ahead)
    near = F.when(first, F.col("before")).otherwise(F.col("after"))
    ok = F.lit(True) if within is None else F.when(first, back).otherwise(ahead) <= within
    return x.withColumn("__near", near).select(*left.columns, *[F.when(ok, F.col(f"__near.{v}")).alias(v + suffix) for v in values])


def interpolate(left: DataFrame, right: DataFrame, values: list[str], headings: tuple[str, ...] = (), by: str = "system", time: str = "time", suffix: str = "_at", bucket: float = SHORT) -> DataFrame:
    """Linear interpolation of the right series at each left time; beyond the ends the line through the two samples there goes on, and a single sample is held. Headings turn the short way and stay in [0, 360)."""
    return interpolate_at(left, right, values, {time: suffix}, 0.0, headings, by, time, bucket)


def interpolate_once(left: DataFrame, right: DataFrame, values: list[str], headings: tuple[str, ...] = (), by: str = "system", time: str = "time", suffix: str = "_at", bucket: float = SHORT) -> DataFrame:
    """interpolate() where many left rows share a time: each time of a system is looked up once, and the rows join what was found, so that samples are sorted with the times and not with the rows."""
    found = interpolate(left.select(by, time).distinct(), right, values, headings, by, time, suffix, bucket)
    found = found.withColumnsRenamed({by: "__by", time: "__at"})
    x = left.join(found, left[by].eqNullSafe(found["__by"]) & left[time].eqNullSafe(found["__at"]), "left")
    return x.select(*left.columns, *[v + suffix for v in values])


def interpolate_at(left: DataFrame, right: DataFrame, values: list[str], times: dict[str, str], reach: float, headings: tuple[str, ...] = (), by: str = "system", time: str = "time", bucket: float = SHORT) -> DataFrame:
    """interpolate() at several times of each left row in one shuffle: columns of left with the suffixes of what is found there. All lie at most `reach` seconds after the first of them; `time` is the right side's."""
    x = _beside(left, right, values, by, time, times, bucket, reach, ends=True)
    for suffix in times.values():
        before, after = F.col(f"before{suffix}"), F.col(f"after{suffix}")
        early, late = before.isNull() & F.col("second").isNotNull(), after.isNull() & F.col("penultimate").isNotNull()
        x = x.withColumns({
            f"__a{suffix}": F.when(early, F.col("first")).when(late, F.col("penultimate")).otherwise(F.coalesce(before, after)),
            f"__b{suffix}": F.when(early, F.col("second")).when(late, F.col("last")).otherwise(F.coalesce(after, before)),
        })
    found = []
    for at, suffix in times.items():
        a, b = (lambda v, s=suffix: F.col(f"__a{s}.{v}")), (lambda v, s=suffix: F.col(f"__b{s}.{v}"))
        span = b("time") - a("time")
        share = F.when(span > 0, (F.col(at) - a("time")) / span).otherwise(0.0)
        for v in values:
            step = F.pmod(b(v) - a(v) + 180.0, F.lit(360.0)) - 180.0 if v in headings else b(v) - a(v)
            y = a(v) + step * share
            found.append((F.pmod(y, F.lit(360.0)) if v in headings else y).alias(v + suffix))
    return x.select(*left.columns, *found)


def beam_times(soundings: DataFrame, delay: str, time: str = "time") -> DataFrame:
    """Soundings at their own time: the ping's and a delay; for interpolate()."""
    return soundings.withColumn(time, F.col(time) + F.coalesce(F.col(delay), F.lit(0.0)))


def validity(versions: DataFrame, by: str = "system", start: str = "ts", slack: float = 3.0, gap: float = 0.001) -> DataFrame:
    """versions with valid_from and valid_to: each holds until just before the next; the first also `slack` seconds earlier."""
    w = Window.partitionBy(by).orderBy(start)
    first = F.row_number().over(w) == 1
    return versions.withColumns({"valid_from": F.when(first, F.col(start) - slack).otherwise(F.col(start)).cast("double"), "valid_to": (F.lead(start).over(w) - gap).cast("double")})


def within_validity(left: DataFrame, versions: DataFrame, values: list[str], by: str = "system", time: str = "time") -> DataFrame:
    """left with the values of the version that holds at its time: a backward as-of on valid_from, null after valid_to."""
    v = versions.select(F.col(by), F.col("valid_from").alias(time), *values, "valid_to")
    x = asof(left, v, [*values, "valid_to"], by, time, suffix="__v")
    ok = F.col("valid_to__v").isNull() | (F.col(time) <= F.col("valid_to__v"))
    return x.select(*left.columns, *[F.when(ok, F.col(f"{c}__v")).alias(c) for c in values])


def line_of(times: DataFrame, lines: DataFrame, by: str = "system", time: str = "time", slack: float = 1.0) -> DataFrame:
    """times with `line`: the last-starting line whose span, widened by `slack`, holds the time; before all lines the first, after all the last, between two null."""
    opened = lines.select(F.col(by), (F.col("start_time") - slack).alias(time), F.col("line").alias("line"), (F.col("end_time") + slack).alias("until"))
    x = neighbours(times, opened, ["line", "until"], by, time)
    last = lines.groupBy(by).agg(F.max(F.struct("start_time", "line")).alias("__end"), F.max("end_time").alias("__until"))
    x = x.join(last, by, "left")
    line = F.when(F.col("before").isNull(), F.col("after.line")).when((F.col(time) <= F.col("before.until")) | (F.col(time) > F.col("__until")), F.col("before.line"))
    return x.select(*times.columns, line.alias("line"))
