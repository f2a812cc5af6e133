"""A vessel's history: installation parameters of all its sonars over time, as rows (system, ts, param, value).

Values are text or numbers, as given. A dataset's own parameters have the same form, with the sonar's type and the source
of the values apart; both forms turn into each other without loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import params, tables, upsert

#: Rows of a vessel that describe the sonar, and other parameters that a new set takes over from the last one.
DESCRIPTION = ("sonar_type", "source")
OPTIONAL = ("source", "vessel_file", "sonar_type", "imu_h", "imu_p", "imu_r", "imu_x", "imu_y", "imu_z", "tx_to_antenna_x", "tx_to_antenna_y", "tx_to_antenna_z", "vess_center_x", "vess_center_y", "vess_center_z", "vess_center_yaw", "vess_center_p", "vess_center_r", "sensor_size")
KEYS = ["system", "ts", "param"]


# --- forms


def to_vessel(parameters: DataFrame, description: DataFrame) -> DataFrame:
    """A dataset's parameters with its description (system, sonar_type, source) as rows of every set. Values become text."""
    x = parameters.select("system", "ts", "param", F.col("value").cast("string").alias("value"))
    sets = x.select("system", "ts").distinct().join(description, "system")
    more = sets.select("system", "ts", F.explode(F.create_map(*[v for d in DESCRIPTION for v in (F.lit(d), F.col(d))])).alias("param", "value"))
    return x.unionByName(more)


def from_vessel(vessel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(system, ts, param, value) without the description, and (system, ts, sonar_type, source)."""
    own = F.col("param").isin(*DESCRIPTION)
    description = vessel.where(own).groupBy("system", "ts").agg(*[F.max(F.when(F.col("param") == d, F.col("value"))).alias(d) for d in DESCRIPTION])
    return vessel.where(~own), description


def split(parameters: DataFrame) -> DataFrame:
    """(system, ts, n, values): a row a set, numbered from 0 in time, with its parameters by name."""
    s = parameters.groupBy("system", "ts").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("param", "value")))).alias("values"))  # some dozens a set
    return s.withColumn("n", F.row_number().over(Window.partitionBy("system").orderBy("ts")) - 1)


def joined(sets: DataFrame) -> DataFrame:
    """What split() took apart."""
    return sets.select("system", "ts", F.explode("values").alias("param", "value"))


def trimmed(parameters: DataFrame, start: float, end: float) -> DataFrame:
    """Each system's last set at or before `start`, and those after it that begin before `end`; systems without a set before `start` give none."""
    last = parameters.where(F.col("ts") <= start).groupBy("system").agg(F.max("ts").alias("__from"))
    return parameters.join(last, "system").where((F.col("ts") == F.col("__from")) | ((F.col("ts") > F.col("__from")) & (F.col("ts") < end))).drop("__from")


# --- changes


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(system, offsets, angles, tpu, values, waterline) of systems in both: whether a parameter of both has other values, or other times, in `new`, whether its values in order of time differ, and the new waterline, if its first value is another one."""
    kind = params.kind()
    kind = F.when(kind == "latency", "angle").when(F.col("param").isin(*OPTIONAL) & (kind == "tpu") & ~F.col("param").startswith("tx_to_antenna"), "other").otherwise(kind)
    one = old.groupBy("system", "param").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("one"))
    two = new.groupBy("system", "param").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("two"))
    x = one.join(two, ["system", "param"]).withColumn("kind", kind)
    differ = F.size(F.array_except("one", "two")) > 0
    values = F.transform("one", lambda v: v["value"]) != F.transform("two", lambda v: v["value"])
    first = lambda c: F.col(c)[0]["value"]
    any_ = lambda k: F.coalesce(F.bool_or(F.when(F.col("kind") == k, differ)), F.lit(False))
    return x.groupBy("system").agg(
        any_("offset").alias("offsets"), any_("angle").alias("angles"), any_("tpu").alias("tpu"), F.bool_or(values).alias("values"),
        F.max(F.when((F.col("kind") == "waterline") & (first("one") != first("two")), first("two"))).alias("waterline"),
    )


def carried(old: DataFrame, new: DataFrame) -> DataFrame:
    """new with every uncertainty and optional parameter of old, at old's last value, at each of new's times."""
    optional = (params.kind() == "tpu") | F.col("param").isin(*OPTIONAL)
    last = old.groupBy("system").agg(F.max("ts").alias("ts"))
    kept = old.join(last, ["system", "ts"]).where(optional).select("system", "param", "value")
    times = new.select("system", "ts").distinct()
    over = times.join(kept, "system").select(*KEYS, "value")
    return new.join(over, KEYS, "left_anti").select(*KEYS, "value").unionByName(over)


def updated(vessel: DataFrame, new: DataFrame, carry: bool = True) -> DataFrame:
    """The vessel's rows after parameters of some systems came in: new systems are added; where offsets, angles, uncertainties or the waterline of a known one differ, its rows are replaced or inserted, and of equal sets the earliest stays. Others change nothing."""
    d = differences(vessel, new)
    changed = tables.kept(d.where(F.col("offsets") | F.col("angles") | F.col("tpu") | F.col("waterline").isNotNull()).select("system"))  # a row a sonar
    fresh = new.join(vessel.select("system").distinct(), "system", "left_anti").select(*KEYS, "value")
    some = new.join(changed, "system", "left_semi")
    some = carried(vessel.join(changed, "system", "left_semi"), some) if carry else some
    after = upsert.merged(vessel.join(changed, "system", "left_semi"), some.select(*KEYS, "value"), KEYS).select(*KEYS, "value")
    same = vessel.join(changed, "system", "left_anti").select(*KEYS, "value")
    return same.unionByName(fresh).unionByName(params.earliest_of_equal(after).select(*KEYS, "value"))


# --- intervals


def intervals(parameters: DataFrame, until: float | None = None) -> DataFrame:
    """(system, param, value, start, end): from when to when each value holds; equal neighbours are one. The last one holds until `until`, or for ever (null)."""
    w = Window.partitionBy("system", "param").orderBy("ts")
    x = parameters.withColumn("__before", F.lag(F.struct("value")).over(w)).where(F.col("__before").isNull() | ~F.col("__before.value").eqNullSafe(F.col("value")))
    end = F.lead("ts").over(w)
    return x.select("system", "param", "value", F.col("ts").alias("start"), (end if until is None else F.coalesce(end, F.lit(float(until)))).alias("end"))


def cut(spans: DataFrame, at: float) -> DataFrame:
    """Intervals with those that hold a time cut in two there."""
    holds = (F.col("start") < at) & (F.col("end").isNull() | (F.col("end") > at))
    two = F.array(F.struct(F.col("start").alias("s"), F.lit(float(at)).alias("e")), F.struct(F.lit(float(at)).alias("s"), F.col("end").alias("e")))
    x = spans.withColumn("__p", F.explode(F.when(holds, two).otherwise(F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e"))))))
    return x.select("system", "param", "value", F.col("__p.s").alias("start"), F.col("__p.e").alias("end"))


def overlaid(base: DataFrame, other: DataFrame) -> DataFrame:
    """Intervals of `other` where it has some, those of `base` elsewhere; equal neighbours are one. A sweep over the ends of both, so that no interval meets another."""
    value = lambda on: F.when(F.lit(on), F.struct("value"))
    events = None
    for side, x in (("b", base), ("o", other)):
        for at, opens in (("start", True), ("end", False)):
            e = x.where(F.col(at).isNotNull()).select("system", "param", F.col(at).alias("t"), F.lit(side).alias("side"), F.lit(opens).alias("opens"), value(opens).alias("v"))
            events = e if events is None else events.unionByName(e)
    # at one time an end gives way to what begins there
    at = events.groupBy("system", "param", "t").agg(*[F.max(F.when(F.col("side") == s, F.struct("opens", "v"))).alias(s) for s in ("b", "o")])
    w = Window.partitionBy("system", "param").orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = at.select("system", "param", "t", *[F.last(s, True).over(run)["v"].alias(s) for s in ("b", "o")])
    x = x.withColumn("v", F.coalesce("o", "b"))
    x = x.withColumn("__before", F.lag(F.struct("v")).over(w)).where(F.col("__before").isNull() | ~F.col("__before.v").eqNullSafe(F.col("v")))
    x = x.withColumn("end", F.lead("t").over(w)).where(F.col("v").isNotNull())
    return x.select("system", "param", F.col("v.value").alias("value"), F.col("t").alias("start"), "end")


def at_starts(spans: DataFrame) -> DataFrame:
    """Intervals as rows (system, ts, param, value); where one ends and none begins, a null value. The inverse of intervals()."""
    x = spans.select("system", F.col("start").alias("ts"), "param", "value")
    gone = spans.where(F.col("end").isNotNull()).select("system", F.col("end").alias("ts"), "param")
    return x.unionByName(gone.join(x.select(*KEYS), KEYS, "left_anti").select(*KEYS, F.lit(None).cast(spans.schema["value"].dataType).alias("value")))
