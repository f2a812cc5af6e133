"""Queries on joins and functions of time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as R
from ..operators import timejoin as J
from ..operators.diagnostics import WOBBLE_TESTS
from . import stand_ins as S

E = S.SERIES_SQL


def _sides(spark, sf_dir):
    s = S.series(spark, sf_dir)
    return s.where("mode = 'click'").select("system", "time", "counter"), s.where("mode in ('view', 'error')").select("system", "time", "value")


L = f"(SELECT system, time, counter FROM {E} WHERE mode = 'click')"
Q = f"(SELECT system, time, value FROM {E} WHERE mode IN ('view', 'error'))"
#: Both neighbours of each left row.
BOTH = f"""(SELECT l.*, b.time AS bt, b.value AS bv, a.time AS nt, a.value AS av FROM {L} l
            ASOF LEFT JOIN {Q} b ON l.system = b.system AND l.time >= b.time ASOF LEFT JOIN {Q} a ON l.system = a.system AND l.time <= a.time)"""
#: The same with the first two and the last two samples of the system (the last one first).
ENDS = f"(SELECT b.*, lt, lv, ht, hv FROM {BOTH} b LEFT JOIN (SELECT system, min(time, 2) AS lt, arg_min(value, time, 2) AS lv, max(time, 2) AS ht, arg_max(value, time, 2) AS hv FROM {Q} GROUP BY 1) e ON e.system = b.system)"
LERP = """CASE WHEN bt IS NULL AND lt[2] IS NOT NULL THEN lv[1] + (lv[2] - lv[1]) * ((time - lt[1]) / (lt[2] - lt[1])) WHEN nt IS NULL AND ht[2] IS NOT NULL THEN hv[2] + (hv[1] - hv[2]) * ((time - ht[2]) / (ht[1] - ht[2]))
    WHEN bt IS NULL THEN av WHEN nt IS NULL THEN bv WHEN nt = bt THEN bv ELSE bv + (av - bv) * ((time - bt) / (nt - bt)) END"""


def asof_join(spark, sf_dir):
    """The sample at or before each time."""
    l, r = _sides(spark, sf_dir)  # noqa: E741
    return J.asof(l, r, ["value"]).select("counter", "value_asof")


def asof_within(spark, sf_dir):
    """The same, null beyond six hours."""
    l, r = _sides(spark, sf_dir)  # noqa: E741
    return J.asof(l, r, ["value"], within=21_600.0).select("counter", "value_asof")


def nearest_join(spark, sf_dir):
    """The sample nearest in time, the earlier of two as near."""
    l, r = _sides(spark, sf_dir)  # noqa: E741
    return J.nearest(l, r, ["value"]).select("counter", "value_near")


def nearest_within(spark, sf_dir):
    """The same, null beyond two hours."""
    l, r = _sides(spark, sf_dir)  # noqa: E741
    return J.nearest(l, r, ["value"], within=7_200.0).select("counter", "value_near")


def interpolated_join(spark, sf_dir):
    """Linear interpolation at each time."""
    l, r = _sides(spark, sf_dir)  # noqa: E741
    return J.interpolate(l, r, ["value"]).select("counter", F.bround("value_at", 6).alias("value_at"))


def interpolated_heading(spark, sf_dir):
    """The same of headings, which turn the short way."""
    l, r = _sides(spark, sf_dir)  # noqa: E741
    r = r.withColumn("value", F.pmod(F.col("value") * 7, F.lit(360.0)))
    return J.interpolate(l, r, ["value"], headings=("value",)).select("counter", F.bround("value_at", 5).alias("value_at"))


def beam_interpolation(spark, sf_dir):
    """Interpolation at each beam's own time: the ping's and a delay."""
    l, r = _sides(spark, sf_dir)  # noqa: E741
    b = l.withColumn("beam", F.explode(F.array(*map(F.lit, range(4))))).withColumn("delay", F.col("beam") * 1800.0)
    return J.interpolate(J.beam_times(b, "delay"), r, ["value"]).select("counter", "beam", F.bround("value_at", 6).alias("value_at"))


def parameter_versions(spark, sf_dir):
    """The parameter version in force at each ping; versions are the purchases."""
    s = S.series(spark, sf_dir)
    v = J.validity(s.where("mode = 'purchase'").select("system", F.col("time").alias("ts"), F.col("counter").alias("version")))
    return J.within_validity(s.where("mode = 'click'").select("system", "time", "counter"), v, ["version"]).select("counter", "version")


def lines_of_times(spark, sf_dir):
    """The line in which each sample lies."""
    s = S.series(spark, sf_dir).select("system", "time", "counter")
    return J.line_of(s, S.lines(spark, sf_dir)).select("counter", "line")


def cast_nearest_in_time(spark, sf_dir):
    """The cast nearest in time to each chunk's mean; casts are made of the customers."""
    return _cast(spark, sf_dir, "nearest_in_time")


def cast_nearest_in_distance(spark, sf_dir):
    return _cast(spark, sf_dir, "nearest_in_distance")


def cast_nearest_in_distance_four_hours(spark, sf_dir):
    return _cast(spark, sf_dir, "nearest_in_distance_fourhours")


def cast_nearest_in_time_four_hours(spark, sf_dir):
    return _cast(spark, sf_dir, "nearest_in_time_fourhours")


def _cast(spark, sf_dir, method):
    c = R.chunks(S.positions(spark, sf_dir).select("line", F.col("time") + F.col("ping") * 1e-6, "lat", "lon").toDF("system", "time", "lat", "lon"), 50)
    m = c.groupBy("system", "chunk").agg(F.avg("time").alias("time"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    m = m.withColumns({k: F.bround(k, 3) for k in ("time", "lat", "lon")})
    k = F.col("c_custkey")
    casts = S.table(spark, sf_dir, "customer").select(k.alias("cast_id"), (F.lit(700_000_000.0) + k % 1500 * 140_000).alias("cast_time"), (k * 7 % 170 - 85).cast("double").alias("lat"), (k * 13 % 350 - 175).cast("double").alias("lon"))
    return R.nearest_cast(m, casts, method).select("system", "chunk", "cast_id")


CHUNKS = f"""(SELECT system, chunk, round_even(avg(time), 3) AS time, round_even(avg(lat), 3) AS lat, round_even(avg(lon), 3) AS lon FROM
  (SELECT line AS system, time, lat, lon, CAST(floor((row_number() OVER (PARTITION BY line ORDER BY time) - 1) / 50) AS BIGINT) AS chunk FROM (SELECT line, time + ping * 1e-6 AS time, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM {S.POSITIONS_SQL})) GROUP BY 1, 2)"""
CASTS = "(SELECT c_custkey AS cast_id, 700000000.0 + c_custkey % 1500 * 140000 AS cast_time, CAST(c_custkey * 7 % 170 - 85 AS DOUBLE) AS clat, CAST(c_custkey * 13 % 350 - 175 AS DOUBLE) AS clon FROM customer)"
KM = "2 * 6371.0 * asin(sqrt(pow(sin((radians(clat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin((radians(clon) - radians(lon)) / 2), 2)))"


def _cast_sql(by: str, where: str = "TRUE") -> str:
    near = f"SELECT * FROM (SELECT system, chunk, cast_id, row_number() OVER (PARTITION BY system, chunk ORDER BY {by}, cast_id) AS k FROM {CHUNKS} m, {CASTS} c WHERE {where}) WHERE k = 1"
    return f"SELECT m.system, m.chunk, x.cast_id FROM {CHUNKS} m LEFT JOIN ({near}) x ON x.system = m.system AND x.chunk = m.chunk"


def time_steps(spark, sf_dir):
    """Times since the sample before, within an hour."""
    return R.steps(S.series(spark, sf_dir), 3600.0).select("counter", F.bround("dt", 5).alias("dt"))


def sessions(spark, sf_dir):
    """Segments that a gap of six hours parts, and their sizes."""
    return R.sessions(S.series(spark, sf_dir), 21_600.0).groupBy("system", "segment").agg(F.count("*").alias("n"), F.min("time").alias("start"), F.max("time").alias("end"))


def gaps(spark, sf_dir):
    """Stretches of a day without a sample."""
    return R.gaps(S.series(spark, sf_dir), 86_400.0)


def new_gaps(spark, sf_dir):
    """Gaps of one series that another does not have."""
    s = S.series(spark, sf_dir)
    return R.new_gaps(s.where("counter % 3 > 0"), s.where("counter % 3 = 0"), 172_800.0).select("system", "start", "end")


def counter_resets(spark, sf_dir):
    """Counters of 64 that start again, made to rise."""
    return R.unreset(S.series(spark, sf_dir).select("system", "time", (F.col("counter") % 64).alias("counter"), F.col("counter").alias("id")), size=64).select("id", "counter")


def filled(spark, sf_dir):
    """Missing values from the sample before, or the first after."""
    s = S.series(spark, sf_dir).withColumn("value", F.when(F.col("mode").isin("click", "view"), F.col("value")).otherwise(0.0))
    return R.fill(s, "value").select("counter", "value")


def unwrapped(spark, sf_dir):
    """Headings without jumps."""
    s = S.series(spark, sf_dir).withColumn("value", F.bround(F.pmod(F.col("value") * 7, F.lit(360.0)), 2))
    return R.unwrap(s, "value").select("counter", F.bround("unwrapped", 2).alias("unwrapped"))


def chunked(spark, sf_dir):
    """Chunks of 50 consecutive samples within a mode."""
    return R.chunks(S.series(spark, sf_dir), 50, version="mode").groupBy("system", "mode", "chunk").agg(F.count("*").alias("n"), F.min("time").alias("start"))


def first_per_time(spark, sf_dir):
    """One sample an hour: the first by number."""
    s = S.series(spark, sf_dir).withColumn("hour", F.floor(F.col("time") / 3600))
    return R.first_of_equal(s, ["system", "hour"], ["counter"]).select("system", "hour", "counter", "value")


def nudged(spark, sf_dir):
    """Equal times moved on by a microsecond each."""
    s = S.series(spark, sf_dir).withColumn("time", F.floor(F.col("time") / 86_400).cast("double"))
    return R.nudge(s).select("counter", F.bround("time", 6).alias("time"))


def every_seventh(spark, sf_dir):
    return R.every_nth(S.series(spark, sf_dir), 7).select("counter", "value")


def rates(spark, sf_dir):
    """Change a second to the next sample."""
    return R.rate(S.series(spark, sf_dir), "value").select("counter", F.bround("rate", 9).alias("rate"))


def high_passed(spark, sf_dir):
    """A high-pass filter of 31 coefficients over each series."""
    return R.filtered(S.series(spark, sf_dir), "value", R.high_pass(20.0, 1.0, 31)).select("counter", F.bround("filtered", 6).alias("filtered"))


def smoothed(spark, sf_dir):
    """A centred Hamming window of nine samples."""
    return R.smooth(S.series(spark, sf_dir), "value", 9, "hamming").select("counter", F.bround("smooth", 6).alias("smooth"))


def regressions(spark, sf_dir):
    """Slope, intercept and spread of value over time of every system."""
    s = S.series(spark, sf_dir).withColumn("t", (F.col("time") - 1.704e9) / 86_400)
    r = R.regression(s, "t", "value", ["system"])
    return r.select("system", "n", *[F.bround(c, 6).alias(c) for c in ("slope", "intercept", "std_error", "percent_deviation")])


def swath_periods(spark, sf_dir):
    """Ping periods, averaged over two where the first ones alternate."""
    x = R.dual_swath(R.steps(S.series(spark, sf_dir), 1e9))
    return x.select("counter", F.bround("period", 5).alias("period"))


def periods(spark, sf_dir):
    """Period of each series by autocorrelation."""
    return R.period(S.series(spark, sf_dir), "value")


W = "OVER (PARTITION BY system ORDER BY time)"
QUERIES = {
    f.__name__: f
    for f in (
        asof_join, asof_within, nearest_join, nearest_within, interpolated_join, interpolated_heading, beam_interpolation, parameter_versions, lines_of_times, cast_nearest_in_time, cast_nearest_in_distance,
        cast_nearest_in_distance_four_hours, cast_nearest_in_time_four_hours, time_steps, sessions, gaps, new_gaps, counter_resets, filled, unwrapped, chunked, first_per_time, nudged, every_seventh, rates, high_passed, smoothed, regressions, swath_periods, periods,
    )
}
_TAPS = R.high_pass(20.0, 1.0, 31)
_HAMMING = R.WINDOWS["hamming"](9)
ORACLES = {
    "asof_join": f"SELECT counter, bv AS value_asof FROM {BOTH}",
    "asof_within": f"SELECT counter, CASE WHEN time - bt <= 21600 THEN bv END AS value_asof FROM {BOTH}",
    "nearest_join": f"SELECT counter, CASE WHEN nt IS NULL OR time - bt <= nt - time THEN bv ELSE av END AS value_near FROM {BOTH}",
    "nearest_within": f"SELECT counter, CASE WHEN nt IS NULL OR time - bt <= nt - time THEN CASE WHEN time - bt <= 7200 THEN bv END WHEN nt - time <= 7200 THEN av END AS value_near FROM {BOTH}",
    "interpolated_join": f"SELECT counter, round_even({LERP}, 6) AS value_at FROM {ENDS}",
    "interpolated_heading": f"""SELECT counter, round_even(CASE WHEN y < 0 THEN y + 360 ELSE y END, 5) AS value_at FROM (SELECT counter, (CASE WHEN q IS NULL OR q = p THEN a ELSE a + ((((b - a + 180) % 360) + 360) % 360 - 180) * ((time - p) / (q - p)) END) % 360 AS y
        FROM (SELECT counter, time, CASE WHEN early THEN lt[1] WHEN late THEN ht[2] ELSE coalesce(bt, nt) END AS p, CASE WHEN early THEN lt[2] WHEN late THEN ht[1] ELSE coalesce(nt, bt) END AS q,
              (CASE WHEN early THEN lv[1] WHEN late THEN hv[2] ELSE coalesce(bv, av) END * 7) % 360 AS a, (CASE WHEN early THEN lv[2] WHEN late THEN hv[1] ELSE coalesce(av, bv) END * 7) % 360 AS b
              FROM (SELECT *, bt IS NULL AND lt[2] IS NOT NULL AS early, nt IS NULL AND ht[2] IS NOT NULL AS late FROM {ENDS})))""",
    "beam_interpolation": f"SELECT counter, CAST(beam AS INTEGER) AS beam, round_even({LERP}, 6) AS value_at FROM {ENDS.replace(L, f'(SELECT system, time + beam * 1800.0 AS time, counter, beam FROM {L}, range(4) t(beam))')}",
    "parameter_versions": f"""SELECT counter, CASE WHEN until IS NULL OR time <= until THEN version END AS version FROM {L} l ASOF LEFT JOIN
        (SELECT system, CASE WHEN row_number() {W} = 1 THEN time - 3 ELSE time END AS since, lead(time) {W} - 0.001 AS until, counter AS version FROM {E} WHERE mode = 'purchase') v ON l.system = v.system AND l.time >= v.since""",
    "lines_of_times": f"""SELECT counter, CASE WHEN b.line IS NULL THEN a.line WHEN l.time <= b.until OR l.time > m.until THEN b.line END AS line FROM {E} l
        ASOF LEFT JOIN (SELECT system, line, start_time - 1 AS since, end_time + 1 AS until FROM {S.LINES_SQL}) b ON l.system = b.system AND l.time >= b.since
        ASOF LEFT JOIN (SELECT system, line, start_time - 1 AS since FROM {S.LINES_SQL}) a ON l.system = a.system AND l.time <= a.since
        JOIN (SELECT system, max(end_time) AS until FROM {S.LINES_SQL} GROUP BY 1) m ON m.system = l.system""",
    "cast_nearest_in_time": _cast_sql("abs(time - cast_time)"),
    "cast_nearest_in_distance": _cast_sql(KM),
    "cast_nearest_in_distance_four_hours": _cast_sql(KM, "abs(time - cast_time) <= 14400"),
    "cast_nearest_in_time_four_hours": _cast_sql("abs(time - cast_time)", "abs(time - cast_time) <= 14400"),
    "time_steps": f"SELECT counter, round_even(dt, 5) AS dt FROM (SELECT counter, time - lag(time) {W} AS dt FROM {E}) WHERE dt > 0 AND dt < 3600",
    "sessions": f"SELECT system, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(time) AS start, max(time) AS \"end\" FROM (SELECT system, time, sum(CASE WHEN g > 21600 THEN 1 ELSE 0 END) {W} AS segment FROM (SELECT system, time, time - lag(time) {W} AS g FROM {E})) GROUP BY 1, 2",
    "gaps": f"SELECT * FROM (SELECT system, lag(time) {W} AS start, time AS \"end\" FROM {E}) WHERE \"end\" - start > 86400",
    "new_gaps": f"""WITH n AS (SELECT system, time FROM {E} WHERE counter % 3 = 0), o AS (SELECT system, time FROM {E} WHERE counter % 3 > 0),
        e AS (SELECT o.system, min(o.time) AS a, max(o.time) AS b FROM o GROUP BY 1), f AS (SELECT system, min(time) AS p, max(time) AS q FROM n GROUP BY 1),
        g AS (SELECT system, s, t FROM (SELECT system, lag(time) {W} AS s, time AS t FROM n) WHERE t - s > 172800
              UNION ALL SELECT system, a, p FROM e JOIN f USING (system) WHERE p - a > 172800 UNION ALL SELECT system, q, b FROM e JOIN f USING (system) WHERE b - q > 172800),
        h AS (SELECT system, s, t FROM (SELECT system, lag(time) {W} AS s, time AS t FROM o) WHERE t - s > 172800),
        c AS (SELECT system, s AS x FROM g UNION SELECT system, t FROM g UNION SELECT system, s FROM h UNION SELECT system, t FROM h),
        i AS (SELECT system, x, lead(x) OVER (PARTITION BY system ORDER BY x) AS y FROM c)
        SELECT system, x AS start, y AS "end" FROM i WHERE EXISTS (SELECT 1 FROM g WHERE g.system = i.system AND g.s <= i.x AND g.t >= i.y) AND NOT EXISTS (SELECT 1 FROM h WHERE h.system = i.system AND h.s <= i.x AND h.t >= i.y)""",
    "counter_resets": f"SELECT counter AS id, CAST(c + 64 * sum(f) {W} AS BIGINT) AS counter FROM (SELECT system, time, counter, counter % 64 AS c, CASE WHEN counter % 64 < lag(counter % 64) {W} THEN 1 ELSE 0 END AS f FROM {E})",
    "filled": f"SELECT counter, coalesce(last_value(v IGNORE NULLS) {W}, first_value(v IGNORE NULLS) OVER (PARTITION BY system ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM (SELECT system, time, counter, CASE WHEN mode IN ('click', 'view') AND value <> 0 THEN value END AS v FROM {E})",
    "unwrapped": f"""SELECT counter, round_even(h + sum(CASE WHEN d IS NULL OR abs(d) < 180 THEN 0 WHEN s = -180 AND d > 0 THEN 180 - d ELSE s - d END) {W}, 2) AS unwrapped FROM
        (SELECT *, ((d + 180) % 360 + 360) % 360 - 180 AS s FROM (SELECT *, h - lag(h) {W} AS d FROM (SELECT system, time, counter, round_even((value * 7) % 360, 2) AS h FROM {E})))""",
    "chunked": f"SELECT system, mode, chunk, count(*) AS n, min(time) AS start FROM (SELECT system, mode, time, CAST(floor((row_number() OVER (PARTITION BY system, mode ORDER BY time) - 1) / 50) AS BIGINT) AS chunk FROM {E}) GROUP BY 1, 2, 3",
    "first_per_time": f"SELECT system, CAST(floor(time / 3600) AS BIGINT) AS hour, min(counter) AS counter, min_by(value, counter) AS value FROM {E} GROUP BY 1, 2",
    "nudged": f"SELECT counter, round_even(t + 1e-6 * (row_number() OVER (PARTITION BY system, t ORDER BY counter) - 1), 6) AS time FROM (SELECT system, counter, floor(time / 86400) AS t FROM {E})",
    "every_seventh": f"SELECT counter, value FROM (SELECT counter, value, row_number() {W} AS k FROM {E}) WHERE (k - 1) % 7 = 0",
    "rates": f"SELECT counter, round_even((lead(value) {W} - value) / (lead(time) {W} - time), 9) AS rate FROM {E}",
    "high_passed": f"SELECT counter, round_even({' + '.join(f'coalesce(lag(value, {k}) {W}, 0) * ({c!r})' for k, c in enumerate(_TAPS))}, 6) AS filtered FROM {E}",
    "smoothed": f"""WITH n AS (SELECT system, counter, value, row_number() {W} - 1 AS k, count(*) OVER (PARTITION BY system) AS n FROM {E}),
        x AS (SELECT system, counter, value, k, n, true AS own FROM n UNION ALL SELECT system, counter, value, -k, n, false FROM n WHERE k BETWEEN 1 AND 5 UNION ALL SELECT system, counter, value, 2 * (n - 1) - k, n, false FROM n WHERE k < n - 1 AND k >= n - 4)
        SELECT counter, round_even(CASE WHEN n >= 9 THEN s END, 6) AS smooth FROM (SELECT *, {' + '.join(f'coalesce(lag(value, {5 - i}) OVER (PARTITION BY system ORDER BY k), 0) * {c / sum(_HAMMING)!r}' for i, c in enumerate(_HAMMING))} AS s FROM x) WHERE own""",
    "swath_periods": f"""WITH d AS (SELECT system, time, counter, time - lag(time) {W} AS dt FROM {E}), x AS (SELECT *, row_number() {W} - 1 AS k, lead(dt) {W} AS nx FROM d WHERE dt > 0 AND dt < 1e9),
        a AS (SELECT system, max(dt) FILTER (WHERE k = 1) AS d0, max(dt) FILTER (WHERE k = 2) AS d1, max(dt) FILTER (WHERE k = 3) AS d2, max(dt) FILTER (WHERE k = 4) AS d3 FROM x GROUP BY 1)
        SELECT counter, round_even(CASE WHEN coalesce((d0 > d1 AND d2 > d1 AND d2 > d3) OR (d0 < d1 AND d2 < d1 AND d2 < d3), false) AND nx IS NOT NULL THEN (dt + nx) / 2 ELSE dt END, 5) AS period FROM x JOIN a USING (system)""",
    "regressions": f"""SELECT system, n, round_even(b, 6) AS slope, round_even(a, 6) AS intercept, round_even(e, 6) AS std_error, round_even(abs(e / m) * 100, 6) AS percent_deviation FROM
        (SELECT system, count(*) AS n, regr_slope(value, t) AS b, regr_intercept(value, t) AS a, avg(value) AS m, sqrt(greatest(regr_syy(value, t) - pow(regr_sxy(value, t), 2) / regr_sxx(value, t), 0) / (count(*) - 1)) AS e FROM (SELECT system, value, (time - 1.704e9) / 86400 AS t FROM {E}) GROUP BY 1)""",
}


def motion_tests(spark, sf_dir):
    """Regressions of several pairs of series in one pass."""
    from ..operators import diagnostics

    n = lambda k: (F.col("counter") % k).cast("double")
    s = R.rate(S.series(spark, sf_dir), "value").select(F.col("value").alias("roll"), F.col("rate").alias("roll_rate"), *[n(k).alias(c) for c, k in MOTION.items()])
    return diagnostics.wobble_table(s).select("test", *[F.bround(c, 6).alias(c) for c in ("slope", "intercept", "r2")], "n")


#: Stand-in columns: the counter's rest by a number each.
MOTION = {"pitch": 13, "heave": 7, "hp_slope": 97, "hp_inner": 89, "hp_mean_depth": 83, "hp_port": 79, "hp_starboard": 73}
QUERIES["motion_tests"] = motion_tests
_R = f"(SELECT value AS roll, (lead(value) {W} - value) / (lead(time) {W} - time) AS roll_rate, {', '.join(f'CAST(counter % {k} AS DOUBLE) AS {c}' for c, k in MOTION.items())} FROM {E})"
ORACLES["motion_tests"] = " UNION ALL ".join(f"SELECT '{n}' AS test, round_even(regr_slope({y}, {x}), 6) AS slope, round_even(regr_intercept({y}, {x}), 6) AS intercept, round_even(regr_r2({y}, {x}), 6) AS r2, CAST(regr_count({y}, {x}) AS BIGINT) AS n FROM {_R}" for n, (x, y) in WOBBLE_TESTS.items())
