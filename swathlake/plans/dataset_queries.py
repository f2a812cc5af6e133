"""Queries on datasets of a project, their lines, status and files, on stand-in tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times as T
from ..operators import datasets as D
from ..operators import grid, kernels
from ..operators import series as R
from . import control
from . import stand_ins as S
from .series_queries import ENDS, LERP

E, W = S.SERIES_SQL, "OVER (PARTITION BY system ORDER BY time)"
#: Soundings with a line (a mode), a serial number (of three), a status and a file.
PINGS = f"(SELECT system, time, counter, value, mode AS line, counter % 3 AS serial, CAST(counter % 6 AS INTEGER) AS processing_status, counter % 5 AS file FROM {E})"


def _pings(spark, sf_dir):
    s = S.series(spark, sf_dir)
    c = F.col("counter")
    return s.select("system", "time", "counter", "value", F.col("mode").alias("line"), (c % 3).alias("serial"), (c % 6).cast("int").alias("processing_status"), (c % 5).alias("file"))


def line_navigation(spark, sf_dir):
    """Samples with the line that began last and holds them."""
    p, lines = S.series(spark, sf_dir).select("system", "time", "counter"), S.lines(spark, sf_dir)
    return D.line_navigation(p, lines).select("counter", "line")


def line_processed(spark, sf_dir):
    return D.line_processed(_pings(spark, sf_dir), S.lines(spark, sf_dir))


def next_unprocessed(spark, sf_dir):
    lines = S.lines(spark, sf_dir)
    return D.next_unprocessed(lines, D.line_processed(_pings(spark, sf_dir), lines))


def line_owners(spark, sf_dir):
    lines = S.lines(spark, sf_dir)
    return D.owners(lines, lines.where("line in ('view', 'error')"))


def selected_spans(spark, sf_dir):
    return D.selected_spans(_pings(spark, sf_dir))


def time_bounds(spark, sf_dir):
    """Time bounds of each dataset, as text."""
    b = D.bounds(S.series(spark, sf_dir))
    return b.select("system", "n", D.time_text(F.col("first")).alias("first"), D.time_text(F.col("last")).alias("last"))


def navigation_extents(spark, sf_dir):
    return D.extents(S.positions(spark, sf_dir), "line")


def overlapping_datasets(spark, sf_dir):
    return D.overlapping(D.extents(S.positions(spark, sf_dir).withColumn("line", F.col("ping") % 400), "line"), 60.0, 90.0, 150.0, 180.0).select("line")


def least_status(spark, sf_dir):
    return D.least_status(_pings(spark, sf_dir).where("line <> 'click'"))


def last_operation(spark, sf_dir):
    return D.last_operation(S.series(spark, sf_dir).select("system", F.col("mode").alias("operation"), F.col("time").alias("at")))


def most_common_crs(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 20 + 32600).alias("epsg"))
    return D.most_common(c, "epsg")


def settings_agree(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 20 + 32600).alias("epsg"), F.lit("waterline").alias("reference"))
    return D.agree(c, "epsg", "reference")


def heads(spark, sf_dir):
    return D.heads(_pings(spark, sf_dir))


def parameters_in_force(spark, sf_dir):
    """The waterline and heave uncertainty in force at each version's time."""
    from .control_queries import _params

    p = _params(spark, sf_dir)
    return D.in_force(p, p.select("system", "ts").distinct(), ["waterline", "heave_error"])


def sector_offsets(spark, sf_dir):
    """Depths moved by the additional lever arm of a beam's sector."""
    o = S.table(spark, sf_dir, "nation").where("n_regionkey < 3").select((F.col("n_nationkey") + 1).alias("sector"), *[(F.col("n_nationkey") * a / 10.0).alias(c) for c, a in (("x", 1), ("y", 2), ("z", 3))])
    s = S.soundings(spark, sf_dir).withColumn("sector", F.col("frequency") % 26)
    return D.with_offsets(s, o).select("ping", "beam", "frequency", F.bround(F.col("z") + F.col("offset_z"), 6).alias("z"))


def rounded_groups(spark, sf_dir):
    s = S.soundings(spark, sf_dir).select((F.col("frequency") * 977 + 12_345).alias("frequency"))
    return D.rounded_frequency(s)


def converted_blocks(spark, sf_dir):
    """Records by head, once a time, the later file's."""
    p = _pings(spark, sf_dir).select("system", F.floor(F.col("time") / 600).cast("double").alias("time"), "serial", "file", "counter", "value")
    return D.blocks(p).select("dataset", "time", "file", "counter", "value")


def byte_ranges(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_orderkey") * 123_457).alias("length"))
    return D.byte_ranges(o)


def nearest_settings(spark, sf_dir):
    s = S.series(spark, sf_dir)
    return D.nearest_settings(s.where("mode = 'click'").select("system", "time", "counter"), s.where("mode = 'purchase'").select("system", "time", "value"), ["value"]).select("counter", "value")


def _files(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("name"), F.lit("em2040").alias("model"), (F.col("o_custkey") % 50).alias("serial"), (F.col("o_orderkey") % 2).alias("serial2"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("start"), F.floor("o_totalprice").alias("size"))


_FILES = "(SELECT o_orderkey AS name, o_custkey % 50 AS serial, o_orderkey % 2 AS serial2, CAST(o_orderdate AS TIMESTAMP) AS day, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders)"


def grouped_files(spark, sf_dir):
    """Files with the dataset of both their serial numbers and day of the year, known for some serial numbers."""
    f = _files(spark, sf_dir)
    known = f.where("serial < 20").select(F.concat(F.lit("known_"), F.col("name").cast("string")).alias("name"), "serial", "serial2", "start")
    return D.grouped_files(f, known).select("name", "dataset", "new")


def new_files(spark, sf_dir):
    f = _files(spark, sf_dir)
    return D.new_files(f, f.where("serial between 10 and 39")).select("name", "size")


def _casts(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select((k % 30).alias("dataset"), (k % 7).alias("day"), (k % 41).alias("digest"), k.alias("cast"))


_CASTS = "(SELECT c_custkey % 30 AS dataset, c_custkey % 7 AS day, c_custkey % 41 AS digest, c_custkey AS cast FROM customer)"


def casts_to_import(spark, sf_dir):
    c = _casts(spark, sf_dir)
    return D.casts_to_import(c.select("digest", "cast"), c.where("day < 3").select("dataset", "digest"), c.select("dataset"))


def imported_casts(spark, sf_dir):
    """Casts after an import: identical ones replace the older."""
    c = _casts(spark, sf_dir)
    return D.imported_casts(c.where("day < 4"), c.where("day >= 3"), c)[0]


def traced_again(spark, sf_dir):
    """Traced datasets that use a cast that came in."""
    c = _casts(spark, sf_dir)
    return D.imported_casts(c.where("day < 4"), c.where("day >= 3"), c.where("digest < 9"), c.select("dataset", (F.col("dataset") % 6).alias("status")))[1]


def removed_casts(spark, sf_dir):
    """Statuses of datasets after some casts, in use or not, were removed."""
    c = _casts(spark, sf_dir)
    d = c.select("dataset", (F.col("dataset") % 6).cast("int").alias("status")).distinct()
    return D.without_cast(c, c.where("day = 2 and dataset % 4 = 1"), c.where("digest < 9"), d)[1]


NAV_GAP = 43_200.0


def imported_navigation(spark, sf_dir):
    """A solution at the raw times, null in gaps of more than half a day that are its own."""
    s = S.series(spark, sf_dir)
    x = D.imported_navigation(s.where("mode = 'click'").select("system", "time", "counter"), s.where("mode in ('view', 'error')").select("system", "time", "value"), ["value"], NAV_GAP)
    return x.select("counter", F.bround("post_value", 6).alias("post_value"))


def overwritten_navigation(spark, sf_dir):
    """Raw values with the solution's in their place wherever it has some."""
    s = S.series(spark, sf_dir)
    x = D.overwritten_navigation(s.where("mode = 'click'").select("system", "time", "counter", "value"), s.where("mode in ('view', 'error')").select("system", "time", "value"), ["value"], NAV_GAP)
    return x.select("counter", F.bround("value", 6).alias("value"))


def without_navigation(spark, sf_dir):
    return D.without_navigation(_pings(spark, sf_dir).withColumn("post_lat", F.lit(1.0))).groupBy("processing_status").agg(F.count("*").alias("n"))


def stages_to_run(spark, sf_dir):
    """The first stage that each dataset must run again."""
    c = S.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    flags = {n: k % p == 0 for n, p in (("crs", 5), ("datum", 7), ("reference", 11), ("offsets", 13), ("angles", 17), ("waterline", 19), ("tpu", 3))}
    return control.stages_to_run(c.select(k.alias("dataset"), (k % 6).alias("status"), *[v.alias(n) for n, v in flags.items()])).select("dataset", "first", "stages")


def year_day_times(spark, sf_dir):
    """Differences and sums of years, days and seconds, months and days, and durations as text."""
    o = S.table(spark, sf_dir, "orders")
    y, d, s = F.year("o_orderdate"), F.dayofyear("o_orderdate"), F.col("o_custkey") * 7.0
    plus = T.year_day_plus(y, d, s, F.col("o_orderkey") * 11.0)
    month = T.month_and_day(y, d)
    return o.select(
        F.col("o_orderkey").alias("id"), month["month"].alias("month"), month["day"].alias("day"), T.day_of_year(y, F.month("o_orderdate"), F.dayofmonth("o_orderdate")).alias("year_day"),
        T.year_day_difference(y, d, s, F.lit(1994), F.lit(200), F.lit(5.0)).alias("difference"), plus["year"].alias("plus_year"), plus["day"].alias("plus_day"), plus["seconds"].alias("plus_seconds"), T.elapsed_text(s).alias("elapsed"),
    )


def since_1980(spark, sf_dir):
    """Seconds since 1980 and back."""
    s = S.series(spark, sf_dir).select("counter", T.to_1980(F.floor(F.col("time") / 2)).alias("t"))
    return s.select("counter", "t", T.from_1980(F.col("t")).alias("utc"))


def full_surface(spark, sf_dir):
    """All layers: density, mean, median and variance of depth, mean uncertainties."""
    g = grid.full_surface(S.soundings(spark, sf_dir), 4096.0)
    return g.select("cell_x", "cell_y", "density", *[F.bround(c, 6).alias(c) for c in ("depth", "median", "variance", "vertical_uncertainty", "horizontal_uncertainty")])


def values_at(spark, sf_dir):
    """Each sounding's difference to the surface."""
    s = S.soundings(spark, sf_dir)
    x = grid.values_at(s, grid.surface(s.where("beam < 3"), 2048.0), 2048.0)
    return x.select("ping", "beam", "frequency", F.bround(F.col("z") - F.col("depth"), 6).alias("off"))


def removed_line(spark, sf_dir):
    """Points of a surface after one line of a container is taken out."""
    s = S.soundings(spark, sf_dir).select(F.concat(F.lit("c"), (F.col("ping") % 30).cast("string")).alias("container"), (F.col("beam") % 4).cast("string").alias("line"))
    return grid.remove_points(s, ["c2"], "3").groupBy("container", "line").agg(F.count("*").alias("n"))


def second_head(spark, sf_dir):
    """Heave at the second head and altitude at the transmitter."""
    s = S.series(spark, sf_dir).select("counter", (F.col("counter") % 21 - 10.0).alias("roll"), (F.col("counter") % 11 - 5.0).alias("pitch"), (F.col("counter") % 360 * 1.0).alias("heading"), (F.col("value") / 10).alias("heave"), F.col("value").alias("altitude"))
    x = kernels.altitude_at_transmitter(kernels.induced_heave(s, (1.0, -2.0, 0.5), (0.5, 3.0, 1.0)), (0.3, 0.7, 2.0))
    return x.select("counter", F.bround("heave", 6).alias("heave"), F.bround("altitude", 6).alias("altitude"))


def reset_heads(spark, sf_dir):
    """Counters of two heads made to rise together: falls within a day of each other are one reset."""
    s = S.series(spark, sf_dir).select("system", "time", (F.col("counter") % 64).alias("counter"), F.col("counter").alias("id"), (F.col("counter") % 2).alias("head"))
    return R.unreset(s, size=64, head="head", near=86_400.0).select("id", "counter")


def zero_centred(spark, sf_dir):
    return R.zero_centred(S.series(spark, sf_dir), "value").select("counter", F.bround("value", 6).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        line_navigation, line_processed, next_unprocessed, line_owners, selected_spans, time_bounds, navigation_extents, overlapping_datasets, least_status, last_operation, most_common_crs, settings_agree, heads, parameters_in_force,
        sector_offsets, rounded_groups, converted_blocks, byte_ranges, nearest_settings, grouped_files, new_files, casts_to_import, imported_casts, traced_again, removed_casts, imported_navigation, overwritten_navigation, without_navigation, stages_to_run, year_day_times,
        since_1980, full_surface, values_at, removed_line, second_head, reset_heads, zero_centred,
    )
}
L = S.LINES_SQL
_PROCESSED = f"""(WITH p AS (SELECT system, time, min(processing_status) AS least FROM {PINGS} GROUP BY 1, 2), m AS (SELECT system, line, (start_time + end_time) / 2 AS time FROM {L}),
    x AS (SELECT m.system, m.line, m.time, b.time AS bt, b.least AS bl, a.time AS nt, a.least AS al FROM m ASOF LEFT JOIN p b ON m.system = b.system AND m.time >= b.time ASOF LEFT JOIN p a ON m.system = a.system AND m.time <= a.time)
    SELECT system, line, coalesce(CASE WHEN nt IS NULL OR time - bt <= nt - time THEN bl ELSE al END >= 5, false) AS processed FROM x)"""
_STATUS = "['converted', 'orientation', 'beamvector', 'soundvelocity', 'georeference', 'tpu']"
_P = "(SELECT s_nationkey AS system, CAST(s_suppkey % 5 * 100 AS DOUBLE) AS ts, ['tx_x', 'tx_r', 'waterline', 'latency', 'heave_error', 'rx_p', 'tx_y_1'][s_suppkey % 7 + 1] AS param, max(floor(s_acctbal / 1000)) AS value FROM supplier GROUP BY 1, 2, 3)"
_LEAPS = "[" + ", ".join(f"TIMESTAMP '{d}'" for d in T.LEAP_DAYS) + "]"
_POS = S.POSITIONS_SQL


def _turned_sql(lever) -> str:
    x, y, z = lever
    return f"((-sin(p)) * ({x!r}) + cos(p) * sin(r) * ({y!r}) + cos(p) * cos(r) * ({z!r}) - ({z!r}))"


ORACLES = {
    "line_navigation": f"SELECT counter, b.line FROM {E} l ASOF JOIN {L} b ON l.system = b.system AND l.time >= b.start_time WHERE l.time <= b.end_time",
    "line_processed": f"SELECT * FROM {_PROCESSED}",
    "next_unprocessed": f"SELECT system, line FROM (SELECT l.system, l.line, row_number() OVER (PARTITION BY l.system ORDER BY start_time, l.line) AS k FROM {L} l JOIN {_PROCESSED} p ON p.system = l.system AND p.line = l.line WHERE NOT processed) WHERE k = 1",
    "line_owners": f"SELECT DISTINCT line, system FROM {L} WHERE line IN ('view', 'error')",
    "selected_spans": f"SELECT line, system, min(time) AS start, max(time) AS \"end\" FROM {PINGS} GROUP BY 1, 2",
    "time_bounds": f"SELECT system, count(*) AS n, strftime(make_timestamp(CAST(floor(min(time)) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS first, strftime(make_timestamp(CAST(floor(max(time)) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS last FROM {E} GROUP BY 1",
    "navigation_extents": f"SELECT line, CAST(min(lat) AS DOUBLE) AS min_lat, CAST(max(lat) AS DOUBLE) AS max_lat, CAST(min(lon) AS DOUBLE) AS min_lon, CAST(max(lon) AS DOUBLE) AS max_lon FROM {_POS} GROUP BY 1",
    "overlapping_datasets": f"SELECT ping % 400 AS line FROM {_POS} GROUP BY 1 HAVING min(lat) <= 90 AND max(lat) >= 60 AND min(lon) <= 180 AND max(lon) >= 150",
    "least_status": f"SELECT system, min(processing_status) AS status, {_STATUS}[min(processing_status) + 1] AS label FROM {PINGS} WHERE line <> 'click' GROUP BY 1",
    "last_operation": f"SELECT system, operation, \"at\" FROM (SELECT system, mode AS operation, time AS \"at\", row_number() OVER (PARTITION BY system ORDER BY time DESC, mode DESC) AS k FROM {E}) WHERE k = 1",
    "most_common_crs": "SELECT c_custkey % 20 + 32600 AS epsg, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "settings_agree": "SELECT count(DISTINCT c_custkey % 20) = 1 AS one_epsg, count(*) > 0 AS one_reference FROM customer",
    "heads": f"SELECT system, count(DISTINCT serial) AS heads, count(DISTINCT serial) > 1 AS dual FROM {PINGS} GROUP BY 1",
    "parameters_in_force": f"""SELECT t.system, t.ts, w.value AS waterline, h.value AS heave_error FROM (SELECT DISTINCT system, ts FROM {_P}) t ASOF LEFT JOIN (SELECT * FROM {_P} WHERE param = 'waterline') w ON w.system = t.system AND t.ts >= w.ts
        ASOF LEFT JOIN (SELECT * FROM {_P} WHERE param = 'heave_error') h ON h.system = t.system AND t.ts >= h.ts""",
    "sector_offsets": "SELECT l_orderkey AS ping, l_linenumber AS beam, l_suppkey AS frequency, round_even(l_quantity + coalesce(n_nationkey * 3 / 10.0, 0), 6) AS z FROM lineitem LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey + 1 = l_suppkey % 26",
    "rounded_groups": """SELECT frequency, CAST(round_even(frequency / size, 0) * size AS BIGINT) AS rounded, n FROM (SELECT frequency, n, CASE WHEN max(frequency) OVER () >= 1e5 THEN 1e5 WHEN max(frequency) OVER () >= 1e4 THEN 1e4 ELSE 1e3 END AS size
        FROM (SELECT l_suppkey * 977 + 12345 AS frequency, count(*) AS n FROM lineitem GROUP BY 1))""",
    "converted_blocks": f"""SELECT dataset, time, file, counter, value FROM (SELECT *, row_number() OVER (PARTITION BY dataset, time ORDER BY file DESC, counter DESC) AS k FROM
        (SELECT system || '_' || serial AS dataset, CAST(floor(time / 600) AS DOUBLE) AS time, file, counter, value FROM {PINGS})) WHERE k = 1""",
    "byte_ranges": """SELECT path, k * size AS start, least(size, length - k * size) AS length FROM (SELECT path, length, n, CAST(ceil(length / n) AS BIGINT) AS size FROM (SELECT o_orderkey AS path, o_orderkey * 123457 AS length,
        greatest(1, least(20, CAST(floor(o_orderkey * 123457 / 40000000) AS BIGINT))) AS n FROM orders)), range(20) t(k) WHERE k < n""",
    "nearest_settings": f"""SELECT l.counter, CASE WHEN a.time IS NULL OR l.time - b.time <= a.time - l.time THEN b.value ELSE a.value END AS value FROM (SELECT * FROM {E} WHERE mode = 'click') l
        ASOF LEFT JOIN (SELECT * FROM {E} WHERE mode = 'purchase') b ON l.system = b.system AND l.time >= b.time ASOF LEFT JOIN (SELECT * FROM {E} WHERE mode = 'purchase') a ON l.system = a.system AND l.time <= a.time""",
    "grouped_files": f"""SELECT f.name, coalesce(k.known, 'em2040_' || f.serial || '_' || strftime(f.day, '%m_%d_%Y')) AS dataset, k.known IS NULL AS new FROM {_FILES} f
        LEFT JOIN (SELECT serial, serial2, dayofyear(day) AS day, min('known_' || name) AS known FROM {_FILES} WHERE serial < 20 GROUP BY 1, 2, 3) k ON k.serial = f.serial AND k.serial2 = f.serial2 AND k.day = dayofyear(f.day)""",
    "new_files": f"SELECT name, size FROM {_FILES} WHERE (name, size) NOT IN (SELECT (name, size) FROM {_FILES} WHERE serial BETWEEN 10 AND 39)",
    "casts_to_import": f"SELECT DISTINCT d.dataset, c.cast FROM {_CASTS} c, (SELECT DISTINCT dataset FROM {_CASTS}) d WHERE NOT EXISTS (SELECT 1 FROM {_CASTS} h WHERE h.day < 3 AND h.dataset = d.dataset AND h.digest = c.digest)",
    "imported_casts": f"SELECT dataset, digest, \"cast\" FROM (SELECT *, row_number() OVER (PARTITION BY dataset, digest ORDER BY age DESC, \"cast\" DESC) AS k FROM (SELECT *, 0 AS age FROM {_CASTS} WHERE day < 4 UNION ALL SELECT *, 1 FROM {_CASTS} WHERE day >= 3)) WHERE k = 1",
    "traced_again": f"SELECT DISTINCT n.dataset, 2 AS status FROM {_CASTS} n WHERE n.day >= 4 AND n.digest < 9 AND n.dataset % 6 >= 3",
    "removed_casts": f"SELECT dataset, CAST(CASE WHEN EXISTS (SELECT 1 FROM {_CASTS} c WHERE c.dataset = d.dataset AND c.day = 2 AND c.dataset % 4 = 1 AND c.digest < 9) THEN least(dataset % 6, 2) ELSE dataset % 6 END AS INTEGER) AS status FROM (SELECT DISTINCT dataset FROM {_CASTS}) d",
    "imported_navigation": f"""WITH n AS (SELECT system, time FROM {E} WHERE mode IN ('view', 'error')), o AS (SELECT system, time FROM {E} WHERE mode = 'click'), e AS (SELECT system, min(time) AS a, max(time) AS b FROM o GROUP BY 1), f AS (SELECT system, min(time) AS p, max(time) AS q FROM n GROUP BY 1),
        g AS (SELECT system, s, t FROM (SELECT system, lag(time) OVER (PARTITION BY system ORDER BY time) AS s, time AS t FROM n) WHERE t - s > {NAV_GAP} UNION ALL SELECT system, a, p FROM e JOIN f USING (system) WHERE p - a > {NAV_GAP} UNION ALL SELECT system, q, b FROM e JOIN f USING (system) WHERE b - q > {NAV_GAP}),
        h AS (SELECT system, s, t FROM (SELECT system, lag(time) OVER (PARTITION BY system ORDER BY time) AS s, time AS t FROM o) WHERE t - s > {NAV_GAP}),
        c AS (SELECT system, s AS x FROM g UNION SELECT system, t FROM g UNION SELECT system, s FROM h UNION SELECT system, t FROM h), i AS (SELECT system, x, lead(x) OVER (PARTITION BY system ORDER BY x) AS y FROM c),
        gap AS (SELECT system, x, y FROM i WHERE EXISTS (SELECT 1 FROM g WHERE g.system = i.system AND g.s <= i.x AND g.t >= i.y) AND NOT EXISTS (SELECT 1 FROM h WHERE h.system = i.system AND h.s <= i.x AND h.t >= i.y))
        SELECT counter, round_even(CASE WHEN EXISTS (SELECT 1 FROM gap WHERE gap.system = l.system AND gap.x < l.time AND l.time < gap.y) THEN NULL WHEN time >= lt[1] - {NAV_GAP} AND time <= ht[1] + {NAV_GAP} THEN {LERP} END, 6) AS post_value FROM {ENDS} l""",
    "without_navigation": f"SELECT least(processing_status, 3) AS processing_status, count(*) AS n FROM {PINGS} GROUP BY 1",
    "stages_to_run": f"""SELECT dataset, first, array_to_string({list(control.STAGES)!r}[first + 1:], ',') AS stages FROM (SELECT c_custkey AS dataset, CASE WHEN c_custkey % 6 < 2 OR c_custkey % 17 = 0 THEN 0 WHEN c_custkey % 6 < 3 OR c_custkey % 13 = 0 OR c_custkey % 19 = 0 THEN 2
        WHEN c_custkey % 6 < 4 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN 3 WHEN c_custkey % 6 < 5 OR c_custkey % 3 = 0 THEN 4 ELSE 5 END AS first FROM customer)""",
    "year_day_times": """SELECT id, month(d) AS month, day(d) AS day, dayofyear(d) AS year_day, epoch(d) + s - epoch(DATE '1994-07-19') - 5 AS difference, year(p) AS plus_year, dayofyear(p) AS plus_day, epoch(p) - epoch(CAST(p AS DATE)) AS plus_seconds,
        format('{} hours, {} minutes, {} seconds', CAST(s AS BIGINT) // 3600, CAST(s AS BIGINT) // 60 % 60, CAST(s AS BIGINT) % 60) AS elapsed
        FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_custkey * 7.0 AS s, CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_custkey * 7.0 + o_orderkey * 11.0 AS BIGINT)) AS p FROM orders)""",
    "since_1980": f"SELECT counter, u - 315532800 + len(list_filter({_LEAPS}, lambda d: epoch(d) + 86400 <= u)) AS t, u AS utc FROM (SELECT counter, floor(time / 2) AS u FROM {E})",
    "full_surface": """SELECT CAST(floor(l_extendedprice / 4096) AS BIGINT) AS cell_x, CAST(floor(l_orderkey / 4096) AS BIGINT) AS cell_y, count(*) AS density, round_even(avg(l_quantity), 6) AS depth, round_even(median(l_quantity), 6) AS median,
        round_even(var_pop(l_quantity), 6) AS variance, round_even(avg(l_discount), 6) AS vertical_uncertainty, round_even(avg(l_tax), 6) AS horizontal_uncertainty FROM lineitem GROUP BY 1, 2""",
    "values_at": """WITH s AS (SELECT l_orderkey AS ping, l_linenumber AS beam, l_suppkey AS frequency, l_quantity AS z, floor(l_extendedprice / 2048) AS i, floor(l_orderkey / 2048) AS j FROM lineitem)
        SELECT ping, beam, frequency, round_even(z - depth, 6) AS off FROM s LEFT JOIN (SELECT i, j, avg(z) AS depth FROM s WHERE beam < 3 GROUP BY 1, 2) g ON g.i = s.i AND g.j = s.j""",
    "removed_line": "SELECT 'c' || l_orderkey % 30 AS container, CAST(l_linenumber % 4 AS VARCHAR) AS line, count(*) AS n FROM lineitem WHERE NOT (('c' || l_orderkey % 30) LIKE '%c2%' AND l_linenumber % 4 = 3) GROUP BY 1, 2",
    "second_head": f"SELECT counter, round_even(value / 10 - {_turned_sql((0.5, -5.0, -0.5))}, 6) AS heave, round_even(value + {_turned_sql((-0.3, -0.7, -2.0))}, 6) AS altitude FROM (SELECT counter, value, radians(counter % 21 - 10.0) AS r, radians(counter % 11 - 5.0) AS p FROM {E})",
    "reset_heads": f"""WITH s AS (SELECT system, time, counter AS id, counter % 64 AS c, counter % 2 AS head FROM {E}), f AS (SELECT system, head, time FROM (SELECT *, lag(c) OVER (PARTITION BY system, head ORDER BY time) AS p FROM s) WHERE c < p),
        e AS (SELECT system, head, time, sum(n) {W} AS event FROM (SELECT *, CASE WHEN time - lag(time) {W} > 86400 - 1e-9 THEN 1 ELSE 0 END AS n FROM f)),
        a AS (SELECT h.system, h.head, x.event, coalesce(o.at, x.start) AS at FROM (SELECT system, event, min(time) AS start FROM e GROUP BY 1, 2) x JOIN (SELECT DISTINCT system, head FROM s) h ON h.system = x.system
              LEFT JOIN (SELECT system, head, event, min(time) AS at FROM e GROUP BY 1, 2, 3) o ON o.system = h.system AND o.head = h.head AND o.event = x.event)
        SELECT s.id, CAST(any_value(s.c) + 64 * count(a.at) AS BIGINT) AS counter FROM s LEFT JOIN a ON a.system = s.system AND a.head = s.head AND a.at <= s.time GROUP BY s.id""",
    "zero_centred": f"SELECT counter, round_even(value - (SELECT avg(value) FROM {E}), 6) AS value FROM {E}",
}
ORACLES["overwritten_navigation"] = f"SELECT n.counter, round_even(coalesce(n.post_value, e.value), 6) AS value FROM ({ORACLES['imported_navigation']}) n JOIN {E} e ON e.counter = n.counter"
