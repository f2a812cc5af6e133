"""Queries on soundings, pings and lines: subsets, filters, aggregates, grids and acceptance tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, grid, kernels, stats, subset, upsert
from ..operators import series as R
from . import stand_ins as S
from .series_queries import BOTH

E = S.SERIES_SQL
#: lineitem as soundings.
SQL = "(SELECT l_orderkey AS ping, CAST(l_linenumber AS INTEGER) AS beam, l_quantity AS z, l_extendedprice AS x, CAST(l_orderkey AS DOUBLE) AS y, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 0 ELSE 1 END AS detectioninfo, l_discount AS tvu, l_tax AS thu, l_suppkey AS frequency FROM lineitem)"


def _swath(spark, sf_dir):
    """Soundings with one row a ping and beam: system = the ping's number in eight, beam from 0, depth the least quantity."""
    s = S.soundings(spark, sf_dir)
    return s.groupBy((F.col("ping") % 8).alias("system"), F.col("ping").cast("double").alias("time"), (F.col("beam") - 1).alias("beam")).agg(F.min("z").alias("z"), F.max("detectioninfo").alias("detectioninfo"), F.min("x").alias("x"))


SWATH = f"(SELECT ping % 8 AS system, CAST(ping AS DOUBLE) AS time, beam - 1 AS beam, min(z) AS z, max(detectioninfo) AS detectioninfo, min(x) AS x FROM {SQL} GROUP BY 1, 2, 3)"


def time_slice(spark, sf_dir):
    """Samples between the ones nearest to two times, both included."""
    s = S.series(spark, sf_dir)
    return subset.by_time(s, 1_704_500_000.0, 1_705_000_000.0).select("counter", "value")


def time_windows(spark, sf_dir):
    """Samples in any of three windows."""
    s = S.series(spark, sf_dir)
    return subset.by_windows(s, [(1_704_200_000.0, 1_704_300_000.0), (1_704_500_000.0, 1_704_600_000.0), (1_704_550_000.0, 1_704_700_000.0)]).select("counter", "value")


def marked_pairs(spark, sf_dir):
    """Which soundings are among some (ping, beam) pairs."""
    s = _swath(spark, sf_dir)
    pairs = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("double").alias("time"), (F.col("o_custkey") % 7).cast("int").alias("beam"))
    return subset.mark_pairs(s, pairs).groupBy("system", "selected").agg(F.count("*").alias("n"), F.sum("z").alias("depths"))


def accepted(spark, sf_dir):
    """Soundings that are not rejected, without the flag."""
    return subset.drop_rejected(S.soundings(spark, sf_dir)).groupBy("beam").agg(F.count("*").alias("n"), F.max("x").alias("max_x"))


def lines_in_box(spark, sf_dir):
    """Lines wholly inside a box."""
    return subset.lines_in_box(S.positions(spark, sf_dir), -70.0, 71.5, -171.0, 171.0)


def clipped_lines(spark, sf_dir):
    """Lines that meet a window, cut to it."""
    return subset.clipped_lines(S.lines(spark, sf_dir), 1_704_300_000.0, 1_704_600_000.0)


def set_variable(spark, sf_dir):
    """The flag set where a filter holds, and its counts."""
    s = subset.set_where(S.soundings(spark, sf_dir), "detectioninfo", (F.col("z") < 5) & (F.col("beam") > 3), 2)
    return s.groupBy("detectioninfo").agg(F.count("*").alias("n"))


def bits(spark, sf_dir):
    """Counters by whether their third bit is set."""
    return S.series(spark, sf_dir).groupBy(subset.bit_set(F.col("counter"), 3).alias("set")).agg(F.count("*").alias("n"))


def filter_by_depth(spark, sf_dir):
    s = filters.REGISTRY.run(S.soundings(spark, sf_dir), "filter_by_depth", min_depth=5.0, max_depth=45.0)
    return s.groupBy("beam", "detectioninfo").agg(F.count("*").alias("n"))


def filter_by_angle(spark, sf_dir):
    """The angle is the beam's place in the fan."""
    s = S.soundings(spark, sf_dir).withColumn("corr_pointing_angle", F.radians((F.col("beam") - 4) * 20.0))
    return filters.REGISTRY.run(s, "filter_by_angle", min_angle=-45.0, max_angle=45.0).groupBy("beam", "detectioninfo").agg(F.count("*").alias("n"))


def reaccepted(spark, sf_dir):
    """Rejected soundings of shallow depth accepted again."""
    s = filters.REGISTRY.run(S.soundings(spark, sf_dir), "reaccept_rejected", where=F.col("z") < 10)
    return s.groupBy("detectioninfo").agg(F.count("*").alias("n"))


def second_returns(spark, sf_dir):
    """Soundings deeper than twice the running least nadir depth."""
    s = filters.REGISTRY.run(filters.rolling_nadir(_swath(spark, sf_dir)), "second_return", percent_depth=300.0)
    return s.groupBy("system", "detectioninfo").agg(F.count("*").alias("n"))


def processing_dashboard(spark, sf_dir):
    """Soundings of every system in every status, none as 0."""
    s = S.soundings(spark, sf_dir).select((F.col("ping") % 8).alias("system"), (F.col("beam") % 4).alias("processing_status"))
    return stats.dashboard(s).select("system", "status", "soundings")


def rounded_frequencies(spark, sf_dir):
    s = S.soundings(spark, sf_dir).withColumn("frequency", F.col("frequency") * 37)
    return stats.rounded_frequencies(s)


def distinct_modes(spark, sf_dir):
    return S.series(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("n"))


def sounding_counts(spark, sf_dir):
    """Pings and soundings."""
    s = S.soundings(spark, sf_dir)
    return s.agg(F.countDistinct("ping").alias("pings"), F.count("frequency").alias("soundings"))


def mean_beam(spark, sf_dir):
    return stats.reduce_beams(_swath(spark, sf_dir), "z", "mean").select("system", "time", F.bround("z", 9).alias("z"))


def nadir_beam(spark, sf_dir):
    return stats.reduce_beams(_swath(spark, sf_dir), "z", "nadir")


def port_beam(spark, sf_dir):
    return stats.reduce_beams(_swath(spark, sf_dir), "z", "port_outer_beam")


def starboard_beam(spark, sf_dir):
    return stats.reduce_beams(_swath(spark, sf_dir), "z", "starboard_outer_beam")


def last_valid_beam(spark, sf_dir):
    return stats.reduce_beams(_swath(spark, sf_dir), "z", "starboard_valid")


def extents(spark, sf_dir):
    return stats.extents(S.soundings(spark, sf_dir))


def depth_histogram(spark, sf_dir):
    return stats.histogram(S.soundings(spark, sf_dir), "z", 1.0, 50.0, 7)


def position_histogram(spark, sf_dir):
    """Counts of half-open bins in x and y."""
    return stats.histogram_2d(S.soundings(spark, sf_dir), "x", "y", (12, 9), ((900.0, 100_000.0), (0.0, 12_000.0)))


def digitized(spark, sf_dir):
    return S.soundings(spark, sf_dir).groupBy(stats.digitize(F.col("z"), [0.0, 3.0, 6.0, 10.0, 30.0]).alias("bin")).agg(F.count("*").alias("n"))


def _fan(spark, sf_dir):
    return S.soundings(spark, sf_dir).select((F.col("x") - 50_000.0).alias("acrosstrack"), F.col("z").alias("depth"), F.col("frequency").alias("group"))


def extinction(spark, sf_dir):
    """Outermost soundings of every depth bin."""
    return stats.extinction(_fan(spark, sf_dir), "group").select("bin", "port_across", "starboard_across", "port_group", "starboard_group")


def ping_period(spark, sf_dir):
    """Mean period of every mode and depth bin."""
    s = R.steps(S.series(spark, sf_dir), 1e9).withColumn("depth", F.col("value"))
    return stats.ping_period(s, "mode", 50.0).select("group", "bin", F.bround("period", 4).alias("period"), "n")


def _differences(spark, sf_dir):
    s = S.soundings(spark, sf_dir).where("detectioninfo <> 2")
    return stats.difference_to_grid(s, grid.surface(s, 2048.0), 2048.0)


def accuracy_by_beam(spark, sf_dir):
    """Differences to the reference surface by beam."""
    a = stats.accuracy(_differences(spark, sf_dir), F.col("beam"), "beam")
    return a.select("beam", "n", F.bround("mean", 6).alias("mean"), F.bround("std", 6).alias("std"))


def order_limits(spark, sf_dir):
    """Soundings whose difference to the surface is within the vertical limits."""
    d = _differences(spark, sf_dir)
    return d.agg(*[F.sum((F.abs("diff") <= stats.order_limit(F.col("grid_depth"), o)).cast("long")).alias(o) for o in stats.ORDERS])


def line_metadata(spark, sf_dir):
    """Times and end positions of every line."""
    p = S.positions(spark, sf_dir).withColumn("time", F.col("time") + F.col("ping") * 1e-4)
    m = stats.line_metadata(p)
    return m.select("line", *[F.bround(c, 4).alias(c) for c in ("start_time", "end_time", "start_lat", "start_lon", "end_lat", "end_lon")])


def merged_attributes(spark, sf_dir):
    """One value for each attribute name over datasets."""
    s = S.series(spark, sf_dir)
    names = F.element_at(F.array(*map(F.lit, ("min_time", "max_time", "model"))), (F.col("counter") % 3 + 1).cast("int"))
    return stats.merged_attributes(s.select(names.alias("name"), F.col("counter").alias("dataset"), F.col("value").cast("string").alias("value")))


def points_view(spark, sf_dir):
    v = stats.points_view(S.soundings(spark, sf_dir))
    return v.select(*[F.bround(c, 6).alias(c) if c.startswith("mean") else F.col(c) for c in v.columns])


def shoalest_surface(spark, sf_dir):
    """Shoalest depth and mean uncertainties of each cell."""
    s = S.soundings(spark, sf_dir).where("detectioninfo <> 2")
    g = grid.surface(s, 4096.0, extra={"tvu": F.avg("tvu"), "thu": F.avg("thu")})
    return g.select("cell_x", "cell_y", "shoalest", F.bround("tvu", 6).alias("vertical_uncertainty"), F.bround("thu", 6).alias("horizontal_uncertainty"))


def variable_surface(spark, sf_dir):
    """Cells of each tile at the resolution that its depth asks for."""
    s = S.soundings(spark, sf_dir).withColumn("z", F.col("z") * 100)
    return grid.variable_surface(s, 16_384.0).select("tile_x", "tile_y", "resolution", "cell_x", "cell_y", "density", F.bround("depth", 6).alias("depth"))


def slopes(spark, sf_dir):
    """Slopes of the mean surface."""
    g = grid.surface(S.soundings(spark, sf_dir), 8192.0, 1024.0).withColumn("depth", F.bround("depth", 6))
    return grid.slopes(g, 8.0).select("cell_x", "cell_y", F.bround("x_slope", 6).alias("x_slope"), F.bround("y_slope", 6).alias("y_slope"))


def regridded(spark, sf_dir):
    """The surface after points changed: only their tiles are made anew."""
    s = S.soundings(spark, sf_dir)
    old = s.where("frequency <> 7")
    tiled = grid.surface(old, 1024.0).withColumns({"tile_x": F.floor(F.col("cell_x") / 16).cast("bigint"), "tile_y": F.floor(F.col("cell_y") / 16).cast("bigint")})
    cells = tiled.select("tile_x", "tile_y", "cell_x", "cell_y", "density", "depth", "shoalest")
    return grid.updated_cells(cells, s, s.where("frequency = 7"), 1024.0, 16_384.0).select("cell_x", "cell_y", "density", F.bround("depth", 6).alias("depth"), "shoalest")


def quadtree(spark, sf_dir):
    """Leaves of squares of at most 400 points."""
    return grid.quadtree(S.soundings(spark, sf_dir), (0.0, 0.0), 131_072.0, 400, 1024.0)


def within_radius(spark, sf_dir):
    """Soundings within a radius of some centres."""
    c = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("centre_id"), (F.col("n_nationkey") * 4000.0).alias("x"), (F.col("n_nationkey") * 500.0).alias("y"))
    return grid.within_radius(S.soundings(spark, sf_dir), c, 700.0).groupBy("centre_id").agg(F.count("*").alias("n"))


def upserted(spark, sf_dir):
    """Series with newer rows in the place of those of equal keys."""
    s = S.series(spark, sf_dir).select("system", F.floor(F.col("time") / 3600).alias("hour"), "counter", "value")
    old = R.first_of_equal(s.where("counter % 2 = 0"), ["system", "hour"], ["counter"])
    return upsert.merged(old, s.where("counter % 2 = 1"), ["system", "hour"], "counter")


def angle_gain(spark, sf_dir):
    """Angle-varying gain: mean of each angle bin less that of the reference angle."""
    s = S.soundings(spark, sf_dir).select(F.col("z").alias("backscatter"), (F.col("x") / 1000.0 - 52.0).alias("corr_angle_deg"))
    return kernels.angle_gain_table(s, 5.0, 45.0).select("bin", F.bround("correction", 6).alias("correction"))


def mosaic(spark, sf_dir):
    """Mean backscatter of each cell after the angle-varying gain is taken off."""
    s = S.soundings(spark, sf_dir).select("x", "y", F.col("z").cast("double").alias("backscatter"), (F.col("x") / 1000.0 - 52.0).alias("corr_angle_deg"))
    t = kernels.angle_gain_table(s, 5.0, 45.0)
    g = kernels.angle_gain_correct(s, t, 5.0).withColumn("z", F.col("backscatter").cast("double"))
    return grid.surface(g, 8192.0).select("cell_x", "cell_y", "density", F.bround("depth", 3).alias("backscatter"))


def accuracy_by_group(spark, sf_dir):
    """Differences to the reference surface by beam, for each mode and rounded frequency."""
    from ..operators import datasets as D

    d = _differences(spark, sf_dir).withColumns({"mode": F.lit("cw"), "modetwo": F.col("detectioninfo"), "rounded": F.col("beam") % 2})
    a = stats.accuracy_by_group(d, D.group_of_test(d), F.col("beam"), "beam")
    return a.select("group", "beam", "n", F.bround("mean", 6).alias("mean"), F.bround("std", 6).alias("std"))


def gain_tables(spark, sf_dir):
    """Angle-varying gain of several datasets at once."""
    s = S.soundings(spark, sf_dir).select((F.col("ping") % 3).alias("system"), F.col("z").alias("backscatter"), (F.col("x") / 1000.0 - 52.0).alias("corr_angle_deg"))
    t = kernels.angle_gain_tables(s, "system", 5.0, 45.0)
    return t.groupBy("system").agg(F.count("*").alias("bins"), F.bround(F.sum(F.abs("correction")), 5).alias("total"), F.bround(F.max(F.when(F.col("bin") == 10, F.col("correction"))), 6).alias("tenth"))


def leaves_of_points(spark, sf_dir):
    """How many points each leaf of the quadtree has by looking every point up."""
    s = S.soundings(spark, sf_dir)
    leaves = grid.quadtree(s, (0.0, 0.0), 131_072.0, 400, 1024.0)
    return grid.leaves_of(s, leaves, (0.0, 0.0), 131_072.0).groupBy("level", "i", "j").agg(F.count("*").alias("points"))


def polygon_with_lines(spark, sf_dir):
    """Pings of a project in a ring, with their lines."""
    from .function_queries import RING

    p = S.positions(spark, sf_dir).withColumns({"system": F.col("line") % 3, "time": F.col("ping").cast("double")}).drop("line")
    return subset.in_polygon_with_lines(p, _ring_lines(spark, sf_dir), RING).select("ping", "line")


def _ring_lines(spark, sf_dir):
    """Lines of a hundred pings each, the first half of every two hundred."""
    p = S.positions(spark, sf_dir).withColumn("k", F.floor(F.col("ping") / 200))
    return p.where("ping % 200 < 100").groupBy((F.col("line") % 3).alias("system"), F.col("k").cast("string").alias("line")).agg(F.min("ping").cast("double").alias("start_time"), F.max("ping").cast("double").alias("end_time"))


def read_where(spark, sf_dir):
    """Counters of a mode with the values of another one's nearest samples."""
    s = S.series(spark, sf_dir)
    return subset.read_where(s.drop("value"), ["counter", "value"], F.col("mode") == "click", s.where("mode in ('view', 'error')"))


def compared_solution(spark, sf_dir):
    """How another series differs from the values at each sample."""
    s = S.series(spark, sf_dir)
    x = stats.compared_solution(s.where("mode = 'click'"), s.where("mode in ('view', 'error')").select("system", "time", "value"), ["value"])
    return x.select("system", "variable", F.bround("mean", 6).alias("mean"), F.bround("std", 6).alias("std"), F.bround("most", 6).alias("most"), "n")


W = "OVER (PARTITION BY system ORDER BY time)"
NADIR = f"""(SELECT system, time, CASE WHEN k < 10 THEN max(CASE WHEN k = 10 THEN m END) OVER (PARTITION BY system) ELSE m END AS nadir_min FROM (SELECT system, time, row_number() {W} AS k, min(z) OVER (PARTITION BY system ORDER BY time ROWS 9 PRECEDING) AS m
    FROM {SWATH} s JOIN (SELECT system AS sys, greatest(floor((max(beam) + 1) / 2 - 1), 0) AS nadir FROM {SWATH} GROUP BY 1) n ON sys = system AND beam = nadir))"""
DIFF = f"""(SELECT s.*, g.depth AS grid_depth, s.z - g.depth AS diff FROM (SELECT *, floor(x / 2048) AS i, floor(y / 2048) AS j FROM {SQL} WHERE detectioninfo <> 2) s
    JOIN (SELECT floor(x / 2048) AS i, floor(y / 2048) AS j, avg(z) AS depth FROM {SQL} WHERE detectioninfo <> 2 GROUP BY 1, 2) g USING (i, j))"""
NEAR = lambda t: f"(SELECT min_by(time, abs(time - {t})) FROM {E})"
COARSE = f"(SELECT CAST(floor(x / 8192) AS BIGINT) AS cell_x, CAST(floor(y / 1024) AS BIGINT) AS cell_y, round_even(avg(z), 6) AS depth FROM {SQL} GROUP BY 1, 2)"
AVG_SQL = """(WITH m AS (SELECT CAST(ceil((x / 1000.0 - 52.0 + 90) / 5.0) - 1 AS INTEGER) AS bin, avg(z) AS m FROM {sql} GROUP BY 1), b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(36)),
    n AS (SELECT b.bin, m.m, (SELECT max(bin) FROM m WHERE m.bin <= b.bin) AS lo, (SELECT min(bin) FROM m WHERE m.bin >= b.bin) AS hi FROM b LEFT JOIN m USING (bin)),
    y AS (SELECT n.bin, CASE WHEN lo IS NULL THEN h.m WHEN hi IS NULL OR lo = hi THEN l.m ELSE l.m + (h.m - l.m) * (n.bin - lo) / (hi - lo) END AS y FROM n LEFT JOIN m l ON l.bin = lo LEFT JOIN m h ON h.bin = hi)
    SELECT bin, y - (SELECT y FROM y WHERE bin = 26) AS correction FROM y)""".replace("{sql}", SQL)
RES = "CASE WHEN d <= 20 THEN 0.5 WHEN d <= 40 THEN 1 WHEN d <= 80 THEN 4 WHEN d <= 160 THEN 8 WHEN d <= 320 THEN 16 WHEN d <= 640 THEN 32 WHEN d <= 1280 THEN 64 WHEN d <= 2560 THEN 128 WHEN d <= 5120 THEN 256 WHEN d <= 10204 THEN 512 ELSE 1024 END"
FLAGGED = "SELECT beam, {flag} AS detectioninfo, count(*) AS n FROM " + SQL + " GROUP BY 1, 2"

def _in_lines_sql() -> str:
    from .function_queries import _polygon_sql

    lines = f"(SELECT line % 3 AS system, CAST(ping // 200 AS VARCHAR) AS line, min(ping) AS s, max(ping) AS e FROM {S.POSITIONS_SQL} WHERE ping % 200 < 100 GROUP BY 1, 2)"
    own = f"(SELECT p.ping, o.line % 3 AS system FROM ({_polygon_sql()}) p JOIN {S.POSITIONS_SQL} o ON o.ping = p.ping)"
    held = "SELECT arg_max(l.line, l.s) FROM L l WHERE l.system = p.system AND l.s - 1 <= p.ping"
    end = "SELECT max(e) FROM L l WHERE l.system = p.system"
    q = f"""SELECT ping, CASE WHEN NOT EXISTS (SELECT 1 FROM L l WHERE l.system = p.system AND l.s - 1 <= p.ping) THEN (SELECT arg_min(l.line, l.s) FROM L l WHERE l.system = p.system)
        WHEN p.ping > ({end}) OR p.ping <= (SELECT arg_max(l.e, l.s) + 1 FROM L l WHERE l.system = p.system AND l.s - 1 <= p.ping) THEN ({held}) END AS line FROM {own} p"""
    return f"WITH L AS {lines} {q}"


QUERIES = {
    f.__name__: f
    for f in (
        time_slice, time_windows, marked_pairs, accepted, lines_in_box, clipped_lines, set_variable, bits, filter_by_depth, filter_by_angle, reaccepted, second_returns, processing_dashboard, rounded_frequencies, distinct_modes,
        sounding_counts, mean_beam, nadir_beam, port_beam, starboard_beam, last_valid_beam, extents, depth_histogram, position_histogram, digitized, extinction, ping_period, accuracy_by_beam, order_limits, line_metadata,
        merged_attributes, points_view, shoalest_surface, variable_surface, slopes, regridded, quadtree, within_radius, upserted, angle_gain, mosaic, accuracy_by_group, gain_tables, leaves_of_points, polygon_with_lines, read_where, compared_solution,
    )
}


def _quadtree_sql() -> str:
    levels = 7
    q = [f"n AS (SELECT CAST(floor(x / 1024) AS BIGINT) AS i, CAST(floor(y / 1024) AS BIGINT) AS j, count(*) AS c FROM {SQL} GROUP BY 1, 2)"]
    for k in range(levels + 1):
        q.append(f"u{k} AS (SELECT i >> {levels - k} AS i, j >> {levels - k} AS j, CAST(sum(c) AS BIGINT) AS points FROM n GROUP BY 1, 2)")
    leaves = ["SELECT 0 AS level, i, j, points FROM u0 WHERE points <= 400"]
    for k in range(1, levels + 1):
        leaves.append(f"SELECT {k}, i, j, points FROM u{k} u WHERE EXISTS (SELECT 1 FROM u{k - 1} p WHERE p.i = u.i >> 1 AND p.j = u.j >> 1 AND p.points > 400)" + (" AND points <= 400" if k < levels else ""))
    return f"WITH {', '.join(q)} {' UNION ALL '.join(leaves)}"


ORACLES = {
    "time_slice": f"SELECT counter, value FROM {E} WHERE time BETWEEN {NEAR(1704500000)} AND {NEAR(1705000000)}",
    "time_windows": f"SELECT counter, value FROM {E} WHERE time BETWEEN {NEAR(1704200000)} AND {NEAR(1704300000)} OR time BETWEEN {NEAR(1704500000)} AND {NEAR(1704600000)} OR time BETWEEN {NEAR(1704550000)} AND {NEAR(1704700000)}",
    "marked_pairs": f"SELECT system, p.time IS NOT NULL AS selected, count(*) AS n, sum(z) AS depths FROM {SWATH} s LEFT JOIN (SELECT DISTINCT CAST(o_orderkey AS DOUBLE) AS time, o_custkey % 7 AS beam FROM orders) p ON p.time = s.time AND p.beam = s.beam GROUP BY 1, 2",
    "accepted": f"SELECT beam, count(*) AS n, max(x) AS max_x FROM {SQL} WHERE detectioninfo <> 2 GROUP BY 1",
    "lines_in_box": f"SELECT line FROM {S.POSITIONS_SQL} GROUP BY line HAVING min(lat) > -70 AND max(lat) < 71.5 AND min(lon) > -171 AND max(lon) < 171",
    "clipped_lines": f"SELECT system, line, greatest(start_time, 1704300000.0) AS start_time, least(end_time, 1704600000.0) AS end_time FROM {S.LINES_SQL} WHERE start_time <= 1704600000 AND end_time >= 1704300000",
    "set_variable": f"SELECT CASE WHEN z < 5 AND beam > 3 THEN 2 ELSE detectioninfo END AS detectioninfo, count(*) AS n FROM {SQL} GROUP BY 1",
    "bits": f"SELECT (counter >> 2) & 1 = 1 AS \"set\", count(*) AS n FROM {E} GROUP BY 1",
    "filter_by_depth": FLAGGED.format(flag="CASE WHEN z < 5 OR z > 45 THEN 2 ELSE detectioninfo END"),
    "filter_by_angle": FLAGGED.format(flag="CASE WHEN beam < 2 OR beam > 6 THEN 2 ELSE detectioninfo END"),
    "reaccepted": f"SELECT CASE WHEN z < 10 AND detectioninfo = 2 THEN 3 ELSE detectioninfo END AS detectioninfo, count(*) AS n FROM {SQL} GROUP BY 1",
    "second_returns": f"SELECT s.system, CASE WHEN z > nadir_min * 6 THEN 2 ELSE detectioninfo END AS detectioninfo, count(*) AS n FROM {SWATH} s LEFT JOIN {NADIR} n ON n.system = s.system AND n.time = s.time GROUP BY 1, 2",
    "processing_dashboard": f"SELECT system, status, count(p) AS soundings FROM (SELECT DISTINCT ping % 8 AS system FROM {SQL}) CROSS JOIN (SELECT CAST(range AS INTEGER) AS status FROM range(6)) LEFT JOIN (SELECT ping % 8 AS s, beam % 4 AS p FROM {SQL}) ON s = system AND p = status GROUP BY 1, 2",
    "rounded_frequencies": f"SELECT DISTINCT CAST(round_even(f / pow(10, d - 1), 0) * pow(10, d - 1) AS BIGINT) AS frequency FROM (SELECT f, length(CAST(f AS VARCHAR)) AS d, max(length(CAST(f AS VARCHAR))) OVER () AS m FROM (SELECT DISTINCT frequency * 37 AS f FROM {SQL})) WHERE d = m",
    "distinct_modes": f"SELECT mode, count(*) AS n FROM {E} GROUP BY 1",
    "sounding_counts": f"SELECT count(DISTINCT ping) AS pings, count(frequency) AS soundings FROM {SQL}",
    "mean_beam": f"SELECT system, time, round_even(avg(z), 9) AS z FROM {SWATH} GROUP BY 1, 2",
    "nadir_beam": f"SELECT s.system, time, z FROM {SWATH} s JOIN (SELECT system, greatest(floor((max(beam) + 1) / 2 - 1), 0) AS b FROM {SWATH} GROUP BY 1) n ON n.system = s.system AND b = beam",
    "port_beam": f"SELECT system, time, z FROM {SWATH} WHERE beam = 0",
    "starboard_beam": f"SELECT s.system, time, z FROM {SWATH} s JOIN (SELECT system, max(beam) AS b FROM {SWATH} GROUP BY 1) n ON n.system = s.system AND b = beam",
    "last_valid_beam": f"SELECT system, time, coalesce(max_by(z, beam) FILTER (WHERE z <> 0), max(z) FILTER (WHERE beam = 0)) AS z FROM {SWATH} GROUP BY 1, 2",
    "extents": f"SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, round_even(min(z), 3) AS min_z, round_even(max(z), 3) AS max_z FROM {SQL}",
    "depth_histogram": f"SELECT CAST(floor((z - 1.0) * (7 / 49.0)) AS INTEGER) AS bin, count(*) AS n FROM {SQL} WHERE floor((z - 1.0) * (7 / 49.0)) BETWEEN 0 AND 6 GROUP BY 1",
    "position_histogram": f"SELECT CAST(floor((x - 900.0) * (12 / 99100.0)) AS INTEGER) AS i, CAST(floor(y * (9 / 12000.0)) AS INTEGER) AS j, count(*) AS n FROM {SQL} WHERE floor((x - 900.0) * (12 / 99100.0)) BETWEEN 0 AND 11 AND floor(y * (9 / 12000.0)) BETWEEN 0 AND 8 GROUP BY 1, 2",
    "digitized": f"SELECT CAST(z >= 0 AS INTEGER) + CAST(z >= 3 AS INTEGER) + CAST(z >= 6 AS INTEGER) + CAST(z >= 10 AS INTEGER) + CAST(z >= 30 AS INTEGER) AS bin, count(*) AS n FROM {SQL} GROUP BY 1",
    "extinction": f"""SELECT bin, p.a AS port_across, s.a AS starboard_across, p.g AS port_group, s.g AS starboard_group FROM (SELECT CAST(floor(z / 10.0) AS BIGINT) AS bin, min(struct_pack(a := x - 50000.0, d := z, g := frequency)) AS p, max(struct_pack(a := x - 50000.0, d := z, g := frequency)) AS s
        FROM {SQL} WHERE z > 0 GROUP BY 1) WHERE p.a < 0 AND s.a > 0""",
    "ping_period": f"SELECT mode AS \"group\", CAST(floor(value / 50.0) AS BIGINT) AS bin, round_even(avg(dt), 4) AS period, count(*) AS n FROM (SELECT *, time - lag(time) {W} AS dt FROM {E}) WHERE dt > 0 AND dt < 1e9 GROUP BY 1, 2",
    "accuracy_by_beam": f"SELECT beam, count(*) AS n, round_even(avg(diff - m), 6) AS mean, round_even(stddev_pop(diff - m), 6) AS std FROM (SELECT *, avg(diff) OVER () AS m FROM {DIFF}) GROUP BY 1",
    "order_limits": f"SELECT CAST(sum(CAST(abs(diff) <= sqrt(0.0625 + pow(grid_depth * 0.0075, 2)) AS INTEGER)) AS BIGINT) AS special, CAST(sum(CAST(abs(diff) <= sqrt(0.25 + pow(grid_depth * 0.013, 2)) AS INTEGER)) AS BIGINT) AS order_1 FROM {DIFF}",
    "line_metadata": f"SELECT line, round_even(min(t), 4) AS start_time, round_even(max(t), 4) AS end_time, round_even(min_by(lat, t), 4) AS start_lat, round_even(min_by(lon, t), 4) AS start_lon, round_even(max_by(lat, t), 4) AS end_lat, round_even(max_by(lon, t), 4) AS end_lon FROM (SELECT line, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, time + ping * 1e-4 AS t FROM {S.POSITIONS_SQL}) GROUP BY 1",
    "merged_attributes": f"SELECT name, CASE WHEN name LIKE 'min%' THEN CAST(min(value) AS VARCHAR) WHEN name LIKE 'max%' THEN CAST(max(value) AS VARCHAR) ELSE CAST(min_by(value, counter) AS VARCHAR) END AS value FROM (SELECT ['min_time', 'max_time', 'model'][counter % 3 + 1] AS name, value, counter FROM {E}) GROUP BY name",
    "points_view": f"SELECT count(*) AS points, min(x) AS min_x, max(x) AS max_x, round_even(avg(x), 6) AS mean_x, min(y) AS min_y, max(y) AS max_y, round_even(avg(y), 6) AS mean_y, min(z) AS min_z, max(z) AS max_z, round_even(avg(z), 6) AS mean_z, count(*) FILTER (WHERE detectioninfo = 2) AS rejected, min(beam) AS min_beam, max(beam) AS max_beam FROM {SQL}",
    "shoalest_surface": f"SELECT CAST(floor(x / 4096) AS BIGINT) AS cell_x, CAST(floor(y / 4096) AS BIGINT) AS cell_y, min(z) AS shoalest, round_even(avg(tvu), 6) AS vertical_uncertainty, round_even(avg(thu), 6) AS horizontal_uncertainty FROM {SQL} WHERE detectioninfo <> 2 GROUP BY 1, 2",
    "variable_surface": f"""SELECT s.tile_x, s.tile_y, resolution, CAST(floor(x / resolution) AS BIGINT) AS cell_x, CAST(floor(y / resolution) AS BIGINT) AS cell_y, count(*) AS density, round_even(avg(z), 6) AS depth FROM (SELECT x, y, z * 100 AS z, CAST(floor(x / 16384) AS BIGINT) AS tile_x, CAST(floor(y / 16384) AS BIGINT) AS tile_y FROM {SQL}) s
        JOIN (SELECT tile_x, tile_y, CAST({RES} AS DOUBLE) AS resolution FROM (SELECT CAST(floor(x / 16384) AS BIGINT) AS tile_x, CAST(floor(y / 16384) AS BIGINT) AS tile_y, avg(z * 100) AS d FROM {SQL} GROUP BY 1, 2)) t ON t.tile_x = s.tile_x AND t.tile_y = s.tile_y GROUP BY 1, 2, 3, 4, 5""",
    "slopes": "SELECT c.cell_x, c.cell_y, "
    + ", ".join(f"round_even(CASE WHEN {a}u.depth IS NOT NULL AND {a}d.depth IS NOT NULL THEN ({a}u.depth - {a}d.depth) / 16 WHEN {a}u.depth IS NOT NULL THEN ({a}u.depth - c.depth) / 8 WHEN {a}d.depth IS NOT NULL THEN (c.depth - {a}d.depth) / 8 END, 6) AS {a}_slope" for a in "xy")
    + f" FROM {COARSE} c LEFT JOIN {COARSE} xu ON xu.cell_x = c.cell_x + 1 AND xu.cell_y = c.cell_y LEFT JOIN {COARSE} xd ON xd.cell_x = c.cell_x - 1 AND xd.cell_y = c.cell_y LEFT JOIN {COARSE} yu ON yu.cell_x = c.cell_x AND yu.cell_y = c.cell_y + 1 LEFT JOIN {COARSE} yd ON yd.cell_x = c.cell_x AND yd.cell_y = c.cell_y - 1",
    "regridded": f"SELECT CAST(floor(x / 1024) AS BIGINT) AS cell_x, CAST(floor(y / 1024) AS BIGINT) AS cell_y, count(*) AS density, round_even(avg(z), 6) AS depth, min(z) AS shoalest FROM {SQL} GROUP BY 1, 2",
    "quadtree": _quadtree_sql(),
    "within_radius": f"SELECT centre_id, count(*) AS n FROM {SQL} JOIN (SELECT n_nationkey AS centre_id, n_nationkey * 4000.0 AS cx, n_nationkey * 500.0 AS cy FROM nation) ON pow(x - cx, 2) + pow(y - cy, 2) <= 490000 GROUP BY 1",
    "upserted": f"""SELECT system, hour, counter, value FROM (SELECT *, row_number() OVER (PARTITION BY system, hour ORDER BY age DESC, CASE WHEN age = 1 THEN -counter ELSE counter END) AS k FROM (SELECT system, CAST(floor(time / 3600) AS BIGINT) AS hour, counter, value, counter % 2 AS age FROM {E})) WHERE k = 1""",
    "angle_gain": f"SELECT bin, round_even(correction, 6) AS correction FROM {AVG_SQL}",
    "mosaic": f"SELECT CAST(floor(x / 8192) AS BIGINT) AS cell_x, CAST(floor(y / 8192) AS BIGINT) AS cell_y, count(*) AS density, round_even(avg(CAST(CAST(z - correction AS FLOAT) AS DOUBLE)), 3) AS backscatter FROM (SELECT *, CAST(ceil((x / 1000.0 - 52.0 + 90) / 5.0) - 1 AS INTEGER) AS bin FROM {SQL}) JOIN {AVG_SQL} USING (bin) GROUP BY 1, 2",
    "accuracy_by_group": f"SELECT \"group\", beam, count(*) AS n, round_even(avg(diff - m), 6) AS mean, round_even(stddev_pop(diff - m), 6) AS std FROM (SELECT *, avg(diff) OVER (PARTITION BY \"group\") AS m FROM (SELECT *, 'cw_' || detectioninfo || '_' || beam % 2 AS \"group\" FROM {DIFF})) GROUP BY 1, 2",
    "gain_tables": " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS system, count(*) AS bins, round_even(sum(abs(correction)), 5) AS total, round_even(max(CASE WHEN bin = 10 THEN correction END), 6) AS tenth FROM {AVG_SQL.replace(SQL, f'(SELECT * FROM {SQL} WHERE ping % 3 = {k})')}" for k in range(3)),
    "leaves_of_points": _quadtree_sql(),
    "polygon_with_lines": _in_lines_sql(),
    "read_where": f"SELECT counter, CASE WHEN av IS NULL OR (bv IS NOT NULL AND time - bt <= nt - time) THEN bv ELSE av END AS value FROM {BOTH}",
    "compared_solution": f"SELECT system, 'value' AS variable, round_even(avg(d), 6) AS mean, round_even(stddev_pop(d), 6) AS std, round_even(max(abs(d)), 6) AS most, count(*) AS n FROM (SELECT b.system, CASE WHEN av IS NULL OR (bv IS NOT NULL AND b.time - bt <= nt - b.time) THEN bv ELSE av END - e.value AS d FROM {BOTH} b JOIN {E} e ON e.counter = b.counter) WHERE d IS NOT NULL GROUP BY 1",
}
