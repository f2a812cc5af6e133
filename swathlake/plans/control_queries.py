"""Queries on parameter sets, matching and bookkeeping, and exports and stream aggregates in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import params
from ..sources import exports
from ..streaming import folder
from . import control
from . import stand_ins as S

E = S.SERIES_SQL
#: supplier and nation as parameter rows: system = nation, ts = a number of the key, param by key, value a rounded balance.
PARAMS = "(SELECT s_nationkey AS system, CAST(s_suppkey % 5 * 100 AS DOUBLE) AS ts, ['tx_x', 'tx_r', 'waterline', 'latency', 'heave_error', 'rx_p', 'tx_y_1'][s_suppkey % 7 + 1] AS param, max(floor(s_acctbal / 1000)) AS value FROM supplier GROUP BY 1, 2, 3)"


def _params(spark, sf_dir):
    k = F.col("s_suppkey")
    names = F.element_at(F.array(*map(F.lit, ("tx_x", "tx_r", "waterline", "latency", "heave_error", "rx_p", "tx_y_1"))), (k % 7 + 1).cast("int"))
    s = S.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("system"), (k % 5 * 100).cast("double").alias("ts"), names.alias("param"), F.floor(F.col("s_acctbal") / 1000).cast("double").alias("value"))
    return s.groupBy("system", "ts", "param").agg(F.max("value").alias("value"))


def compared_parameters(spark, sf_dir):
    """Which classes of values two sets agree in; the other set differs in offsets of one system."""
    p = _params(spark, sf_dir)
    return params.compare(p, p.withColumn("value", F.when((F.col("param") == "tx_x") & (F.col("ts") > 100), F.col("value") + 1).otherwise(F.col("value"))))


def earliest_parameters(spark, sf_dir):
    """Parameter sets without those that a later time only repeats."""
    p = _params(spark, sf_dir).where("param = 'waterline'").withColumn("value", F.lit(1.0))
    return params.earliest_of_equal(p)


def parameters_in_window(spark, sf_dir):
    return params.in_window(_params(spark, sf_dir), 150.0, 350.0)


def carried_parameters(spark, sf_dir):
    """New versions with the parameters that only older ones have."""
    p = _params(spark, sf_dir)
    return params.carried_over(p.where("ts < 300"), p.where("ts >= 300 and param in ('tx_x', 'waterline')"))


def close_in_time(spark, sf_dir):
    """Pairs of files, orders and customers, whose starts and ends are within two seconds."""
    o, c = S.table(spark, sf_dir, "orders"), S.table(spark, sf_dir, "customer")
    a = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 1.5).alias("start"), (F.col("o_custkey") * 1.5 + F.col("o_orderkey") % 7).alias("end"))
    return params.close_in_time(a, c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 1.5).alias("start"), (F.col("c_custkey") * 1.5 + F.col("c_nationkey") % 7).alias("end")))


def matches_by_vote(spark, sf_dir):
    """The dataset that most votes match to each file."""
    o = S.table(spark, sf_dir, "orders")
    votes = [o.select((F.col("o_orderkey") % 500).alias("id"), (F.col("o_custkey") % m).alias("match")) for m in (7, 9)]
    return params.match_votes(*votes)


def surface_lines(spark, sf_dir):
    """Lines that are new, stale, current or removed in a surface."""
    o, l = S.table(spark, sf_dir, "orders"), S.table(spark, sf_dir, "lineitem")  # noqa: E741
    d = o.groupBy((F.col("o_orderkey") % 9).alias("container"), (F.col("o_custkey") % 700).alias("line")).agg(F.max("o_orderkey").alias("processed"))
    s = l.groupBy((F.col("l_suppkey") % 11).alias("container"), (F.col("l_partkey") % 900).alias("line")).agg(F.max("l_orderkey").alias("added"))
    return control.stale_lines(d, s)


def next_action(spark, sf_dir):
    """The waiting action of the smallest priority number."""
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("priority"), F.col("o_orderdate").alias("created"))
    return control.next_action(o).select("id", "priority")


def opposite_lines(spark, sf_dir):
    """Pairs of lines run in opposite directions, with the distance of their nearest ends."""
    c = S.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    lines = c.select(k.alias("line"), (k * 37 % 360).cast("double").alias("azimuth"), *[((k * a % 100) / 10.0 - b).cast("double").alias(n) for n, a, b in (("start_lat", 7, 5), ("start_lon", 11, 3), ("end_lat", 13, 4), ("end_lon", 17, 6))])
    return params.patch_pairs(lines, 15.0).select("a", "b", F.bround("km", 6).alias("km"))


def exported_text(spark, sf_dir):
    """Text lines of the accepted soundings."""
    s = S.soundings(spark, sf_dir)
    return exports.xyz_text(exports.export_rows(s, z_down=False), ",", "xyzv").select("value")


def las_classes(spark, sf_dir):
    return S.soundings(spark, sf_dir).groupBy(exports.las_class(F.col("detectioninfo")).alias("class")).agg(F.count("*").alias("n"))


def track_lengths(spark, sf_dir):
    """Letters and points of every line's track as text."""
    t = exports.tracks(S.positions(spark, sf_dir).withColumn("time", F.col("time") + F.col("ping") * 1e-4))
    return t.select("line", F.size(F.split("wkt", ",")).cast("bigint").alias("points"), F.length("wkt").cast("bigint").alias("letters"))


def event_windows(spark, sf_dir):
    """Counts and sums of events in windows of a day."""
    e = S.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return folder.event_windows(e, "1 day").select(F.unix_seconds("start").alias("start"), "event_type", "n", F.bround("total", 4).alias("total"))


def event_sessions(spark, sf_dir):
    """Sessions of users that six hours part."""
    e = S.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return folder.event_sessions(e).select("user_id", F.unix_micros("start").alias("start"), "n")


QUERIES = {
    f.__name__: f
    for f in (compared_parameters, earliest_parameters, parameters_in_window, carried_parameters, close_in_time, matches_by_vote, surface_lines, next_action, opposite_lines, exported_text, las_classes, track_lengths, event_windows, event_sessions)
}
_O = "SELECT o_orderkey AS id, o_custkey * 1.5 AS s, o_custkey * 1.5 + o_orderkey % 7 AS e FROM orders"
_C = "SELECT c_custkey AS id, c_custkey * 1.5 AS s, c_custkey * 1.5 + c_nationkey % 7 AS e FROM customer"
_LINE = "(SELECT c_custkey AS line, CAST(c_custkey * 37 % 360 AS DOUBLE) AS az, c_custkey * 7 % 100 / 10.0 - 5 AS y1, c_custkey * 11 % 100 / 10.0 - 3 AS x1, c_custkey * 13 % 100 / 10.0 - 4 AS y2, c_custkey * 17 % 100 / 10.0 - 6 AS x2 FROM customer)"
_KM = lambda p, q: f"2 * 6371.0 * asin(sqrt(pow(sin((radians(b.y{q}) - radians(a.y{p})) / 2), 2) + cos(radians(a.y{p})) * cos(radians(b.y{q})) * pow(sin((radians(b.x{q}) - radians(a.x{p})) / 2), 2)))"
_W = "OVER (PARTITION BY user_id ORDER BY ts)"
ORACLES = {
    "compared_parameters": f"SELECT coalesce(bool_and(ok) FILTER (WHERE param = 'tx_x'), true) AS same_offset, true AS same_angle, true AS same_latency, true AS same_waterline, true AS same_tpu, bool_and(ok) AS identical FROM (SELECT param, NOT (param = 'tx_x' AND ts > 100) AS ok FROM {PARAMS})",
    "earliest_parameters": f"SELECT system, min(ts) AS ts, 'waterline' AS param, CAST(1 AS DOUBLE) AS value FROM {PARAMS} WHERE param = 'waterline' GROUP BY 1",
    "parameters_in_window": f"SELECT p.* FROM {PARAMS} p LEFT JOIN (SELECT system AS s, max(ts) AS b FROM {PARAMS} WHERE ts <= 150 GROUP BY 1) ON s = system WHERE ts = b OR ts BETWEEN 90 AND 350",
    "carried_parameters": f"""WITH o AS (SELECT * FROM {PARAMS} WHERE ts < 300), n AS (SELECT * FROM {PARAMS} WHERE ts >= 300 AND param IN ('tx_x', 'waterline'))
        SELECT system, ts, param, value FROM n UNION ALL SELECT t.system, t.ts, o.param, max_by(o.value, o.ts) FROM (SELECT DISTINCT system, ts FROM n) t JOIN o ON o.system = t.system AND o.ts <= t.ts
        WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.system = t.system AND n.ts = t.ts AND n.param = o.param) GROUP BY 1, 2, 3""",
    "close_in_time": f"SELECT a.id AS a_id, b.id AS b_id FROM ({_O}) a JOIN ({_C}) b ON b.s BETWEEN a.s - 2 AND a.s + 2 WHERE abs(a.e - b.e) < 2",
    "matches_by_vote": 'SELECT id, "match" FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, "match") AS k FROM (SELECT id, "match", count(*) AS c FROM (SELECT o_orderkey % 500 AS id, o_custkey % 7 AS "match" FROM orders UNION ALL SELECT o_orderkey % 500, o_custkey % 9 FROM orders) GROUP BY 1, 2)) WHERE k = 1',
    "surface_lines": """WITH d AS (SELECT o_orderkey % 9 AS container, o_custkey % 700 AS line, max(o_orderkey) AS processed FROM orders GROUP BY 1, 2),
        s AS (SELECT l_suppkey % 11 AS container, l_partkey % 900 AS line, max(l_orderkey) AS added FROM lineitem GROUP BY 1, 2)
        SELECT container, line, CASE WHEN added IS NULL THEN 'new' WHEN processed IS NULL THEN 'removed' WHEN processed > added THEN 'stale' ELSE 'current' END AS state FROM d FULL JOIN s USING (container, line)""",
    "next_action": "SELECT o_orderkey AS id, o_custkey % 5 AS priority FROM orders ORDER BY o_custkey % 5, o_orderdate, o_orderkey LIMIT 1",
    "opposite_lines": f"SELECT a.line AS a, b.line AS b, round_even(least({_KM(1, 1)}, {_KM(1, 2)}, {_KM(2, 1)}, {_KM(2, 2)}), 6) AS km FROM {_LINE} a JOIN {_LINE} b ON a.line < b.line AND abs(((a.az - b.az) % 360 + 360) % 360 - 180) <= 15",
    "exported_text": "SELECT format('{:.3f},{:.3f},{:.3f},{:.3f}', l_extendedprice, CAST(l_orderkey AS DOUBLE), -l_quantity, l_discount) AS value FROM lineitem WHERE l_returnflag <> 'R'",
    "las_classes": "SELECT CASE l_returnflag WHEN 'R' THEN 7 ELSE 1 END AS class, count(*) AS n FROM lineitem GROUP BY 1",
    "track_lengths": f"SELECT line, count(*) AS points, 14 + CAST(sum(length(format('{{:.6f}} {{:.6f}}', CAST(lon AS DOUBLE), CAST(lat AS DOUBLE)))) AS BIGINT) - 1 + 2 * (count(*) - 1) AS letters FROM {S.POSITIONS_SQL} GROUP BY 1",
    "event_windows": "SELECT CAST(floor(epoch_us(ts) / 1e6 / 86400) * 86400 AS BIGINT) AS start, event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": f"SELECT user_id, min(epoch_us(ts)) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(f) {_W} AS k FROM (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) {_W} >= 21600000000 THEN 1 ELSE 0 END AS f FROM events)) GROUP BY user_id, k",
}
