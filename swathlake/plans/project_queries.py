"""Queries on a project's vessel, its queue of actions and its pairs of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import params, vessel
from ..operators.tables import kept
from . import actions
from . import stand_ins as S
from .control_queries import PARAMS, _params

# --- the vessel


def _other(p):
    """Another history of the same parameters: later, and with some other values."""
    return p.where("ts >= 100").withColumns({"ts": F.col("ts") + 50, "value": F.when(F.col("param") == "tx_x", F.col("value")).otherwise(F.col("value") + F.col("system") % 2)})


def vessel_sets(spark, sf_dir):
    """Each set of parameters as a row of its own, numbered in time."""
    return vessel.split(_params(spark, sf_dir)).select("system", "ts", "n", F.size("values").alias("parameters"), F.bround(F.aggregate(F.map_values("values"), F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


def vessel_differences(spark, sf_dir):
    """Which kinds of parameters of each system another history has otherwise."""
    p = _params(spark, sf_dir)
    return vessel.differences(p, _other(p))


def vessel_updated(spark, sf_dir):
    """A vessel after sets of another history came in: with the uncertainties of the last set, without repeated sets."""
    p = _params(spark, sf_dir)
    return vessel.updated(p, _other(p)).select("system", "ts", "param", "value")


def vessel_intervals(spark, sf_dir):
    """From when to when each value holds."""
    return vessel.intervals(_params(spark, sf_dir))


def vessel_overlaid(spark, sf_dir):
    """One history over another: from 100 to 250 the second holds."""
    p = _params(spark, sf_dir)
    over = vessel.intervals(_other(p), 400.0).where("start < 250").withColumn("end", F.least("end", F.lit(250.0)))
    return vessel.overlaid(vessel.intervals(p, 1000.0), over)


def vessel_round_trip(spark, sf_dir):
    """Parameters of datasets in the vessel's form and back, with what the vessel knows of the sonar."""
    p = _params(spark, sf_dir)
    about = p.select("system").distinct().withColumns({"sonar_type": F.concat(F.lit("em"), F.col("system").cast("string")), "source": F.when(F.col("system") % 3 > 0, F.concat(F.lit("file"), F.col("system").cast("string")))})
    back, description = vessel.from_vessel(vessel.to_vessel(p, about))
    return back.join(description, ["system", "ts"]).select("system", "ts", "param", F.col("value").cast("double").alias("value"), "sonar_type", "source")


# --- the queue


def _plan(spark, sf_dir):
    """customers as files, suppliers as datasets, parts as casts, nations as surfaces."""
    c, s, n, p = (S.table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "part"))
    k = F.col("c_custkey")
    files = c.select(F.concat(F.lit("f"), k.cast("string")).alias("name"), (k % 97).alias("size"), F.lit("em").alias("model"), (k % 60).alias("serial"), (86_400.0 * (k % 5)).alias("start"))
    known = files.where("size % 3 > 0").select("name", "size")
    d = s.select(F.col("s_suppkey").cast("string").alias("dataset"), (F.col("s_suppkey") % 60).alias("serial"), (86_400.0 * (F.col("s_suppkey") % 5)).alias("start"), (F.col("s_suppkey") % 7).cast("int").alias("status"), (F.col("s_nationkey") % 4 == 0).alias("waterline"))
    d = d.withColumns({f: F.lit(False) for f in ("crs", "datum", "reference", "offsets", "angles", "tpu")}).withColumn("status", F.least("status", F.lit(5)))
    named = d.select(F.col("dataset").alias("name"), "serial", "start")
    nav = c.select((k % 40).cast("string").alias("dataset"), F.concat(F.lit("n"), (k % 11).cast("string")).alias("file"))
    casts = p.select((F.col("p_partkey") % 5).alias("d")).distinct().select(F.concat(F.lit("d"), F.col("d").cast("string")).alias("digest"), F.concat(F.lit("c"), F.col("d").cast("string")).alias("file"))
    own = d.select("dataset", F.explode(F.sequence(F.lit(0), F.col("status"))).alias("i")).select("dataset", F.concat(F.lit("d"), F.col("i").cast("string")).alias("digest"))
    lines = s.select(F.col("s_suppkey").cast("string").alias("container"), F.lit("all").alias("line"), (F.col("s_suppkey") % 9).cast("double").alias("processed"))
    surface = s.select((F.col("s_suppkey") % 4).cast("string").alias("surface"), F.col("s_suppkey").cast("string").alias("container"), F.lit("all").alias("line"), F.lit(6.0).alias("added"))
    plan = actions.multibeam(files, known, named).unionByName(actions.navigation(nav, nav.where("dataset % 3 = 0"))).unionByName(actions.svp(casts, own, d)).unionByName(actions.processing(d)).unionByName(actions.gridding(lines, surface))
    return plan, surface


def planned_actions(spark, sf_dir):
    """The actions that a project's tables call for: how many inputs each has, the first of them and its rank."""
    plan, surface = _plan(spark, sf_dir)
    plan = kept(plan)
    r = actions.ranked(plan, actions.needs(plan, surface))
    return r.select("id", "type", "priority", F.size("inputs").alias("inputs"), F.col("inputs")[0].alias("first"), "rank")


def queue_changes(spark, sf_dir):
    """What a new plan changes in a queue of actions of which some wait since before, some run and some are gone."""
    plan, _ = _plan(spark, sf_dir)
    plan = kept(plan)
    n = F.crc32(F.col("id").cast("binary")) % 4
    queue = plan.where(n > 0).select("id", F.when(n == 1, "other").otherwise(F.col("content")).alias("content"), (n == 3).alias("running"))
    gone = S.table(spark, sf_dir, "nation").select(F.concat(F.lit("gone:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("x").alias("content"), F.lit(False).alias("running"))
    return actions.changes(plan, queue.unionByName(gone)).groupBy("change").agg(F.count("*").alias("actions"))


def chosen_crs(spark, sf_dir):
    """The code of each line's positions by its zone."""
    p = S.positions(spark, sf_dir).groupBy(F.col("line").cast("string").alias("dataset")).agg(F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"))
    return actions.chosen_crs(p.withColumn("epsg", F.lit(None).cast("int"))).select("dataset", "epsg", "why")


# --- lines


def project_properties(spark, sf_dir):
    """How many different lines, beams and pings each dataset has, and its first and last line by name."""
    o = S.positions(spark, sf_dir).select("ping", F.concat(F.lit("line"), F.col("line").cast("string")).alias("line"))
    s = S.soundings(spark, sf_dir).join(o, "ping").groupBy((F.col("ping") % 6).alias("dataset"))
    return s.agg(F.countDistinct("line").alias("lines"), F.countDistinct("beam").alias("beams"), F.countDistinct("ping").alias("pings"), F.min("line").alias("first"), F.max("line").alias("last"))


def paired_lines(spark, sf_dir):
    """Lines run in opposite directions in pairs, the nearest first, and those that stay alone."""
    k = F.col("c_custkey")
    lines = S.table(spark, sf_dir, "customer").select(k.alias("line"), (k * 37 % 360).cast("double").alias("azimuth"), *[((k * a % 1009) / 100.0 - b).cast("double").alias(n) for n, a, b in (("start_lat", 7, 5), ("start_lon", 11, 3), ("end_lat", 13, 4), ("end_lon", 17, 6))])
    return params.paired_lines(lines, 20.0, 64.0).select("a", "b", F.bround("km", 6).alias("km"))


_KIND = "CASE WHEN param = 'waterline' THEN 'waterline' WHEN regexp_matches(param, '_(x|y|z)(_\\d)?$') THEN 'offset' WHEN regexp_matches(param, '_(r|p|h)(_\\d)?$') THEN 'angle' WHEN param = 'latency' THEN 'angle' ELSE 'tpu' END"
_OTHER = f"(SELECT system, ts + 50 AS ts, param, CASE WHEN param = 'tx_x' THEN value ELSE value + system % 2 END AS value FROM {PARAMS} WHERE ts >= 100)"
_DIFF = f"""(SELECT system, bool_or(kind = 'offset' AND differ) AS offsets, bool_or(kind = 'angle' AND differ) AS angles, bool_or(kind = 'tpu' AND differ) AS tpu, bool_or(list_transform(one, lambda v: v.value) <> list_transform(two, lambda v: v.value)) AS "values",
    max(CASE WHEN kind = 'waterline' AND one[1].value <> two[1].value THEN two[1].value END) AS waterline
    FROM (SELECT *, {_KIND} AS kind, len(list_filter(one, lambda v: NOT list_contains(two, v))) > 0 AS differ FROM
      (SELECT system, param, list({{'ts': ts, 'value': value}} ORDER BY ts, value) AS one FROM {PARAMS} GROUP BY 1, 2) JOIN (SELECT system, param, list({{'ts': ts, 'value': value}} ORDER BY ts, value) AS two FROM {_OTHER} GROUP BY 1, 2) USING (system, param)) GROUP BY 1)"""
_CHANGED = f"(SELECT system FROM {_DIFF} WHERE offsets OR angles OR tpu OR waterline IS NOT NULL)"
_OVER = f"(SELECT t.system, t.ts, k.param, k.value FROM (SELECT DISTINCT system, ts FROM {_OTHER}) t JOIN (SELECT p.system, p.param, p.value FROM {PARAMS} p JOIN (SELECT system, max(ts) AS ts FROM {PARAMS} GROUP BY 1) USING (system, ts) WHERE {_KIND} = 'tpu') k USING (system))"
_NEW = f"(SELECT * FROM {_OVER} UNION ALL SELECT system, ts, param, value FROM {_OTHER} o WHERE NOT EXISTS (SELECT 1 FROM {_OVER} v WHERE v.system = o.system AND v.ts = o.ts AND v.param = o.param))"
_MERGED = f"(SELECT * FROM {_NEW} WHERE system IN {_CHANGED} UNION ALL SELECT * FROM {PARAMS} p WHERE system IN {_CHANGED} AND NOT EXISTS (SELECT 1 FROM {_NEW} n WHERE n.system = p.system AND n.ts = p.ts AND n.param = p.param))"
_SETS = f"(SELECT system, ts, list({{'param': param, 'value': value}} ORDER BY param) AS v FROM {_MERGED} GROUP BY 1, 2)"
_SPANS = "(SELECT system, param, value, ts AS start, {end} AS \"end\" FROM (SELECT *, lead(ts) OVER (PARTITION BY system, param ORDER BY ts) AS next FROM (SELECT *, lag(value) OVER (PARTITION BY system, param ORDER BY ts) IS DISTINCT FROM value OR lag(ts) OVER (PARTITION BY system, param ORDER BY ts) IS NULL AS new FROM {rows}) WHERE new))"
_BASE, _TOP = _SPANS.format(end="coalesce(next, 1000.0)", rows=PARAMS), _SPANS.format(end="coalesce(next, 400.0)", rows=_OTHER)
_POINTS = f"(SELECT system, param, start AS t FROM {_BASE} UNION SELECT system, param, \"end\" FROM {_BASE} UNION SELECT system, param, start FROM {_TOP} WHERE start < 250 UNION SELECT system, param, least(\"end\", 250.0) FROM {_TOP} WHERE start < 250)"
_PIECES = f"""(SELECT *, lag(v) OVER (PARTITION BY system, param ORDER BY t) AS before, row_number() OVER (PARTITION BY system, param ORDER BY t) AS k FROM (SELECT p.system, p.param, p.t, coalesce(o.value, b.value) AS v FROM {_POINTS} p
    LEFT JOIN {_BASE} b ON b.system = p.system AND b.param = p.param AND b.start <= p.t AND p.t < b."end" LEFT JOIN (SELECT system, param, value, start, least("end", 250.0) AS "end" FROM {_TOP} WHERE start < 250) o ON o.system = p.system AND o.param = p.param AND o.start <= p.t AND p.t < o."end"))"""

_D = "(SELECT CAST(s_suppkey AS VARCHAR) AS dataset, s_suppkey AS k, s_suppkey % 60 AS serial, s_suppkey % 5 AS day, least(s_suppkey % 7, 5) AS status, s_nationkey % 4 = 0 AS wl FROM supplier)"
_C = "(SELECT 'f' || c_custkey AS name, c_custkey % 60 AS serial, c_custkey % 5 AS day FROM customer WHERE (c_custkey % 97) % 3 = 0)"
_MB = f"(SELECT coalesce(known, 'em_' || c.serial || '_' || strftime(DATE '1970-01-01' + CAST(c.day AS INTEGER), '%m_%d_%Y')) AS target, name FROM {_C} c LEFT JOIN (SELECT serial, day, min(dataset) AS known FROM {_D} GROUP BY 1, 2) d ON d.serial = c.serial AND d.day = c.day)"
_NAV = "(SELECT DISTINCT CAST(c_custkey % 40 AS VARCHAR) AS target, 'n' || c_custkey % 11 AS name FROM customer WHERE (c_custkey % 40) % 3 > 0)"
_SVP = f"(SELECT dataset AS target, 'c' || i AS name FROM {_D}, range(5) t(i) WHERE i > status)"
_FIRST = "CASE WHEN status < 2 THEN 0 WHEN status < 3 OR wl THEN 2 WHEN status < 4 THEN 3 WHEN status < 5 THEN 4 ELSE 5 END"
_PROC = f"(SELECT dataset AS target, ['orientation', 'beam_vectors', 'sound_velocity', 'georeference', 'uncertainty'][i + 1] AS name FROM (SELECT dataset, {_FIRST} AS f FROM {_D}), range(5) t(i) WHERE i >= f)"
_GRID = "(SELECT CAST(s_suppkey % 4 AS VARCHAR) AS target, s_suppkey || '/all/stale' AS name FROM supplier WHERE s_suppkey % 9 > 6)"
_ACTIONS = "(" + " UNION ALL ".join(f"SELECT '{t}' AS type, {p} AS priority, target, count(*) AS inputs, min(name) AS first FROM {q} GROUP BY target" for (t, p), q in zip(actions.PRIORITY.items(), (_MB, _NAV, _SVP, _PROC, _GRID), strict=True)) + ")"
_RANKS = f"""(SELECT a.*, CASE WHEN type IN ('navigation', 'svp') THEN CAST(m AS INTEGER) WHEN type = 'processing' THEN CASE WHEN ns THEN CASE WHEN m THEN 2 ELSE 1 END WHEN m THEN 1 ELSE 0 END ELSE 0 END AS rank
    FROM (SELECT a.*, EXISTS (SELECT 1 FROM {_MB} m WHERE m.target = a.target) AS m, EXISTS (SELECT 1 FROM {_NAV} m WHERE m.target = a.target) OR EXISTS (SELECT 1 FROM {_SVP} m WHERE m.target = a.target) AS ns FROM {_ACTIONS} a) a)"""

QUERIES = {f.__name__: f for f in (vessel_sets, vessel_differences, vessel_updated, vessel_intervals, vessel_overlaid, vessel_round_trip, planned_actions, queue_changes, chosen_crs, project_properties, paired_lines)}
ORACLES = {
    "vessel_sets": f"SELECT system, ts, CAST(row_number() OVER (PARTITION BY system ORDER BY ts) - 1 AS INTEGER) AS n, CAST(count(*) AS INTEGER) AS parameters, round_even(sum(value), 3) AS total FROM {PARAMS} GROUP BY system, ts",
    "vessel_differences": f"SELECT * FROM {_DIFF}",
    "vessel_updated": f"""SELECT * FROM {PARAMS} WHERE system NOT IN {_CHANGED} UNION ALL SELECT * FROM {_OTHER} WHERE system NOT IN (SELECT system FROM {PARAMS})
        UNION ALL SELECT m.* FROM {_MERGED} m JOIN (SELECT system, min(ts) AS ts FROM {_SETS} GROUP BY system, v) k ON k.system = m.system AND k.ts = m.ts""",
    "vessel_intervals": f"SELECT * FROM {_SPANS.format(end='next', rows=PARAMS)}",
    "vessel_overlaid": f"SELECT system, param, v AS value, t AS start, \"end\" FROM (SELECT *, lead(t) OVER (PARTITION BY system, param ORDER BY t) AS \"end\" FROM {_PIECES} WHERE k = 1 OR before IS DISTINCT FROM v) WHERE v IS NOT NULL",
    "vessel_round_trip": f"SELECT system, ts, param, value, 'em' || system AS sonar_type, CASE WHEN system % 3 > 0 THEN 'file' || system END AS source FROM {PARAMS}",
    "planned_actions": f"""SELECT type || ':' || target AS id, type, priority, CAST(inputs AS INTEGER) AS inputs, first, CAST(CASE WHEN type = 'gridding' THEN 1 + coalesce((SELECT max(r.rank) FROM {_RANKS} r, supplier s WHERE r.type <> 'gridding' AND r.target = CAST(s_suppkey AS VARCHAR) AND CAST(s_suppkey % 4 AS VARCHAR) = q.target), -1) ELSE rank END AS INTEGER) AS rank FROM {_RANKS} q""",
    "project_properties": f"SELECT l_orderkey % 6 AS dataset, count(DISTINCT line) AS lines, count(DISTINCT l_linenumber) AS beams, count(DISTINCT l_orderkey) AS pings, min('line' || line) AS first, max('line' || line) AS last FROM lineitem JOIN {S.POSITIONS_SQL} ON ping = l_orderkey GROUP BY 1",
    "chosen_crs": f"SELECT CAST(line AS VARCHAR) AS dataset, CAST(CASE WHEN min(lat) > 0 THEN 32600 ELSE 32700 END + least(ceil((max(lon) + 180.0) / 6.0), 60) AS BIGINT) AS epsg, 'zone' AS why FROM {S.POSITIONS_SQL} GROUP BY line",
}
