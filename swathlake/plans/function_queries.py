"""Queries on scalar functions: positions, angles, times and rotations over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import angles, geo, rotation, times
from . import stand_ins as S

RING = [(-60.0, -40.0), (50.0, -55.0), (90.0, 10.0), (20.0, 60.0), (-80.0, 35.0)]


def haversine(spark, sf_dir):
    """Distance of each ping from a fixed point, on the sphere."""
    return S.positions(spark, sf_dir).select("ping", F.bround(geo.haversine_km(F.col("lon"), F.col("lat"), F.lit(-70.5), F.lit(42.25)), 6).alias("km"))


def geodesic(spark, sf_dir):
    """Distance of each ping from a point near it, on the ellipsoid."""
    return S.positions(spark, sf_dir).select("ping", F.bround(geo.geodesic_m(F.col("lat"), F.col("lon"), F.col("lat") + 0.1, F.col("lon") + 0.05), 4).alias("m"))


def geohash(spark, sf_dir):
    """Seven-letter cells, and how many pings each holds."""
    return S.positions(spark, sf_dir).groupBy(geo.geohash(F.col("lat"), F.col("lon")).alias("cell")).agg(F.count("*").alias("pings"))


def geohash_bounds(spark, sf_dir):
    """Bounds of the cells of five letters."""
    b = S.positions(spark, sf_dir).select(geo.geohash(F.col("lat"), F.col("lon"), 5).alias("cell")).distinct()
    return b.select("cell", geo.geohash_bounds(F.col("cell")).alias("b")).select("cell", "b.*")


def in_polygon(spark, sf_dir):
    """Pings inside a ring, by position."""
    from ..operators import subset

    return subset.in_polygon(S.positions(spark, sf_dir), RING).select("ping", "lat", "lon")


def in_polygon_by_cells(spark, sf_dir):
    """The same, behind a cover of geohash cells: inner ones whole, others by point."""
    from ..operators import subset

    p = S.positions(spark, sf_dir).withColumn("cell", geo.geohash(F.col("lat"), F.col("lon"), 2))
    return subset.in_polygon(p, RING, hashes="cell", precision=2).select("ping", "lat", "lon")


def utm_zone(spark, sf_dir):
    """Zone of each line, by its largest longitude and smallest latitude."""
    p = S.positions(spark, sf_dir).groupBy("line").agg(F.max("lon").alias("lon"), F.min("lat").alias("lat"))
    return p.select("line", angles.utm_zone(F.col("lon"), F.col("lat")).alias("zone"))


def utm_position(spark, sf_dir):
    """Northing and easting of pings near a central meridian."""
    p = S.positions(spark, sf_dir).withColumn("u", geo.utm(F.col("lat"), -123.0 + F.pmod(F.col("lon"), F.lit(3.0)), 10))
    return p.select("ping", F.bround("u.x", 3).alias("x"), F.bround("u.y", 3).alias("y"))


def dms(spark, sf_dir):
    """Degrees to degrees, minutes and seconds and back."""
    p = S.positions(spark, sf_dir).withColumn("d", angles.degrees_to_dms(F.col("lat")))
    back = angles.dms_to_degrees(F.col("d.d"), F.col("d.m"), F.col("d.s"))
    return p.select("ping", F.col("d.d").alias("d"), F.col("d.m").alias("m"), F.bround("d.s", 5).alias("s"), (F.abs(back - F.col("lat")) < 1e-9).alias("same"))


def year_day(spark, sf_dir):
    """Seconds of a year, day of the year and clock, and back to the clock."""
    d = F.to_date("o_orderdate")
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", times.year_day_to_utc(F.year(d), F.dayofyear(d), F.pmod(F.col("o_orderkey"), F.lit(24)), F.pmod(F.col("o_custkey"), F.lit(60)), F.lit(21.25)).alias("utc"))
    c = times.clock(F.pmod("utc", F.lit(86400.0)))
    return o.select("o_orderkey", "utc", *[c[k].alias(k) for k in ("h", "m", "s", "ms")])


def leap_seconds(spark, sf_dir):
    """Seconds since 1980 with leap seconds, and back."""
    d = F.to_date("o_orderdate")
    t = times.year_day_to_1980(F.year(d), F.dayofyear(d), (F.col("o_orderkey") % 86400).cast("double"))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t")).select("o_orderkey", "t", times.from_1980(F.col("t")).alias("utc"))


def gps_week(spark, sf_dir):
    """Seconds of the week of each sample."""
    return S.series(spark, sf_dir).select("counter", F.bround(times.gps_week_seconds(F.col("time")), 3).alias("tow"))


def rotations(spark, sf_dir):
    """Attitude times mounting matrix on a vector."""
    e = S.series(spark, sf_dir)
    m = rotation.product(rotation.matrix(F.col("value") % 30 - 15, F.col("value") % 20 - 10, F.col("value")), rotation.mounting(0.25, -0.5, 1.5))
    return e.select("counter", *[F.bround(c, 9).alias(n) for n, c in zip("xyz", rotation.apply(m, [1.0, 2.0, 3.0]), strict=True)])


def cross_product(spark, sf_dir):
    """Cross product of the first and the second three components of each vector."""
    e = S.table(spark, sf_dir, "embeddings")
    a, b = ([F.col("embedding")[k].cast("double") for k in r] for r in (range(3), range(3, 6)))
    return e.select("vec_id", *[F.bround(c, 9).alias(n) for n, c in zip("xyz", rotation.cross(a, b), strict=True)], F.bround(rotation.dot(a, b), 9).alias("dot"))


def name_parts(spark, sf_dir):
    """Base name, extension and counterpart side of file names, here page addresses."""
    p = S.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    name = F.substring_index("path", "/", -1)
    return p.select("page_id", name.alias("name"), F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1).alias("extension"), F.regexp_replace("path", "/en/", "/fr/").alias("other"))


def json_attributes(spark, sf_dir):
    """A number from each sample's JSON attributes, counted."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return S.series(spark, sf_dir).select(k.alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def _geodesic_sql() -> str:
    f, a, b = repr(geo.FLAT), repr(geo.A), repr(geo.B)
    q = f"SELECT ping, radians(0.05) AS l, radians(0.05) AS lam, sin(atan(tan(radians(lat)) * (1 - {f}))) AS s1, cos(atan(tan(radians(lat)) * (1 - {f}))) AS c1, sin(atan(tan(radians(lat + 0.1)) * (1 - {f}))) AS s2, cos(atan(tan(radians(lat + 0.1)) * (1 - {f}))) AS c2 FROM {S.POSITIONS_SQL}"
    q = q.replace("radians(0.05) AS l, radians(0.05) AS lam", "radians((lon + 0.05) - lon) AS l, radians((lon + 0.05) - lon) AS lam")
    for _ in range(geo.ROUNDS):
        q = f"SELECT *, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS sn, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM ({q})"
        q = f"SELECT *, c1 * c2 * sin(lam) / sn AS sa, atan2(sn, cs) AS sg FROM ({q})"
        q = f"SELECT *, 1 - sa * sa AS ca, cs - 2 * s1 * s2 / (1 - sa * sa) AS m FROM ({q})"
        q = f"SELECT *, ca * ({f} / 16) * (4 + {f} * (4 - 3 * ca)) AS c FROM ({q})"
        q = f"SELECT ping, l, s1, c1, s2, c2, sn, cs, sg, ca, m, l + (1 - c) * {f} * sa * (sg + c * sn * (m + c * cs * (2 * m * m - 1))) AS lam FROM ({q})"
        last, q = q, f"SELECT ping, l, s1, c1, s2, c2, lam FROM ({q})"
    q = f"SELECT *, ca * (({a} * {a} - {b} * {b}) / ({b} * {b})) AS u2 FROM ({last})"
    q = f"SELECT *, 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))) AS ea, u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))) AS eb FROM ({q})"
    return f"SELECT ping, round_even({b} * ea * (sg - eb * sn * (m + eb / 4 * (cs * (2 * m * m - 1) - eb / 6 * m * (4 * sn * sn - 3) * (4 * m * m - 3)))), 4) AS m FROM ({q})"


def _geohash_sql(precision: int) -> str:
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    letters = []
    for k in range(precision):
        terms = []
        for j in range(5):
            i = 5 * k + j
            terms.append(f"((({'a' if i % 2 == 0 else 'b'} >> {(n_lon if i % 2 == 0 else n_lat) - 1 - i // 2}) & 1) * {1 << (4 - j)})")
        letters.append(f"substr('{geo.ALPHABET}', CAST(1 + {' + '.join(terms)} AS INTEGER), 1)")
    return f"SELECT ping, {' || '.join(letters)} AS cell FROM (SELECT ping, CAST(floor((lon + 180.0) / 360.0 * {float(1 << n_lon)}) AS BIGINT) AS a, CAST(floor((lat + 90.0) / 180.0 * {float(1 << n_lat)}) AS BIGINT) AS b FROM {S.POSITIONS_SQL})"


def _bounds_sql(precision: int) -> str:
    bits = 5 * precision
    w, h = 360.0 / (1 << (bits + 1) // 2), 180.0 / (1 << bits // 2)
    a, b = f"floor((lon + 180.0) / 360.0 * {float(1 << (bits + 1) // 2)})", f"floor((lat + 90.0) / 180.0 * {float(1 << bits // 2)})"
    return f"SELECT DISTINCT g.cell, {b} * {h!r} - 90.0 AS min_lat, ({b} + 1) * {h!r} - 90.0 AS max_lat, {a} * {w!r} - 180.0 AS min_lon, ({a} + 1) * {w!r} - 180.0 AS max_lon FROM {S.POSITIONS_SQL} p JOIN ({_geohash_sql(precision)}) g ON g.ping = p.ping"


def _polygon_sql() -> str:
    inside, edge = [], []
    for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]], strict=True):
        edge.append(f"(({x2 - x1} * (lat - ({y1})) - {y2 - y1} * (lon - ({x1})) = 0) AND lon BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND lat BETWEEN {min(y1, y2)} AND {max(y1, y2)})")
        inside.append(f"CAST(lat >= {min(y1, y2)} AND lat < {max(y1, y2)} AND lon < {x1} + (lat - ({y1})) * ({(x2 - x1) / (y2 - y1)!r}) AS INTEGER)")
    return f"SELECT ping, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM {S.POSITIONS_SQL} WHERE {' OR '.join(edge)} OR ({' + '.join(inside)}) % 2 = 1"


def _leap_sql() -> str:
    before = " + ".join(f"CAST(utc >= epoch(DATE '{d}') + 86400 AS INTEGER)" for d in times.LEAP_DAYS)
    return f"SELECT o_orderkey, utc - {times.EPOCH_1980} + ({before}) AS t, utc FROM (SELECT o_orderkey, CAST(epoch(CAST(o_orderdate AS DATE)) + o_orderkey % 86400 AS DOUBLE) AS utc FROM orders)"


def _matrix_sql(r: str, p: str, y: str) -> str:
    return f"SELECT counter, cos(radians({r})) AS cr, sin(radians({r})) AS sr, cos(radians({p})) AS cp, sin(radians({p})) AS sp, cos(radians({y})) AS cy, sin(radians({y})) AS sy FROM {S.SERIES_SQL}"


def _rotation_sql() -> str:
    v = rotation.apply(rotation.mounting(0.25, -0.5, 1.5), [1.0, 2.0, 3.0])
    rows = (("cy * cp", "cy * sp * sr - sy * cr", "cy * sp * cr + sy * sr"), ("sy * cp", "sy * sp * sr + cy * cr", "sy * sp * cr - cy * sr"), ("-sp", "cp * sr", "cp * cr"))
    parts = ", ".join(f"round_even({' + '.join(f'({m}) * ({x!r})' for m, x in zip(row, v, strict=True))}, 9) AS {n}" for n, row in zip("xyz", rows, strict=True))
    return f"SELECT counter, {parts} FROM ({_matrix_sql('value % 30 - 15', 'value % 20 - 10', 'value')})"


QUERIES = {f.__name__: f for f in (haversine, geodesic, geohash, geohash_bounds, in_polygon, in_polygon_by_cells, utm_zone, utm_position, dms, year_day, leap_seconds, gps_week, rotations, cross_product, name_parts, json_attributes)}
ORACLES = {
    "haversine": f"SELECT ping, round_even(2 * 6371.0 * asin(sqrt(pow(sin((radians(42.25) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(42.25)) * pow(sin((radians(-70.5) - radians(lon)) / 2), 2))), 6) AS km FROM {S.POSITIONS_SQL}",
    "geodesic": _geodesic_sql(),
    "geohash": f"SELECT cell, count(*) AS pings FROM ({_geohash_sql(7)}) GROUP BY 1",
    "geohash_bounds": _bounds_sql(5),
    "in_polygon": _polygon_sql(),
    "in_polygon_by_cells": _polygon_sql(),
    "utm_zone": f"SELECT line, CAST(CAST(ceil((max(lon) + 180.0) / 6.0) AS BIGINT) AS VARCHAR) || CASE WHEN min(lat) > 0 THEN 'N' ELSE 'S' END AS zone FROM {S.POSITIONS_SQL} GROUP BY line",
    "dms": f"SELECT ping, CAST(sign(lat) * floor(abs(lat)) AS INTEGER) AS d, CAST(floor((abs(lat) - floor(abs(lat))) * 60.0) AS INTEGER) AS m, round_even((abs(lat) - floor(abs(lat)) - floor((abs(lat) - floor(abs(lat))) * 60.0) / 60.0) * 3600.0, 5) AS s, abs(lat) >= 1 OR lat >= 0 AS same FROM (SELECT ping, CAST(lat AS DOUBLE) AS lat FROM {S.POSITIONS_SQL})",
    "year_day": "SELECT o_orderkey, epoch(CAST(o_orderdate AS DATE)) + (o_orderkey % 24) * 3600.0 + (o_custkey % 60) * 60.0 + 21.25 AS utc, CAST(o_orderkey % 24 AS INTEGER) AS h, CAST(o_custkey % 60 AS INTEGER) AS m, 21 AS s, 250 AS ms FROM orders",
    "leap_seconds": _leap_sql(),
    "gps_week": f"SELECT counter, round_even((time - {times.GPS_EPOCH}) % 604800.0, 3) AS tow FROM {S.SERIES_SQL}",
    "rotations": _rotation_sql(),
    "cross_product": "SELECT vec_id, round_even(b * f - c * e, 9) AS x, round_even(c * d - a * f, 9) AS y, round_even(a * e - b * d, 9) AS z, round_even(a * d + b * e + c * f, 9) AS dot FROM (SELECT vec_id, "
    + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {n}" for k, n in enumerate("abcdef"))
    + " FROM embeddings)",
    "name_parts": r"SELECT page_id, split_part(path, '/', -1) AS name, regexp_extract(split_part(path, '/', -1), '\.([A-Za-z0-9]+)$', 1) AS extension, replace(path, '/en/', '/fr/') AS other FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages)",
    "json_attributes": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
}
