"""Queries on the sounding pipeline's stages, on stand-in soundings, with the same formulas in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import kernels
from . import stand_ins as S

#: lineitem as beams: angles, times and offsets from its numbers.
SQL = """(SELECT l_orderkey AS ping, l_linenumber AS beam, l_suppkey AS k, CAST((l_partkey % 120) - 60 AS DOUBLE) AS bpa, 0.5 + l_discount AS tilt, l_quantity / 100.0 AS twtt, 1480.0 + l_tax * 100 AS ssv,
   l_quantity AS d, (l_extendedprice - 50000.0) / 1000.0 AS ac, (l_partkey % 50) / 10.0 AS al, (l_partkey * 7 % 360) * 1.0 AS heading, l_discount AS heave, (l_suppkey % 40) + 0.5 AS altitude, l_tax * 10 AS qf FROM lineitem)"""


def _beams(spark, sf_dir):
    t = S.table(spark, sf_dir, "lineitem")
    p = F.col("l_partkey")
    return t.select(
        F.col("l_orderkey").alias("ping"), F.col("l_linenumber").alias("beam"), F.col("l_suppkey").alias("k"), ((p % 120) - 60).cast("double").alias("beampointingangle"), (F.col("l_discount") + 0.5).alias("tiltangle"),
        (F.col("l_quantity") / 100.0).alias("traveltime"), (1480.0 + F.col("l_tax") * 100).alias("soundspeed"), F.col("l_quantity").alias("depthoffset"), ((F.col("l_extendedprice") - 50_000.0) / 1000.0).alias("acrosstrack"),
        ((p % 50) / 10.0).alias("alongtrack"), (p * 7 % 360).cast("double").alias("heading"), F.col("l_discount").alias("heave"), ((F.col("l_suppkey") % 40) + 0.5).alias("altitude"), (F.col("l_tax") * 10).alias("qualityfactor"),
    )


KEYS = ["ping", "beam", "k"]


def beam_vectors(spark, sf_dir):
    """Beam azimuth and pointing angle from array axes that lean by a degree or so."""
    a = 0.01
    s = _beams(spark, sf_dir).withColumns({"tx": F.struct(F.lit(math.cos(a)).alias("x"), F.lit(math.sin(a)).alias("y"), F.lit(0.0).alias("z")), "rx": F.struct(F.lit(0.0).alias("x"), F.lit(-math.cos(a)).alias("y"), F.lit(math.sin(a)).alias("z"))})
    return kernels.beam_vectors(s).select(*KEYS, F.bround("rel_azimuth", 6).alias("rel_azimuth"), F.bround("corr_pointing_angle", 6).alias("corr_pointing_angle"))


LAYERS = [(5.0, 1490.0), (12.0, 1500.0), (20.0, 1494.0), (60.0, 1505.0)]


def ray_trace(spark, sf_dir):
    """Depth and distance of each beam through a cast of four layers and its tail."""
    layers = F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(c).alias("sv")) for d, c in LAYERS])
    casts = spark.range(1).select(F.col("id").alias("cast_id"), layers.alias("layers"))
    s = _beams(spark, sf_dir).withColumns({"cast_id": F.lit(0).cast("long"), "corr_pointing_angle": F.radians("beampointingangle"), "rel_azimuth": F.radians("heading")})
    r = kernels.ray_trace(s.drop("acrosstrack", "alongtrack", "depthoffset"), casts, 0.4, (0.1, 0.2, 0.3))
    return r.select(*KEYS, *[F.bround(F.col(c).cast("double"), 2).alias(c) for c in ("alongtrack", "acrosstrack", "depthoffset")], "in_cast")


def depths_by_reference(spark, sf_dir):
    """Depths against the waterline, the vessel and the ellipsoid."""
    args = (F.col("depthoffset") + 0.5, F.col("altitude"), F.col("heave"), F.lit(0.6), F.lit(0.0))
    return _beams(spark, sf_dir).select(*KEYS, *[F.bround(kernels.vertical(r, *args), 3).alias(r) for r in ("waterline", "vessel", "ellipse")])


def uncertainty(spark, sf_dir):
    """Total vertical and horizontal uncertainty against the waterline."""
    return _tpu(spark, sf_dir, "waterline", True)


def uncertainty_ellipse(spark, sf_dir):
    """The same against the ellipsoid, with the other quality factor."""
    return _tpu(spark, sf_dir, "ellipse", False)


def _tpu(spark, sf_dir, reference, ifremer):
    s = _beams(spark, sf_dir).withColumn("corr_pointing_angle", F.radians(F.col("beampointingangle") + 0.5))
    u = kernels.uncertainty(s, reference, {"tx_to_antenna_x": 1.5, "tx_to_antenna_z": 3.0}, ifremer)
    return u.select(*KEYS, F.bround(F.col("tvu").cast("double"), 4).alias("tvu"), F.bround(F.col("thu").cast("double"), 4).alias("thu"))


def backscatter(spark, sf_dir):
    """Backscatter with every correction."""
    s = _beams(spark, sf_dir).withColumns({"reflectivity": -F.col("qualityfactor") - 20, "fixedgain": F.lit(1.5), "tvg": F.lit(90.0), "absorption": F.lit(60.0), "pulselength": F.lit(0.0002)})
    return kernels.backscatter(s, 1.3, 1.0).select(*KEYS, F.bround(F.col("backscatter").cast("double"), 3).alias("backscatter"))


def _vectors_sql() -> str:
    a = 0.01
    t, r = [math.cos(a), math.sin(a), 0.0], [0.0, -math.cos(a), math.sin(a)]
    off = math.acos(sum(x * y for x, y in zip(t, r, strict=True))) - math.pi / 2
    z = [t[1] * r[2] - t[2] * r[1], t[2] * r[0] - t[0] * r[2], t[0] * r[1] - t[1] * r[0]]
    n = math.sqrt(sum(x * x for x in z))
    z = [x / n for x in z]
    y = [z[1] * t[2] - z[2] * t[1], z[2] * t[0] - z[0] * t[2], z[0] * t[1] - z[1] * t[0]]
    g = ", ".join(f"({t[i]!r}) * v0 + ({y[i]!r}) * v1 + ({z[i]!r}) * v2 AS g{i}" for i in range(3))
    return f"""SELECT ping, beam, k, round_even(radians(((degrees(atan2(g1, g0)) - heading + 360) % 360 + 360) % 360), 6) AS rel_azimuth, round_even(CASE WHEN bpa < 0 THEN -p ELSE p END, 6) AS corr_pointing_angle FROM
        (SELECT *, {math.pi / 2!r} - atan(g2 / sqrt(g0 * g0 + g1 * g1)) AS p FROM (SELECT *, {g} FROM (SELECT *, sqrt(greatest(1 - (v0 * v0 + v1 * v1), 0)) AS v2 FROM
        (SELECT *, sin(radians(tilt)) AS v0, -sin(radians(bpa)) / {math.cos(off)!r} + sin(radians(tilt)) * ({math.tan(off)!r}) AS v1 FROM {SQL}))))"""


def _ray_sql() -> str:
    layers = [(d - 0.4, c) for d, c in [*LAYERS, (kernels.TAIL_DEPTH, kernels.TAIL_SPEED)]]
    q = f"SELECT *, 0.0 AS z, 0.0 AS h, 0.0 AS t, ssv AS c, sin(abs(radians(bpa))) AS s, 0.0 AS down, 0.0 AS across, false AS done, twtt / 2 AS w FROM {SQL}"
    keep = "ping, beam, k, heading, w"
    for depth, speed in layers:
        q = f"SELECT *, ({depth!r} - z) AS dz, sqrt(greatest(1 - s * s, 1e-12)) AS co FROM ({q})"
        q = f"SELECT *, dz * s / co AS dh, dz / co / c AS dt FROM ({q})"
        q = f"SELECT *, NOT done AND dt > 0 AND w >= t AND w <= t + dt AND w > 0 AS here, (w - t) / dt AS f FROM ({q})"
        q = f"SELECT {keep}, {depth!r} AS z, h + dh AS h, t + dt AS t, {speed!r} AS c, least(greatest({speed!r} / c * s, -1), 1) AS s, CASE WHEN here THEN z + f * dz ELSE down END AS down, CASE WHEN here THEN h + f * dh ELSE across END AS across, done OR here AS done FROM ({q})"
    at = lambda x: f"round_even(CAST(CAST(round_even({x}, 3) AS FLOAT) AS DOUBLE), 2)"
    return f"SELECT ping, beam, k, {at('abs(across) * cos(radians(heading)) + 0.1')} AS alongtrack, {at('abs(across) * sin(radians(heading)) + 0.2')} AS acrosstrack, {at('down + 0.3')} AS depthoffset, done AS in_cast FROM ({q})"


def _tpu_sql(reference: str, ifremer: bool) -> str:
    s = kernels.TPU | {"tx_to_antenna_x": 1.5, "tx_to_antenna_z": 3.0}
    q = f"qf / {100.0 if ifremer else 2500.0}"
    roll = math.radians(s["roll_sensor_error"]) ** 2 * math.radians(s["roll_patch_error"]) ** 2
    m = f"pow(d * {q}, 2) + ac * ac * {roll!r} + (pow(d / ssv, 2) + ac * ac * (pow(tan(th) / (2 * ssv), 2) + pow(tan(th - radians(bpa)) / ssv, 2))) * {s['surface_sv_error'] ** 2} + d - d * {math.cos(math.radians(s['beam_opening_angle']) / 2)!r}"
    tvu = f"sqrt(sqrt({m} + {s['heave_error'] ** 2}) + {s['waterline_error'] ** 2})" if reference == "waterline" else f"sqrt({m} + {s['vertical_positioning_error'] ** 2})"
    lever = s["tx_to_antenna_x"] ** 2 * s["heading_sensor_error"] + (s["roll_sensor_error"] ** 2 + s["pitch_sensor_error"] ** 2) * s["tx_to_antenna_z"]
    thu = f"sqrt(pow(abs(ac) * {q}, 2) + {2 * s['horizontal_positioning_error'] ** 2} + {lever!r})"
    f = lambda x: f"round_even(CAST(CAST(1.96 * {x} AS FLOAT) AS DOUBLE), 4)"
    return f"SELECT ping, beam, k, {f(tvu)} AS tvu, {f(thu)} AS thu FROM (SELECT *, radians(bpa + 0.5) AS th FROM {SQL})"


def _backscatter_sql() -> str:
    tx, rx = math.radians(1.3), math.radians(1.0)
    sin = "CASE WHEN abs(sin(radians(bpa))) > 1e-9 THEN abs(sin(radians(bpa))) ELSE 1e-9 END"
    area = f"10 * log10(least({tx * rx!r} * r * r, ssv * 0.0002 / 2 * {tx!r} * r / ({sin})))"
    return f"SELECT ping, beam, k, round_even(CAST(CAST(-qf - 20 - 1.5 - 90.0 + 2 * (20 * log10(r) + 0.06 * r) - {area} AS FLOAT) AS DOUBLE), 3) AS backscatter FROM (SELECT *, sqrt(ac * ac + al * al + d * d) AS r FROM {SQL})"


QUERIES = {f.__name__: f for f in (beam_vectors, ray_trace, depths_by_reference, uncertainty, uncertainty_ellipse, backscatter)}
ORACLES = {
    "beam_vectors": _vectors_sql(),
    "ray_trace": _ray_sql(),
    "depths_by_reference": f"SELECT ping, beam, k, round_even(d + 0.5 + heave - 0.6, 3) AS waterline, round_even(d + 0.5 + heave, 3) AS vessel, round_even(altitude - (d + 0.5), 3) AS ellipse FROM {SQL}",
    "uncertainty": _tpu_sql("waterline", True),
    "uncertainty_ellipse": _tpu_sql("ellipse", False),
    "backscatter": _backscatter_sql(),
}
