import math

import pytest
from pyspark.sql import functions as F

from swathlake.functions import angles, geo, rotation, times
from swathlake.operators import stats

# Sample positions, cells, rings and distances in this file are fixed values: published results that must be matched.


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def L(x):
    return F.lit(float(x))


def test_positions(spark):
    r = one(spark, geo.geohash(L(43.123456789), L(-73.123456789)), geo.geohash(F.lit(None).cast("double"), L(1)), geo.geohash_bounds(F.lit("drsj243")), geo.geohash_bounds(F.lit("drqp4yv")))
    assert r[0] == "drsj243" and r[1] is None
    assert (r[2]["min_lat"] + r[2]["max_lat"]) / 2 == pytest.approx(43.12339782714844, abs=1e-8)
    assert (r[2]["min_lon"] + r[2]["max_lon"]) / 2 == pytest.approx(-73.12294006347656, abs=1e-8)
    assert (r[3]["min_lon"], r[3]["min_lat"], r[3]["max_lon"], r[3]["max_lat"]) == (-70.18478393554688, 42.048797607421875, -70.18341064453125, 42.0501708984375)
    d = one(spark, *[geo.geodesic_m(*map(L, p)) for p in ((43, -73, 43.1, -73), (-40, -23, -40.1, -23.1), (43, 28, 43, 27), (44, 28, 43, 28), (1, 2, 1, 2))])
    assert [round(x, 1) for x in d] == [11109.4, 14003.7, 81540.5, 111102.5, 0.0]


def test_cover():
    ring = [(-70.1810536, 42.0519741), (-70.178872, 42.0501041), (-70.1813097, 42.0471989), (-70.1835136, 42.0490578)]
    inner, meets = geo.polygon_cover(ring)
    assert inner == ["drqp4yz"] and len(meets) == 15 and "drqp4yz" in meets


def test_forward_and_inverse_agree(spark):
    for lat, lon, az, d in ((45.0, -122.5, 30.0, 150.0), (-33.0, 151.0, 200.0, 2000.0), (0.0, 10.0, 90.0, 50_000.0)):
        p = one(spark, geo.geodesic_forward(L(lat), L(lon), L(az), L(d)))[0]
        assert one(spark, geo.geodesic_m(L(lat), L(lon), L(p["lat"]), L(p["lon"])))[0] == pytest.approx(d, abs=1e-3)


def test_utm(spark):
    p = one(spark, geo.utm(L(47.78890945494799), L(-122.47711319986821), 10), geo.utm(L(0.0), L(-123.0), 10), geo.utm(L(-33.0), L(151.0), 56, True))
    assert (p[0]["x"], p[0]["y"]) == (pytest.approx(539162, abs=40), pytest.approx(5292803, abs=400))
    assert (p[1]["x"], p[1]["y"]) == (pytest.approx(500_000, abs=1e-6), pytest.approx(0, abs=1e-6))
    assert p[2]["y"] > 6_000_000
    # distances on the grid are those on the ellipsoid times the scale
    a, b = one(spark, geo.utm(L(45.0), L(-123.0), 10), geo.utm(L(45.001), L(-123.0), 10))
    m = one(spark, geo.geodesic_m(L(45.0), L(-123.0), L(45.001), L(-123.0)))[0]
    assert math.hypot(a["x"] - b["x"], a["y"] - b["y"]) == pytest.approx(0.9996 * m, abs=1e-3)


def test_times(spark):
    i = F.lit
    r = one(spark, times.year_day_to_utc(i(2021), i(100), i(14), i(44), i(21)), times.calendar_to_utc(i(2021), i(4), i(10), i(14), i(44), i(21)), times.clock(L(3723.25)), times.year_day_to_1980(i(1980), i(1), L(0)), times.year_day_to_1980(i(2017), i(1), L(0)), times.gps_week_seconds(L(315964800 + 604800 + 5)))
    assert r[0] == r[1] == 1618065861.0
    assert tuple(r[2]) == (1, 2, 3, 250) and r[3] == 0.0 and r[5] == 5.0
    assert r[4] == 1483228800 - times.EPOCH_1980 + 18
    for t in (0.0, 1e8, 1e9, r[4]):
        back = one(spark, times.from_1980(L(t)))[0]
        d = one(spark, L(back) - times.EPOCH_1980 + times.leap_seconds(L(back)))[0]
        assert d == t


def test_angles(spark):
    r = one(spark, angles.parse_dms(F.lit("37:58:01.2 N")), angles.parse_dms(F.lit("-70/30/00")), angles.parse_dms(F.lit("junk")), angles.dms_to_degrees(F.lit(-70), F.lit(30), L(0)), angles.utm_zone(L(-122.4), L(47.0)))
    assert r[0] == pytest.approx(37.967) and r[1] == -70.5 and r[2] is None and r[3] == -70.5 and r[4] == "10N"
    assert angles.epsg("NAD83", 10, "N") == 6339 and angles.epsg("WGS84", 19, "S") == 32719
    with pytest.raises(ValueError):
        angles.epsg("other", 1, "N")


def test_rotation_is_orthonormal(spark):
    m = one(spark, *rotation.matrix(L(10), L(-5), L(200)))
    for i in range(3):
        for j in range(3):
            assert sum(m[3 * i + k] * m[3 * j + k] for k in range(3)) == pytest.approx(float(i == j))
    assert rotation.mounting(10, -5, 200) == pytest.approx(list(m))


def test_bins(spark):
    v = spark.range(10).select(stats.digitize(F.col("id").cast("double"), [0.0, 3.0, 6.0, 10.0]).alias("b")).collect()
    assert [r[0] for r in v] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 3]
    h = stats.histogram_2d(spark.range(10).select(F.col("id").alias("x"), F.col("id").alias("y")), "x", "y", (2, 2), ((0, 10), (0, 10)))
    assert {(r["i"], r["j"]): r["n"] for r in h.collect()} == {(0, 0): 5, (1, 1): 5}
