import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathlake.operators import diagnostics, filters, kernels, params, series, subset, timejoin, upsert
from swathlake.plans import control
from swathlake.sources import casts, exports, points


def test_upsert_cases(spark, tmp_path):
    """New rows before, inside, after, between and over existing ones win by time; runs may come backwards."""
    path = f"{tmp_path}/t"
    want = {}
    for k, (a, b, step) in enumerate(((20, 30, 1), (10, 15, 1), (24, 27, 1), (28, 40, 2), (0, 5, 1), (12, 25, 3))):
        rows = [(float(t), t // 10, beam, float(100 * k + t)) for t in range(a, b, step) for beam in range(2 + k % 2)]
        want |= {(r[0], r[2]): r[3] for r in rows}
        upsert.upsert(spark, path, spark.createDataFrame(rows, "time double, day int, beam int, value double"), ["time", "beam"], "day")
        got = {(r["time"], r["beam"]): r["value"] for r in spark.read.parquet(path).collect()}
        assert got == want


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_interpolation_over_buckets(spark):
    a = frame(spark, [(1, float(t), float(10 * t)) for t in range(0, 400_000, 50_000)], "system long, time double, value double")
    q = frame(spark, [(1, t) for t in (-5.0, 0.0, 25_000.0, 99_999.0, 345_000.0, 999_999.0)] + [(2, 1.0)], "system long, time double")
    got = {(r["system"], r["time"]): r["value_at"] for r in timejoin.interpolate(q, a, ["value"]).collect()}
    assert got == {(1, -5.0): -50.0, (1, 0.0): 0.0, (1, 25_000.0): 250_000.0, (1, 99_999.0): 999_990.0, (1, 345_000.0): 3_450_000.0, (1, 999_999.0): 9_999_990.0, (2, 1.0): None}
    near = {r["time"]: r["value_near"] for r in timejoin.nearest(q, a, ["value"], within=30_000.0).collect() if r["system"] == 1}
    assert near[25_000.0] == 0.0 and near[999_999.0] is None and near[-5.0] == 0.0


def test_headings_turn_the_short_way(spark):
    a = frame(spark, [(1, 0.0, 350.0), (1, 10.0, 10.0)], "system long, time double, heading double")
    q = frame(spark, [(1, 5.0), (1, 2.5)], "system long, time double")
    assert sorted(r["heading_at"] for r in timejoin.interpolate(q, a, ["heading"], headings=("heading",)).collect()) == [0.0, 355.0]


def test_beamwise_values(spark):
    a = frame(spark, [(1, 2.5, 400.0), (1, 3.8, 500.0)], "system long, time double, v double")
    q = frame(spark, [(1, 3.0)], "system long, time double")
    assert timejoin.interpolate(q, a, ["v"]).first()["v_at"] == pytest.approx(400 + 100 * 0.5 / 1.3)


def test_gaps(spark):
    old = frame(spark, [(1, float(t)) for t in range(10)], "system long, time double")
    new = frame(spark, [(1, float(t)) for t in (*range(5), *range(6, 10))], "system long, time double")
    assert [(r["start"], r["end"]) for r in series.new_gaps(old, new, 1.0).collect()] == [(4.0, 6.0)]
    assert series.new_gaps(old, new, 2.0).count() == 0


def test_time_slices(spark):
    s = frame(spark, [(float(t),) for t in range(100)], "time double")
    assert [r[0] for r in subset.by_time(s, 28.7, 29.4).collect()] == [29.0]
    assert sorted(r[0] for r in subset.by_time(s, 98.2, 104.0).collect()) == [98.0, 99.0]
    assert subset.by_time(s, 200.0, 300.0).count() == 0


def test_filters(spark, tmp_path):
    assert filters.REGISTRY.names() == ["filter_by_angle", "filter_by_depth", "reaccept_rejected", "reject_all", "second_return"]
    s = frame(spark, [(0, 1.0), (2, 2.0), (1, 30.0)], "detectioninfo int, z double")
    run = lambda *a, **k: [r[0] for r in filters.REGISTRY.run(s, *a, **k).collect()]
    assert run("filter_by_depth", min_depth=0.0, max_depth=10.0) == [0, 2, 2]
    assert run("reject_all", where=F.col("z") > 1.5) == [0, 2, 2] and run("reaccept_rejected") == [0, 3, 1]
    with pytest.raises(ValueError):
        run("reject_all", depth=1)
    (tmp_path / "mine.py").write_text("from swathlake.operators.filters import Filter\nfrom pyspark.sql import functions as F\ndef register(r):\n    r.add(Filter('mine', 'all to phase', lambda flag: F.lit(1)))\n")
    r = filters.Registry()
    r.load(str(tmp_path))
    assert r.names() == ["mine"] and [x[0] for x in r.run(s, "mine").collect()] == [1, 1, 1]


def test_next_stages():
    n = control.next_stages
    assert n(5) == () and n(4) == ("uncertainty",) and n(3) == ("georeference", "uncertainty") and n(5, tpu=True) == ("uncertainty",)
    assert n(5, crs=True) == ("georeference", "uncertainty") and n(5, waterline=True)[0] == "sound_velocity" and n(5, angles=True) == control.STAGES
    assert n(1) == control.STAGES and n(5, mode="reprocess") == control.STAGES and n(0, mode="convert_only") == ()


def test_orientation_of_a_level_ship(spark):
    att = frame(spark, [(1, float(t), 0.0, 0.0, 90.0) for t in range(0, 20, 5)], "system long, time double, roll double, pitch double, heading double")
    s = frame(spark, [(1, 3.0, 0, 0.2, 0.0, 30.0, 0.0, 90.0), (1, 3.0, 1, 0.2, 0.0, -30.0, 0.0, 90.0)], "system long, time double, beam int, traveltime double, delay double, beampointingangle double, tiltangle double, heading double")
    o = kernels.orientation(s, att, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0))
    r = o.first()
    assert (r["tx"]["x"], r["tx"]["y"], r["tx"]["z"]) == pytest.approx((0, 1, 0), abs=1e-6) and r["processing_status"] == 1
    b = {x["beam"]: x for x in kernels.beam_vectors(o).collect()}
    assert math.degrees(b[0]["corr_pointing_angle"]) == pytest.approx(30, abs=1e-3) and math.degrees(b[1]["corr_pointing_angle"]) == pytest.approx(-30, abs=1e-3)
    assert {round(math.degrees(x["rel_azimuth"])) % 360 for x in b.values()} == {90, 270}


def test_straight_ray(spark):
    c = frame(spark, [(0, [(0.5, 1500.0), (100.0, 1500.0)])], "cast_id long, layers array<struct<depth:double,sv:double>>")
    s = frame(spark, [(0, math.radians(60), math.radians(90), 0.08, 1500.0), (0, math.radians(10), 0.0, 0.0, 1500.0)], "cast_id long, corr_pointing_angle double, rel_azimuth double, traveltime double, soundspeed double")
    r = {x["traveltime"]: x for x in kernels.ray_trace(s, c).collect()}
    assert r[0.08]["depthoffset"] == pytest.approx(30.0, abs=2e-3) and r[0.08]["acrosstrack"] == pytest.approx(60 * math.sin(math.radians(60)), abs=2e-3)
    assert r[0.0]["depthoffset"] == 0.0 and not r[0.0]["in_cast"]


def test_georeference(spark):
    s = frame(spark, [(0.0, 10.0, 20.0, 0.0, 0.1, 1.0, 45.0, -123.0), (None, 1.0, 2.0, 0.0, 0.0, 1.0, 45.0, -123.0)], "alongtrack double, acrosstrack double, depthoffset double, heading double, heave double, altitude double, latitude double, longitude double")
    a, b = kernels.georeference(s, 10, waterline=-0.5).collect()
    assert a["x"] == pytest.approx(500_000 + 0.9996 * 10, abs=2e-3) and a["z"] == pytest.approx(20.6, abs=1e-3) and len(a["geohash"].strip()) == 7
    assert b["x"] is None and b["z"] is None and b["geohash"] == " " * 7


def test_svp_file(spark, tmp_path):
    (tmp_path / "a.svp").write_text("[SVP_VERSION_2]\na.svp\nSection 2020-036 18:26:35 37:58:01 -76:05:07\n1.2 1480.5\n0.5 1480.0\n5 1490\nSection 2020-037 00:00:01 37:00:00 -76:00:00\n0 1500\n2 1501\n")
    a, b = casts.read_svp(spark, str(tmp_path)).orderBy("cast_time").collect()
    assert [tuple(x) for x in a["layers"]] == [(0.0, 1480.0), (0.5, 1480.0), (1.2, 1480.5), (5.0, 1490.0)] and a["cast_time"] == 1580927195.0
    assert a["lat"] == pytest.approx(37.9669, abs=1e-3) and a["lon"] == pytest.approx(-76.0853, abs=1e-3) and len(b["layers"]) == 2
    many = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda k: F.struct(k.cast("double").alias("depth"), (k * 2.0).alias("sv")))
    p = spark.range(1).select(casts.simplified(many).alias("p")).first()["p"]
    assert len(p) == 80 and all(x["sv"] == pytest.approx(2 * x["depth"]) for x in p)


def test_point_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x;y;z\n1.5;2;3\n4;5;6\n")
    assert sorted(map(tuple, points.read_points(spark, str(tmp_path)).collect())) == [(1.5, 2.0, 3.0), (4.0, 5.0, 6.0)]
    assert points.sniff("1 2 3\n4 5 6\n") == (" ", False)
    df = spark.range(1).select(F.col("id").alias("time"))
    assert points.validate(df, {"time": "double", "beam": "int"}) == ["beam is missing", "time is bigint, not double"]


def test_las(spark):
    s = frame(spark, [(1.0, 2.0, 3.0, 0), (4.0, 5.0, 6.5, 2), (7.0, None, 1.0, 0)], "x double, y double, z double, detectioninfo int").coalesce(1)
    c = exports.las_files(s).first()["content"]
    assert c[:4] == b"LASF" and struct.unpack_from("<Q", c, 247)[0] == 2 and len(c) == 375 + 2 * 30
    assert struct.unpack_from("<3i", c, 375 + 30) == (3000, 3000, 0)
    s = exports.write_text
    assert s


def test_sine_and_period(spark):
    rows = [(1, t / 10, 2.5 * math.sin(2 * math.pi * 0.25 * t / 10 + 0.4) + 1) for t in range(400)]
    df = frame(spark, rows, "system long, time double, v double")
    r = diagnostics.fit_sine(df, "v").first()
    assert (abs(r["amplitude"]), r["frequency"], r["offset"]) == pytest.approx((2.5, 0.25, 1.0), abs=1e-3)
    assert series.period(df, "v").first()["period"] == pytest.approx(4.0, abs=0.11)


def test_sine_of_a_long_series(spark):
    """All samples count, noisy ones of a short period too, and systems of few samples or none are told apart."""
    from pyspark.sql import functions as F

    t = F.col("id") / 10.0
    df = spark.range(60_000).select(F.lit(1).cast("long").alias("system"), t.alias("time"), (3.0 * F.sin(2 * math.pi * 1.7003 * t + 0.3) + 5.0 + 2.0 * F.sin(F.col("id") * F.col("id") * 0.7)).alias("v"))
    few = frame(spark, [(2, 0.0, 4.0), (2, 1.0, 6.0), (3, 0.0, None)], "system long, time double, v double")
    r = {x["system"]: x for x in diagnostics.fit_sine(df.unionByName(few), "v").collect()}
    assert set(r) == {1, 2} and r[2]["frequency"] is None and r[2]["offset"] == 5.0
    assert (r[1]["amplitude"], r[1]["offset"]) == pytest.approx((3.0, 5.0), abs=0.05) and r[1]["frequency"] == pytest.approx(1.7003, abs=1e-6)
    assert math.cos(r[1]["phase"] - 0.3) > 0.999
    assert diagnostics.fit_sine(few.where("v < 0"), "v").count() == 0


def test_high_pass(spark):
    c = np.array(series.high_pass(20.0, 1.0, 101))
    gain = lambda f: abs((c * np.exp(-2j * np.pi * f * np.arange(101))).sum())
    assert gain(0.0) < 1e-6 and gain(0.01) < 0.05 and gain(0.3) == pytest.approx(1, abs=0.01)


def test_patch_adjustment(spark):
    g = np.random.default_rng(0)
    v = g.normal(size=(500, 5))
    true = np.array([0.02, -0.01, 0.03, 0.5, -0.4, 0.001])
    df = frame(spark, [tuple(map(float, r)) for r in v], "depth double, along double, across double, x_slope double, y_slope double")
    df = df.withColumn("diff", sum(c * float(x) for c, x in zip(diagnostics.patch_design(), true)))
    x, var = diagnostics.patch_adjustment(df, prior=(1e-9,) * 6)
    assert x == pytest.approx(true, abs=1e-6) and (var < 1e-9).all()


def test_streaming_into_a_table(spark, tmp_path):
    from swathlake.streaming import folder

    src, table = tmp_path / "in", tmp_path / "table"
    schema = "time double, day int, value double"
    for k, rows in enumerate(([(1.0, 0, 1.0), (2.0, 0, 2.0)], [(2.0, 0, 5.0), (11.0, 1, 3.0)])):
        frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        folder.into_table(spark, str(src), schema, str(table), ["time"], "day", str(tmp_path / "check")).awaitTermination()
        assert k or spark.read.parquet(str(table)).count() == 2
    assert {r["time"]: r["value"] for r in spark.read.parquet(str(table)).collect()} == {1.0: 1.0, 2.0: 5.0, 11.0: 3.0}
    assert folder.vanished(frame(spark, [("a",), ("b",)], "path string"), frame(spark, [("a",)], "path string")).first()[0] == "b"


def test_carried_and_names(spark):
    assert params.similar_name(["line_001.sbet", "other.txt"], "line_001.out") == "line_001.sbet"
    assert params.similar_name(["zzz"], "line") is None


def split_series(spark, n=400):
    """One system over four days with uneven steps, in few and in many days' pieces the same rows."""
    import random

    r = random.Random(8)
    t, rows = 0.0, []
    for k in range(n):
        t += r.choice([1.0, 7.0, 900.0, 2000.0])
        rows.append(("s", t, r.randrange(50), float(r.choice([0, 0, 3, 5, 350, 10])), k))
    return spark.createDataFrame(rows, "system string, time double, counter int, value double, k int"), rows


def test_windows_over_day_borders(spark, monkeypatch):
    from swathlake.operators import series as R

    df, rows = split_series(spark)
    by = lambda d, c: [r[c] for r in d.orderBy("k").collect()]
    times, counters, values = [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]
    for bucket, block in ((86_400.0, 16_384), (3_000.0, 37)):
        monkeypatch.setattr(R, "BUCKET", bucket)
        monkeypatch.setattr(R, "BLOCK", block)
        falls, total = 0, []
        for a, b in zip([counters[0], *counters], counters):
            falls += b < a
            total.append(b + 50 * falls)
        assert by(R.unreset(df, size=50), "counter") == total
        seg, want = 0, []
        for a, b in zip([times[0], *times], times):
            seg += b - a > 800
            want.append(seg)
        assert by(R.sessions(df, 800.0), "segment") == want
        last, want = next(v for v in values if v), []
        for v in values:
            last = v or last
            want.append(last)
        assert by(R.fill(df, "value"), "value") == want
        assert by(R.numbered(df, name="n"), "n") == list(range(len(rows)))
        assert by(R.chunks(df, 30), "chunk") == [k // 30 for k in range(len(rows))]
        assert by(R.every_nth(df, 9), "k") == list(range(0, len(rows), 9))
        taps = [0.5, -0.25, 0.125]
        want = [sum(c * (values[k - j] if k >= j else 0.0) for j, c in enumerate(taps)) for k in range(len(rows))]
        assert by(R.filtered(df, "value", taps), "filtered") == pytest.approx(want)
        import numpy as np

        w, x = np.hamming(9), np.array(values)
        y = np.convolve(w / w.sum(), np.r_[x[8:0:-1], x, x[-2:-10:-1]], mode="valid")[3:-5]
        assert by(R.smooth(df, "value", 9, "hamming"), "smooth") == pytest.approx(list(y))


def test_interpolation_goes_on_beyond_the_ends(spark):
    from swathlake.operators import timejoin as J

    r = spark.createDataFrame([("s", 100.0, 1.0), ("s", 200.0, 3.0), ("s", 100_000.0, 5.0), ("s", 100_100.0, 4.0), ("one", 5.0, 7.0)], "system string, time double, v double")
    l = spark.createDataFrame([("s", 0.0), ("s", 150.0), ("s", 100_300.0), ("one", 9.0), ("none", 1.0)], "system string, time double")  # noqa: E741
    got = {(x["system"], x["time"]): x["v_at"] for x in J.interpolate(l, r, ["v"]).collect()}
    assert got == {("s", 0.0): -1.0, ("s", 150.0): 2.0, ("s", 100_300.0): 2.0, ("one", 9.0): 7.0, ("none", 1.0): None}


def test_period_of_all_samples(spark, monkeypatch):
    import math

    from swathlake.operators import series as R

    rows = [("s", 0.5 * k, math.sin(2 * math.pi * k / 12)) for k in range(900)]
    df = spark.createDataFrame(rows, "system string, time double, v double")
    for block in (16_384, 100):
        monkeypatch.setattr(R, "BLOCK", block)
        assert R.period(df, "v", most=50).first()["period"] == pytest.approx(6.0)


def test_las_files_of_empty_partitions(spark):
    from swathlake.sources import exports

    df = spark.createDataFrame([(1.0, 2.0, 3.0, 0)], "x double, y double, z double, detectioninfo int").repartition(4)
    assert [len(r["content"]) for r in exports.las_files(df).collect()] == [375 + 30]


def test_upsert_of_a_key_that_moves(spark, tmp_path):
    from swathlake.operators import upsert

    path, schema = f"{tmp_path}/t", "k int, day int, v int"
    upsert.upsert(spark, path, spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 2, 1)], schema), ["k"], "day")
    upsert.upsert(spark, path, spark.createDataFrame([(1, 2, 5), (3, 3, 6)], schema), ["k"], "day")
    assert sorted((r["k"], r["day"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, 2, 5), (2, 1, 1), (3, 3, 6)]


def test_nearest_cast_keeps_chunks_without_one(spark):
    from swathlake.operators import series as R

    m = spark.createDataFrame([("s", 0, 0.0, 10.0, 179.9), ("s", 1, 50_000.0, 89.0, 0.0), ("s", 2, 1e6, -40.0, 20.0)], "system string, chunk int, time double, lat double, lon double")
    casts = spark.createDataFrame([(1, 100.0, 10.0, -179.9), (2, 200.0, 10.0, 170.0), (3, 49_000.0, 80.0, 180.0)], "cast_id int, cast_time double, lat double, lon double")
    got = lambda method: [r["cast_id"] for r in R.nearest_cast(m, casts, method).orderBy("chunk").collect()]
    assert got("nearest_in_distance") == [1, 3, 3] and got("nearest_in_time") == [1, 3, 3]
    assert got("nearest_in_time_fourhours") == [1, 3, None] and got("nearest_in_distance_fourhours") == [1, 3, None]


def test_all_stages_in_one_plan(spark):
    from swathlake.operators import kernels

    att = spark.createDataFrame([("s", float(t), 0.0, 0.0, 90.0) for t in range(5)], "system string, time double, roll double, pitch double, heading double")
    beams = [("s", 1.0, 0.0, 0.04, float(a), 0.0, 1500.0, 90.0, 0.0, 0.0, 0.1, 20.0, 45.0, -75.0, 5.0, 1) for a in (-45, 0, 45)]
    s = spark.createDataFrame(beams, "system string, time double, delay double, traveltime double, beampointingangle double, tiltangle double, soundspeed double, heading double, roll double, pitch double, heave double, altitude double, latitude double, longitude double, qualityfactor double, cast_id int")
    casts = spark.createDataFrame([(1, [(0.5, 1500.0), (100.0, 1500.0)])], "cast_id int, layers array<struct<depth:double,sv:double>>")
    r = kernels.processed(s, att, casts, {"zone": 18}).orderBy("beampointingangle").collect()
    assert [x["processing_status"] for x in r] == [5, 5, 5]
    assert r[1]["depthoffset"] == pytest.approx(30.0, abs=0.01) and r[1]["z"] == pytest.approx(30.1, abs=0.01)
    assert r[0]["depthoffset"] == pytest.approx(30.0 / 2**0.5, abs=0.05) and r[0]["y"] == pytest.approx(2 * r[1]["y"] - r[2]["y"], abs=0.2) and abs(r[0]["y"] - r[2]["y"]) == pytest.approx(2 * 30 / 2**0.5, rel=0.02)


def test_two_sided_joins_and_fills_are_linear(spark):
    """200 000 rows a side in one day of one system: frames that are computed anew for every row would take hours."""
    import time

    n = 200_000
    a = spark.range(n).select(F.lit("s").alias("system"), (F.col("id") * 0.3).alias("time"), F.when(F.col("id") % 1000 == 7, F.col("id").cast("double")).otherwise(0.0).alias("value"))
    q = spark.range(n).select(F.lit("s").alias("system"), (F.col("id") * 0.3 + 0.1).alias("time"))
    began = time.time()
    r = timejoin.interpolate(q, a, ["value"]).agg(F.count("value_at"), F.sum("value_at")).first()
    assert r[0] == n and r[1] > 0
    near = timejoin.nearest(q, a, ["value"]).agg(F.sum("value_near")).first()[0]
    assert near == sum(range(7, n, 1000))
    f = series.fill(a, "value").agg(F.min("value"), F.sum("value")).first()
    assert f[0] == 7.0 and f[1] == 7 * 1007 + sum(k * 1000 for k in range(1007, n - 993, 1000)) + (n - 993) * 993
    assert time.time() - began < 60


def test_series_of_a_null_system(spark):
    day = 86_400.0
    rows = [(None, 10.0, 5.0), (None, day + 10, 0.0), (None, day + 20, 7.0), ("a", 10.0, 0.0), ("a", day + 5, 3.0)]
    s = spark.createDataFrame(rows, "system string, time double, value double")
    assert sorted((r["system"] or "", r["time"], r["value"]) for r in series.fill(s, "value").collect()) == [("", 10.0, 5.0), ("", day + 10, 5.0), ("", day + 20, 7.0), ("a", 10.0, 3.0), ("a", day + 5, 3.0)]
    assert sorted((r["system"] or "", r["__k"]) for r in series.numbered(s).collect()) == [("", 0), ("", 1), ("", 2), ("a", 0), ("a", 1)]
    got = {(r["system"], r["time"]): r["value_at"] for r in timejoin.interpolate(s.select("system", "time"), s, ["value"]).collect()}
    assert got == {(a, b): c for a, b, c in rows}


def test_first_and_last_two_samples_beyond_the_ends(spark):
    day = 86_400.0
    s = spark.createDataFrame([("a", 0.0, 0.0), ("a", 3 * day, 3.0), ("a", 3 * day + 10, 13.0), ("b", 5.0, 8.0)], "system string, time double, value double")
    q = spark.createDataFrame([("a", -day), ("a", 4 * day), ("b", -day), ("b", 9 * day), ("c", 1.0)], "system string, time double")
    got = {(r["system"], r["time"]): r["value_at"] for r in timejoin.interpolate(q, s, ["value"]).collect()}
    assert got == {("a", -day): -1.0, ("a", 4 * day): 3.0 + day, ("b", -day): 8.0, ("b", 9 * day): 8.0, ("c", 1.0): None}


def test_upsert_keeps_null_and_escaped_partitions(spark, tmp_path):
    import os

    path, schema = f"{tmp_path}/t", "k int, part string, v int"
    put = lambda rows: upsert.upsert(spark, path, spark.createDataFrame(rows, schema), ["k"], "part")
    rows = lambda: sorted((tuple(r) for r in upsert.read_partitioned(spark, path, "part", spark.createDataFrame([], schema).schema["part"].dataType).select("k", "part", "v").collect()), key=repr)
    put([(1, None, 1), (2, None, 1), (3, None, 1), (4, "a:b c/1", 1), (5, "007", 1), (None, "n", 1), (None, "n", 2)])
    assert rows() == [(1, None, 1), (2, None, 1), (3, None, 1), (4, "a:b c/1", 1), (5, "007", 1), (None, "n", 2)]
    put([(1, None, 9), (6, "", 3)])  # an empty name is null
    assert rows() == [(1, None, 9), (2, None, 1), (3, None, 1), (4, "a:b c/1", 1), (5, "007", 1), (6, None, 3), (None, "n", 2)]
    put([(4, "x=%/é", 5), (5, "07", 6), (None, "m", 7)])  # every key of three partitions moves
    assert rows() == [(1, None, 9), (2, None, 1), (3, None, 1), (4, "x=%/é", 5), (5, "07", 6), (6, None, 3), (None, "m", 7)]
    put([(k, "all", 0) for k in (1, 2, 3, 6)])  # the null partition empties
    assert rows() == [(1, "all", 0), (2, "all", 0), (3, "all", 0), (4, "x=%/é", 5), (5, "07", 6), (6, "all", 0), (None, "m", 7)]
    assert not os.path.exists(path + "__stage")


def test_upsert_of_dated_partitions(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "k int, at timestamp, v int"
    put = lambda rows: upsert.upsert(spark, path, spark.createDataFrame(rows, "k int, at string, v int").selectExpr("k", "cast(at as timestamp) as at", "v"), ["k"], "at")
    put([(1, "2024-01-01 10:00:00.5", 1), (2, "2024-01-01 10:00:00.5", 1), (3, "2024-02-01 00:00:00", 1)])
    put([(3, "2024-01-01 10:00:00.5", 2), (4, None, 2)])
    got = sorted((r["k"], str(r["at"]), r["v"]) for r in upsert.read_partitioned(spark, path, "at", spark.createDataFrame([], schema).schema["at"].dataType).collect())
    assert got == [(1, "2024-01-01 10:00:00.500000", 1), (2, "2024-01-01 10:00:00.500000", 1), (3, "2024-01-01 10:00:00.500000", 2), (4, "None", 2)]


def test_layers_of_updated_and_variable_surfaces(spark):
    from swathlake.operators import grid

    rows = [(float(i % 40), float(i // 40), 10.0 + i % 3, 0.1 * (i % 5), 0.2) for i in range(1600)]
    p = spark.createDataFrame(rows, "x double, y double, z double, tvu double, thu double")
    tile = lambda df: df.withColumns({"tile_x": F.floor(F.col("cell_x") * 4 / 16), "tile_y": F.floor(F.col("cell_y") * 4 / 16)})
    extra = {k: F.avg(c) for k, c in grid.LAYERS.items()}
    cells = tile(grid.surface(p, 4.0, extra=extra))
    more = p.where("x < 10 and y < 10").withColumns({"z": F.col("z") + 1, "tvu": F.lit(2.0)})
    got = grid.updated_cells(cells, p.unionByName(more), more, 4.0, 16.0)
    want = tile(grid.surface(p.unionByName(more), 4.0, extra=extra))
    key = lambda df: sorted((r["cell_x"], r["cell_y"], r["density"], round(r["depth"], 9), round(r["vertical_uncertainty"], 9), round(r["horizontal_uncertainty"], 9)) for r in df.collect())
    assert key(got) == key(want)
    assert {"vertical_uncertainty", "horizontal_uncertainty"} <= set(grid.variable_surface(p, 16.0, layers=True).columns) and "vertical_uncertainty" not in grid.variable_surface(p, 16.0).columns


def test_slopes_stop_at_holes(spark):
    from swathlake.operators import grid

    cells = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0), (2, 0, 6.0), (4, 0, 9.0), (0, 1, 2.0)], "cell_x long, cell_y long, depth double")
    got = {(r["cell_x"], r["cell_y"]): (r["x_slope"], r["y_slope"]) for r in grid.slopes(cells, 2.0).collect()}
    assert got == {(0, 0): (1.0, 0.5), (1, 0): (1.25, None), (2, 0): (1.5, None), (4, 0): (None, None), (0, 1): (None, 0.5)}


def test_opposite_lines_meet_in_every_bucket_and_many_tasks(spark):
    """Tolerances that don't divide the circle lose no azimuths, and the pairs of a small table are not one task's."""
    lines = spark.range(360).select(F.col("id").alias("line"), F.col("id").cast("double").alias("azimuth"), *[(F.col("id") / 100.0).alias(c) for c in ("start_lat", "start_lon", "end_lat", "end_lon")])
    got = params.patch_pairs(lines.coalesce(1), 7.0)
    assert got.rdd.getNumPartitions() > 1
    assert {(r["a"], r["b"]) for r in got.collect()} == {(a, b) for a in range(360) for b in range(a + 1, 360) if abs((a - b) % 360 - 180) <= 7}


def test_few_casts_are_not_carried_by_soundings(spark):
    """Casts that every task holds give what casts joined to each row give, also where a cast, its id or the waterline is missing; repeated ids are joined."""
    from swathlake.operators import kernels

    casts = spark.createDataFrame([(1, [(5.0, 1500.0), (20.0, 1480.0)]), (2, [(1.0, 1490.0)]), (3, None)], "cast_id long, layers array<struct<depth:double,sv:double>>")
    rows = [(k, (1, 2, 3, 4, None)[k % 5], 0.01 * k, 0.02 + 0.001 * k, (0.0, 0.5, None)[k % 3]) for k in range(60)]
    x = spark.createDataFrame(rows, "k long, cast_id long, corr_pointing_angle double, traveltime double, wl double").withColumns({"rel_azimuth": F.lit(0.3), "soundspeed": F.lit(1495.0)})
    few = kernels.ray_trace(x, casts, F.col("wl"))
    twice = kernels.ray_trace(x, casts.unionByName(spark.createDataFrame([(9, [(2.0, 1.0)]), (9, [(2.0, 1.0)])], casts.schema)), F.col("wl"))
    got, want = (sorted(map(repr, (tuple(r) for r in t.select("k", "alongtrack", "acrosstrack", "depthoffset", "in_cast").collect()))) for t in (few, twice))
    assert got == want and len(got) == 60 and few.where("in_cast").count() > 10
    assert "__depths" not in few._jdf.queryExecution().optimizedPlan().toString() and "__depths" in twice._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_one_track_are_moved_as_one(spark, monkeypatch):
    """Tracks of many lines, split into rows of a few, and lines without ends or azimuth give what each line alone gives."""
    from swathlake.functions import geo

    monkeypatch.setattr(params, "TOGETHER", 3)
    rows = [(k, a, k % 2 / 10, None if k % 11 == 0 else 0.2, k % 5 / 100, 0.5) for k, a in enumerate([0.0, 180.0, 170.5, 355.0, None, 0.0, 0.0, -180.0, 195.0, 540.0, 180.0, 0.0] * 3)]
    lines = spark.createDataFrame(rows, "line long, azimuth double, start_lat double, start_lon double, end_lat double, end_lon double")
    for tolerance in (15.0, 180.0):
        a, b = (lines.toDF(*[f"{s}_{c}" for c in lines.columns]) for s in "ab")
        km = F.least(*[geo.haversine_km(F.col(f"a_{p}_lon"), F.col(f"a_{p}_lat"), F.col(f"b_{q}_lon"), F.col(f"b_{q}_lat")) for p in ("start", "end") for q in ("start", "end")])
        each = a.crossJoin(b).where((F.col("a_line") < F.col("b_line")) & (F.abs(F.pmod(F.col("a_azimuth") - F.col("b_azimuth"), F.lit(360.0)) - 180.0) <= tolerance))
        want = sorted(map(repr, (tuple(r) for r in each.select("a_line", "b_line", F.bround(km, 6)).collect())))
        found = params.patch_pairs(lines, tolerance)
        assert sorted(map(repr, (tuple(r) for r in found.select("a", "b", F.bround("km", 6)).collect()))) == want and len(want) > 50
    # a row of many lines is not made for each of them before the pairs are
    moved = params.patch_pairs(lines, 15.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in moved and moved.index("Generate explode(a_lines") < moved.index("Join")


def test_quadtree_keeps_points_beyond_the_first_square(spark):
    """Points on all sides of the first square, and one without a place, are counted in leaves of squares of their own."""
    from swathlake.operators import grid

    p = spark.createDataFrame([(float(x), float(y)) for x in range(-8, 24, 2) for y in range(-8, 24, 2)] + [(None, 1.0)], "x double, y double")
    leaves = grid.quadtree(p, (0.0, 0.0), 8.0, 4, 1.0)
    rows = {(r["level"], r["i"], r["j"]): r["points"] for r in leaves.collect()}
    assert sum(rows.values()) == p.count() == 257
    assert rows[(1, -2, -2)] == rows[(1, 5, 5)] == 4


def test_leaves_of_points_beyond_the_first_square(spark):
    from swathlake.operators import grid

    p = spark.createDataFrame([(float(x), float(y)) for x in range(-8, 24, 2) for y in range(-8, 24, 2)] + [(None, 1.0)], "x double, y double")
    leaves = grid.quadtree(p, (0.0, 0.0), 8.0, 4, 1.0)
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.select("level", "i", "j", "points").collect())))
    found = grid.leaves_of(p, leaves, (0.0, 0.0), 8.0).groupBy("level", "i", "j").agg(F.count("*").alias("points"))
    assert key(found) == key(leaves) and found.agg(F.sum("points")).first()[0] == 257


def test_times_that_rows_share_are_looked_up_once(spark):
    """Rows of equal times, of none and of no system get what interpolate() gives each of them, once each."""
    times = [(s, t) for s in ("a", "b", None) for t in (-5.0, 3.0, 3.0, 599.5, 600.0, 1300.25, None) for _ in range(3)]
    left = spark.createDataFrame([(k, *x) for k, x in enumerate(times)], "ping long, system string, time double")
    right = spark.createDataFrame([("a", float(t), t * 7 % 360.0) for t in range(0, 1400, 100)] + [("b", 10.0, 5.0)], "system string, time double, h double")
    want, got = (sorted(map(repr, f(left, right, ["h"], headings=("h",)).collect())) for f in (timejoin.interpolate, timejoin.interpolate_once))
    assert len(got) == len(times) and got == want
