"""Stale stages, settings by row, and the ray trace over Arrow batches."""

import math
import os

import pytest
from pyspark.sql import functions as F

from swathlake.operators import kernels
from swathlake.plans import runner
from swathlake.plans import stage_queries as Q

SF = "/root/testdata/sf0.001"


def files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def content(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_only_stale_chunks_are_rewritten_and_equal_a_full_run(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    s, att, casts = Q.soundings(spark, SF), Q.attitude(spark, SF), Q.casts(spark)
    runner.store(s, a)
    first = runner.run(spark, a, Q.settings(spark), att, casts).collect()
    assert len(first) == 30 and {r["first"] for r in first} == {0}
    before = files(a)
    again = runner.run(spark, a, Q.settings(spark), att, casts)
    assert again.count() == 0 and files(a) == before
    done = sorted(tuple(r) for r in runner.run(spark, a, Q.settings(spark, Q.CHANGED), att, casts).collect())
    assert done == [(d, c, 2) for d in ("2", "7") for c in (1, 2)]
    changed = {f.rsplit("/", 1)[0] for f, _ in set(files(a).items()) ^ set(before.items())}
    assert changed == {f"dataset={d}/chunk={c}" for d in ("2", "7") for c in (1, 2)}
    runner.store(s, b)
    runner.run(spark, b, Q.settings(spark, Q.CHANGED), att, casts)
    assert content(runner.table(spark, a)) == content(runner.table(spark, b))
    assert runner.table(spark, a).where("processing_status <> 5").count() == 0 and not os.path.exists(f"{a}__stage")


def test_recomputed_chunks_are_written_once(spark, tmp_path, monkeypatch):
    """What stands beside the table is left alone: chunks that are read are replaced in one write, the others stay."""
    path = f"{tmp_path}/once"
    s, casts = Q.soundings(spark, SF), Q.casts(spark)
    runner.store(s, path)
    before, rows = files(path), s.count()
    with open(f"{path}__stage", "w") as f:
        f.write("not a folder of the run's")
    monkeypatch.setattr(runner, "recomputed", lambda x, todo, *_: x.join(F.broadcast(todo.select(*runner.KEYS)), runner.KEYS, "left_semi").withColumn("processing_status", F.lit(5).cast("smallint")).select(*x.columns))
    done = runner.run(spark, path, Q.settings(spark), None, casts, only=F.col("dataset") == "3")
    assert {r["dataset"] for r in done.collect()} == {"3"} and os.path.isfile(f"{path}__stage")
    t = runner.table(spark, path)
    assert t.count() == rows and {r["dataset"] for r in t.where("processing_status = 5").select("dataset").distinct().collect()} == {"3"}
    assert all((f in before) == ("dataset=3/" not in f) for f in files(path))


def test_new_chunks_a_part_of_the_chunks_and_what_if(spark, tmp_path):
    path = f"{tmp_path}/t"
    s, att, casts = Q.soundings(spark, SF), Q.attitude(spark, SF), Q.casts(spark)
    runner.store(s.where("chunk < 2"), path)
    runner.run(spark, path, Q.settings(spark), att, casts, only=F.col("dataset") == "3")
    assert {r["dataset"] for r in runner.table(spark, path).where("processing_status = 5").select("dataset").distinct().collect()} == {"3"}
    runner.store(s.where("chunk = 2"), path)
    done = runner.run(spark, path, Q.settings(spark), att, casts).collect()
    assert len(done) == 28 and ("3", 2) in {(r["dataset"], r["chunk"]) for r in done}
    # another tpu: what if, nothing written
    before, kept = files(path), spark.read.parquet(f"{path}__versions")
    t = runner.table(spark, path)
    want = runner.wanted(runner.chunks(t), Q.settings(spark).withColumn("heave_error", F.lit(5.0)), casts)
    todo = runner.stale(want, kept)
    assert {r["first"] for r in todo.collect()} == {4}
    more = runner.recomputed(t, todo, att, casts)
    assert more.where("tvu > 2").count() > 0 and files(path) == before


def test_stages_follow_what_changed(spark):
    starts = spark.createDataFrame([("a", 0, 10.0, 1), ("a", 1, 50.0, 1), ("b", 0, 10.0, 2)], "dataset string, chunk long, start double, cast_id long")
    casts = spark.createDataFrame([(1, [(1.0, 1500.0)]), (2, [(1.0, 1490.0)])], "cast_id long, layers array<struct<depth:double,sv:double>>")
    base = spark.createDataFrame([("a", 0.0, 1.0, "v1"), ("a", 40.0, 2.0, "v1"), ("b", 20.0, 3.0, None)], "dataset string, time double, waterline double, navigation_version string")
    kept = runner.wanted(starts, base, casts)
    assert {(r["dataset"], r["chunk"]): r["waterline"] for r in kept.collect()} == {("a", 0): 1.0, ("a", 1): 2.0, ("b", 0): 0.0}
    first = lambda s, c=casts: {(r["dataset"], r["chunk"]): r["first"] for r in runner.stale(runner.wanted(starts, s, c), kept).collect()}
    assert first(base) == {}
    assert first(base.withColumn("navigation_version", F.lit("v2"))) == {("a", 0): 3, ("a", 1): 3}
    assert first(base.withColumn("waterline", F.when(F.col("time") == 40, 9.0).otherwise(F.col("waterline")))) == {("a", 1): 2}
    assert first(base, casts.withColumn("layers", F.when(F.col("cast_id") == 2, F.lit(None)).otherwise(F.col("layers")))) == {("b", 0): 2}
    assert first(base.withColumn("tx_heading", F.lit(180.0))) == {("a", 0): 0, ("a", 1): 0}  # b has no settings yet
    assert set(runner.stale(kept, None).select("first").distinct().collect()[0]) == {0}


def bent(angle, one_way, speed, layers):
    """A ray traced layer by layer, one beam at a time."""
    z, h, t, s, c = 0.0, 0.0, 0.0, math.sin(angle), speed
    for depth, below in layers:
        if depth <= 0:
            continue
        cos = math.sqrt(max(1 - s * s, 1e-12))
        dz = depth - z
        dt, dh = dz / cos / c, dz * s / cos
        if 0 < one_way <= t + dt and dt > 0:
            return z + (one_way - t) / dt * dz, h + (one_way - t) / dt * dh, True
        z, h, t, s, c = depth, h + dh, t + dt, max(-1.0, min(1.0, below / c * s)), below
    return 0.0, 0.0, False


def test_ray_trace_of_many_casts_equals_one_beam_at_a_time(spark):
    layers = {1: [(0.5, 1500.0), (3.0, 1495.0), (40.0, 1510.0)], 2: [(10.0, 1480.0), (2.0, 1470.0)], 3: [(5.0 * k + 1, 1490.0 + k % 7) for k in range(60)]}
    rows = [(i, 1 + i % 4, (i % 140 - 70) * math.pi / 180, 0.3, 0.001 * (i % 90), 1485.0 + i % 9, 0.5 * (i % 3)) for i in range(600)] + [(900, None, 0.1, 0.3, 0.02, 1500.0, 0.0), (901, 1, None, 0.3, 0.02, 1500.0, 0.0), (902, 1, 0.2, 0.3, None, 1500.0, 0.0)]
    s = spark.createDataFrame(rows, "id long, cast_id long, corr_pointing_angle double, rel_azimuth double, traveltime double, soundspeed double, wl double").repartition(3)
    casts = spark.createDataFrame([(k, v) for k, v in layers.items()], "cast_id long, layers array<struct<depth:double,sv:double>>")
    got = {r["id"]: r for r in kernels.ray_trace(s, casts, F.col("wl"), (0.1, 0.2, 0.3)).collect()}
    for i, cast, angle, az, two_way, speed, wl in rows:
        given = None not in (cast, angle, two_way) and cast in layers
        d, h, done = bent(abs(angle), two_way / 2, speed, [(z - wl, v) for z, v in sorted([*layers[cast], (kernels.TAIL_DEPTH, kernels.TAIL_SPEED)])]) if given else (0.0, 0.0, False)
        r = got[i]
        assert r["in_cast"] == done
        assert (r["depthoffset"], r["alongtrack"], r["acrosstrack"]) == pytest.approx((d + 0.3, h * math.cos(az) + 0.1, h * math.sin(az) + 0.2), abs=6e-4)


def test_settings_by_row_equal_settings_of_each_dataset(spark):
    s, att, casts = Q.soundings(spark, SF), Q.attitude(spark, SF), Q.casts(spark)
    whole = sorted(map(tuple, Q.processed_soundings(spark, SF).where("k % 12 in (3, 6, 7)").collect()))
    own = []
    for row in Q.settings(spark).where("dataset in ('3', '6', '7')").collect():
        fixed = {k: v for k, v in row.asDict().items() if k not in ("dataset", "time")}
        own += map(tuple, Q._placed(kernels.processed(s.where(F.col("dataset") == row["dataset"]), att, casts, fixed)).collect())
    assert sorted(own) == whole


def test_patch_test_finds_planted_errors(spark):
    from swathlake.operators import patch
    from swathlake.plans import patch_queries as P

    s = P.soundings(spark, SF)
    rows = patch.adjusted(s, P.attitude(spark), P.casts(spark), P._settings({}), 5.0, tuple(P.PLANTED))
    last = {r["parameter"]: r for r in rows if r["iteration"] == 3}
    assert len(rows) == 9 and all(abs(last[k]["value"] - v) < 0.05 for k, v in P.PLANTED.items())
    assert last["roll"]["reliability"] > 0.98 and all(r["variance"] < 1e-3 for r in last.values())
    alone = patch.adjusted(s.where("side = 'a'"), P.attitude(spark), P.casts(spark), P._settings({}), 5.0, ("roll",), 1)
    assert alone[0]["adjustment"] == 0.0 and alone[0]["cells"] == 0


def test_segments(spark):
    from swathlake.operators import patch

    s = spark.createDataFrame([("a", float(t)) for t in range(10)] + [("b", 5.0)], "system string, time double")
    spans = spark.createDataFrame([("a", 1.0, 3.0, "x"), ("a", 7.0, 8.0, "y")], "system string, start double, end double, line string")
    assert sorted(map(tuple, patch.segments(s, spans).collect())) == [("a", 1.0, "x"), ("a", 2.0, "x"), ("a", 3.0, "x"), ("a", 7.0, "y"), ("a", 8.0, "y")]


def test_attitude_is_found_once_for_all_iterations_and_variants(spark, monkeypatch):
    """The time join runs once for a patch test, and in no variant's plan."""
    from swathlake.operators import patch, timejoin
    from swathlake.plans import patch_queries as P

    s, calls = P.soundings(spark, SF), []
    own = timejoin.interpolate_at
    monkeypatch.setattr(timejoin, "interpolate_at", lambda *a, **k: calls.append(1) or own(*a, **k))
    assert len(patch.adjusted(s, P.attitude(spark), P.casts(spark), P._settings({}), 5.0, ("roll",), 2)) == 2
    assert len(calls) == 1


def test_both_times_of_a_beam_equal_a_join_each(spark):
    """Samples just behind a bucket, equal times, times before, after and between far samples, a null time and a system with one sample or none."""
    from swathlake.operators import timejoin

    at = [0.0, 1.0, 1.0, 598.0, 600.0, 601.5, 629.9, 631.0, 1199.9, 1205.0, 4000.0, 4010.0]
    right = spark.createDataFrame([("a", t, float(k * 37 % 360), float(k)) for k, t in enumerate(at)] + [("b", 5.0, 3.0, 4.0), ("a", None, 1.0, 1.0)], "system string, time double, h double, v double")
    rows = [(s, k, t, w) for s in ("a", "b", "c", None) for k, (t, w) in enumerate([(x + d, w) for x in (-50.0, 0.0, 1.0, 590.0, 599.9, 600.0, 1190.0, 2000.0, 3999.0, 5000.0) for d in (0.0, 0.4) for w in (0.0, 1.5, 29.0, 30.0)] + [(None, 1.0), (5.0, None)])]
    left = spark.createDataFrame(rows, "system string, k long, time double, wait double").withColumn("late", F.col("time") + F.col("wait"))
    got = timejoin.interpolate_at(left, right, ["h", "v"], {"time": "_1", "late": "_2"}, 31.0, ("h",))
    want = timejoin.interpolate(left, right, ["h", "v"], ("h",), suffix="_1", bucket=86_400.0)
    want = timejoin.interpolate(want.withColumnsRenamed({"time": "t", "late": "time"}), right, ["h", "v"], ("h",), suffix="_2", bucket=86_400.0).withColumnsRenamed({"time": "late", "t": "time"})
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*got.columns).where("time is not null and late is not null").collect())))
    assert key(got) == key(want) and got.count() == left.count()


def test_columns_nobody_asks_for_are_not_moved(spark):
    from swathlake.operators import timejoin

    left = spark.createDataFrame([("a", 1.0, "wide")], "system string, time double, unused string")
    right = spark.createDataFrame([("a", 0.0, 1.0)], "system string, time double, v double")
    plan = timejoin.interpolate(left, right, ["v"]).select("v_at")._jdf.queryExecution().optimizedPlan().toString()
    union = plan[plan.index("Union") :]
    assert "unused" not in union.split("LogicalRDD")[0]
