"""Vessel history, action planner, line pairs and nearest casts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from swathlake.operators import nearest, params, series, vessel
from swathlake.plans import actions

ROWS = "system string, ts double, param string, value double"


def rows(data):
    """{system: {param: {ts: value}}} as rows."""
    return [(s, float(t), p, float(v)) for s, ps in data.items() for p, vs in ps.items() for t, v in vs.items()]


def told(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["system"], {}).setdefault(r["param"], {})[r["ts"]] = r["value"]
    return out


# fixed values: parameter sets and results that must be matched
ONE = {"rx_opening_angle": {1234.0: 1.0, 1244.0: 1.5, 1254.0: 2.0}, "rx_x": {1234.0: 0.345, 1244.0: 0.456, 1254.0: 0.789}}
TWO = {"rx_opening_angle": {1234.0: 3.0, 1244.0: 3.5, 1254.0: 4.0}, "rx_x": {1234.0: 1.345, 1244.0: 2.456, 1254.0: 3.789}}
T = (1584426525.0, 1584438532.0, 1597569340.0)
SETS = {"latency": (0.1,) * 3, "roll_patch_error": (0.1,) * 3, "roll_sensor_error": (0.0005,) * 3, "rx_h": (359.576,) * 3, "rx_x": (1.1, 1.2, 1.3), "waterline": (1.1, 1.2, 1.3)}
SETS = {k: dict(zip(T, v)) for k, v in SETS.items()}


def frame(spark, data):
    return spark.createDataFrame(rows(data), ROWS)


def test_updates_of_a_vessel(spark):
    v = frame(spark, {"123": ONE})
    v = vessel.updated(v, frame(spark, {"345": TWO}))
    assert told(v) == {"123": ONE, "345": TWO}
    v = frame(spark, {"123": ONE, "345": TWO})
    new = frame(spark, {"345": {"rx_opening_angle": {1234: 999}}})
    after = told(vessel.updated(v, new))
    assert after == {"123": ONE, "345": TWO | {"rx_opening_angle": {1234.0: 4.0, 1244.0: 3.5, 1254.0: 4.0}}}
    after = told(vessel.updated(v, new, carry=False))
    assert after == {"123": ONE, "345": TWO | {"rx_opening_angle": {1234.0: 999.0, 1244.0: 3.5, 1254.0: 4.0}}}
    assert told(vessel.updated(v, frame(spark, {"345": TWO}))) == {"123": ONE, "345": TWO}


def test_parts_of_a_history(spark):
    p = frame(spark, {"s": SETS})
    assert [(r["n"], dict(r["values"])) for r in vessel.split(p).orderBy("n").collect()] == [(n, {k: v[t] for k, v in SETS.items()}) for n, t in enumerate(T)]
    assert told(vessel.joined(vessel.split(p))) == {"s": SETS}
    cut = lambda a, b: {t for r in told(vessel.trimmed(p, a, b)).values() for v in r.values() for t in v}
    assert cut(1584426525, 1584426530) == {T[0]} and cut(1584438532, 1584438542) == {T[1]} and cut(1584426525, 1584438542) == {T[0], T[1]} and cut(1584426522, 1584426525) == set()


def test_differences(spark):
    base = frame(spark, {"s": SETS})

    def d(changes, a=base):
        new = {k: dict(v) for k, v in SETS.items()}
        for (k, t), v in changes.items():
            new[k][t] = v
        r = vessel.differences(a, frame(spark, {"s": new})).first()
        return r["offsets"], r["angles"], r["tpu"], r["values"], r["waterline"]

    assert d({}) == (False, False, False, False, None)
    assert d({("latency", T[0]): 1.0}) == (False, True, False, True, None)
    assert d({("roll_patch_error", T[1]): 999}) == (False, False, True, True, None)
    assert d({("rx_h", T[1]): 999, ("rx_x", T[1]): 999}) == (True, True, False, True, None)
    assert d({("waterline", T[0]): 999})[4] == 999 and d({("waterline", T[1]): 999})[4] is None
    moved = {k: {999999999.0 if t == T[0] else t: v for t, v in SETS[k].items()} for k in ("roll_patch_error", "rx_h", "rx_x")}
    assert d({}, frame(spark, {"s": moved})) == (True, True, True, False, None)


def test_equal_sets_and_forms(spark):
    flat = {k: SETS[k] for k in ("latency", "roll_patch_error", "rx_h")}
    assert told(params.earliest_of_equal(frame(spark, {"s": flat}))) == {"s": {k: {T[0]: v[T[0]]} for k, v in flat.items()}}
    p = frame(spark, {"a": SETS, "b": ONE})
    about = spark.createDataFrame([("a", "em2040", "x.all"), ("b", "em302", None)], "system string, sonar_type string, source string")
    v = vessel.to_vessel(p, about)
    back, description = vessel.from_vessel(v)
    assert sorted((r["system"], r["ts"], r["param"], float(r["value"])) for r in back.collect()) == sorted(rows({"a": SETS, "b": ONE}))
    assert {(r["system"], r["sonar_type"], r["source"]) for r in description.collect()} == {("a", "em2040", "x.all"), ("b", "em302", None)} and description.count() == 6


def test_interval_algebra(spark):
    base = frame(spark, {"s": {"x": {0: 1, 10: 1, 20: 2, 30: 1}}})
    i = vessel.intervals(base)
    get = lambda df: sorted((r["param"], r["start"], r["end"], r["value"]) for r in df.collect())
    assert get(i) == [("x", 0.0, 20.0, 1.0), ("x", 20.0, 30.0, 2.0), ("x", 30.0, None, 1.0)]
    assert get(vessel.cut(i, 25.0)) == [("x", 0.0, 20.0, 1.0), ("x", 20.0, 25.0, 2.0), ("x", 25.0, 30.0, 2.0), ("x", 30.0, None, 1.0)]
    assert get(vessel.intervals(vessel.at_starts(vessel.cut(i, 25.0)))) == get(i)
    over = spark.createDataFrame([("s", "x", 9.0, 5.0, 10.0), ("s", "x", 2.0, 15.0, 20.0), ("s", "y", 4.0, 0.0, None)], "system string, param string, value double, start double, end double")
    assert get(vessel.overlaid(i, over)) == [("x", 0.0, 5.0, 1.0), ("x", 5.0, 10.0, 9.0), ("x", 10.0, 15.0, 1.0), ("x", 15.0, 30.0, 2.0), ("x", 30.0, None, 1.0), ("y", 0.0, None, 4.0)]
    assert get(vessel.overlaid(vessel.overlaid(i, over), i)) == [*get(i), ("y", 0.0, None, 4.0)]


def test_planner(spark):
    d = spark.createDataFrame([("old", 5, 0.0, False), ("raw", 0, 0.0, False), ("moved", 5, 0.0, True)], "dataset string, status int, start double, waterline boolean")
    flags = {k: F.lit(False) for k in ("crs", "datum", "reference", "offsets", "angles", "tpu")}
    files = spark.createDataFrame([("a.all", 10, "em", 7, 100.0), ("b.all", 11, "em", 7, 200.0), ("c.all", 12, "em", 8, 100.0), ("known.all", 1, "em", 7, 5.0)], "name string, size long, model string, serial long, start double")
    known = spark.createDataFrame([("known.all", 1)], "name string, size long")
    named = spark.createDataFrame([("raw", 8, 50.0)], "name string, serial long, start double")
    casts = spark.createDataFrame([("d1", "one.svp"), ("d2", "two.svp")], "digest string, file string")
    held = spark.createDataFrame([("old", "d1"), ("old", "d2"), ("moved", "d1"), ("moved", "gone")], "dataset string, digest string")
    nav = spark.createDataFrame([("raw", "s.out"), ("old", "t.out")], "dataset string, file string")
    lines = spark.createDataFrame([("old", "l1", 10.0), ("old", "l2", 99.0), ("moved", "m", 5.0)], "container string, line string, processed double")
    surface = spark.createDataFrame([("map", "old", "l1", 50.0), ("map", "old", "l2", 50.0), ("map", "moved", "m", 50.0)], "surface string, container string, line string, added double")
    plan = actions.multibeam(files, known, named).unionByName(actions.navigation(nav, nav.where("dataset = 'old'"))).unionByName(actions.svp(casts, held, d)).unionByName(actions.processing(d.withColumns(flags))).unionByName(actions.gridding(lines, surface))
    got = {r["id"]: list(r["inputs"]) for r in plan.collect()}
    assert got == {
        "multibeam:em_7_01_01_1970": ["a.all", "b.all"], "multibeam:raw": ["c.all"], "navigation:raw": ["s.out"], "svp:raw": ["one.svp", "two.svp"], "svp:moved": ["two.svp"],
        "processing:raw": sorted(["orientation", "beam_vectors", "sound_velocity", "georeference", "uncertainty"]), "processing:moved": sorted(["sound_velocity", "georeference", "uncertainty"]), "gridding:map": ["old/l2/stale"],
    }
    need = actions.needs(plan, surface)
    q = plan.select("id", "content").withColumn("running", F.lit(False)).where("id <> 'svp:raw'").withColumn("content", F.when(F.col("id") == "navigation:raw", "other").otherwise(F.col("content"))).unionByName(spark.createDataFrame([("svp:gone", "x", False)], "id string, content string, running boolean"))
    q = q.withColumn("running", F.col("id") == "processing:raw")
    out = [(r["id"], r["rank"], r["change"]) for r in actions.queued(plan, q, need).orderBy("place").collect()]
    assert out == [
        ("multibeam:em_7_01_01_1970", 0, "kept"), ("multibeam:raw", 0, "kept"), ("svp:moved", 0, "kept"), ("navigation:raw", 1, "changed"), ("svp:raw", 1, "new"), ("processing:moved", 1, "kept"), ("processing:raw", 2, "running"), ("gridding:map", 2, "kept"),
    ]
    assert {r["id"] for r in actions.changes(plan, q).where("change = 'gone'").collect()} == {"svp:gone"}
    with pytest.raises(ValueError):
        actions.ranked(plan, spark.createDataFrame([("svp:raw", "multibeam:raw"), ("multibeam:raw", "svp:raw")], "id string, needed string"), most=5)


def test_chosen_crs(spark):
    d = spark.createDataFrame([("a", 26918, -74.0, 40.0), ("b", 26918, -70.0, 1.0), ("c", None, 20.0, -5.0)], "dataset string, epsg int, max_lon double, min_lat double")
    get = lambda **k: {r["dataset"]: (r["epsg"], r["why"]) for r in actions.chosen_crs(d, **k).collect()}
    assert get() == {"a": (32618, "zone"), "b": (32619, "zone"), "c": (32734, "zone")} and get(force_common=True)["c"] == (26918, "common") and get(epsg=4326)["a"] == (4326, "given")


def haversine(a, b):
    (y1, x1), (y2, x2) = ((math.radians(v) for v in p) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def test_pairs_equal_the_sequential_greedy(spark):
    r = random.Random(3)
    lines = [(f"l{i:03}", r.choice([0.0, 180.0, 90.0, 271.0, 45.0]) + r.uniform(-10, 10), *[v for _ in range(2) for v in (40 + r.gauss(0, 0.02), -70 + r.gauss(0, 0.02))]) for i in range(120)]
    lines += [("far1", 0.0, 10.0, 179.999, 10.1, 179.999), ("far2", 180.0, 10.11, -179.999, 10.3, -179.999), ("alone", 10.0, -60.0, 0.0, -60.1, 0.0)]
    df = spark.createDataFrame(lines, "line string, azimuth double, start_lat double, start_lon double, end_lat double, end_lon double")
    pairs = []
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            turn = abs((a[1] - b[1]) % 360 - 180)
            km = min(haversine(p, q) for p in ((a[2], a[3]), (a[4], a[5])) for q in ((b[2], b[3]), (b[4], b[5])))
            if turn <= 30 and km <= 256:
                pairs.append((km, min(a[0], b[0]), max(a[0], b[0])))
    used, want = set(), set()
    for km, a, b in sorted(pairs):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    want |= {(x[0], None) for x in lines if x[0] not in used}
    got = params.paired_lines(df).collect()
    assert {(x["a"], x["b"]) for x in got} == want and len(got) == len(want)
    assert ("alone", None) in want and ("far1", "far2") in want


def test_nearest_casts_in_one_harbour(spark):
    r = random.Random(5)
    casts = [(i, 1000.0 * (i % 40), 40 + r.gauss(0, 0.001), -70 + r.gauss(0, 0.001)) for i in range(400)] + [(500 + i, 0.0, r.uniform(-89, 89), r.uniform(-180, 180)) for i in range(60)]
    casts += [(1000, 5.0, casts[3][2], casts[3][3]), (1001, None, 40.0, -70.0), (1002, 5.0, None, -70.0)]
    chunks = [("s", i, r.uniform(0, 40_000), 40 + r.gauss(0, 0.002), -70 + r.gauss(0, 0.002)) for i in range(300)] + [("s", 300 + i, 10.0 * i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(100)]
    chunks += [("s", 900, 5.0, None, 1.0), ("s", 901, None, 40.0, -70.0), (None, 902, 5.0, 40.0, -70.0)]
    m = spark.createDataFrame(chunks, "system string, chunk int, time double, lat double, lon double").repartition(3)
    c = spark.createDataFrame(casts, "cast_id int, cast_time double, lat double, lon double")

    def brute(hours):
        out = {}
        for _, k, t, y, x in chunks:
            ok = [(haversine((y, x), (cy, cx)), i) for i, ct, cy, cx in casts if None not in (y, x, cy, cx) and (hours is None or (t is not None and ct is not None and abs(t - ct) <= hours * 3600))]
            out[k] = min(ok)[1] if ok else None
        return out

    got = lambda method, hours=4.0: {x["chunk"]: x["cast_id"] for x in series.nearest_cast(m, c, method, hours).collect()}
    want = brute(None)
    assert got("nearest_in_distance") == want and want[900] is None
    assert got("nearest_in_distance_fourhours", 0.5) == brute(0.5)
    few, nearest.MOST = nearest.MOST, 10  # more casts than tasks may hold: they meet by cells
    try:
        assert got("nearest_in_distance") == want
        assert got("nearest_in_distance_fourhours", 0.5) == brute(0.5)
    finally:
        nearest.MOST = few
    assert series.nearest_cast(m, c.where("false"), "nearest_in_distance").where("cast_id is null").count() == len(chunks)


@pytest.mark.parametrize("method", ["nearest_in_distance", "nearest_in_distance_fourhours"])
def test_casts_of_one_place_count_once(spark, monkeypatch, method):
    """Many casts of few places fit the bound of a tree, and the smallest id of a place is found."""
    from swathlake.operators import nearest, series

    monkeypatch.setattr(nearest, "MOST", 5)
    monkeypatch.setattr(series, "_met", lambda *a, **k: pytest.fail("met by cells"))
    c = spark.createDataFrame([(k, 0.0, float(k % 4), 1.0) for k in range(200, 0, -1)], "cast_id int, cast_time double, lat double, lon double")
    m = spark.createDataFrame([(k, 10.0, k + 0.1, 1.0) for k in range(4)], "chunk int, time double, lat double, lon double")
    assert {r["chunk"]: r["cast_id"] for r in series.nearest_cast(m, c, method).collect()} == {0: 4, 1: 1, 2: 2, 3: 3}


def test_pairs_of_lines_that_share_ends(spark):
    """Lines of one place, of places that share an end, and of none: what the loop over all pairs takes, in rounds that don't grow with the lines."""
    r = random.Random(4)
    ends = [(40 + r.uniform(0, 0.1), -70 + r.uniform(0, 0.1)) for _ in range(5)]
    lines = []
    for k in range(160):
        i = r.randrange(4)
        lines.append((k, r.choice([0.0, 180.0, 90.0, 271.0, -95.0, 540.0]) + r.choice([0, 5, 12]), *(ends[i] + ends[i + 1] if k % 3 else ends[i] + (40.5 + i, -60.0))))
    lines += [(1000 + k, 20.0 + k % 2 * 180.0, *[v for _ in range(2) for v in (40 + r.gauss(0, 0.02), -70 + r.gauss(0, 0.02))]) for k in range(30)]
    lines += [(2000, None, *ends[0], *ends[1]), (2001, 0.0, None, -70.0, *ends[1]), (2002, float("nan"), *ends[0], *ends[1])]
    df = spark.createDataFrame(lines, "line long, azimuth double, start_lat double, start_lon double, end_lat double, end_lon double")
    pairs = []
    some = [x for x in lines if x[0] not in (2000, 2002)]
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            km = min(haversine(p, q) for p in (a[2:4], a[4:6]) for q in (b[2:4], b[4:6]) if None not in p + q)
            if abs((a[1] - b[1]) % 360 - 180) <= 20 and km <= 64:
                pairs.append((km, a[0], b[0]))
    used, want = set(), set()
    for _, a, b in sorted(pairs):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    want |= {(x[0], None) for x in lines if x[0] not in used}
    got = params.paired_lines(df, 20.0, 64.0).collect()
    assert {(x["a"], x["b"]) for x in got} == want and len(got) == len(want)
    same = {(x["a"], x["b"]) for x in params._of_shared_ends(df, 20.0).collect()}
    assert same == {(a, b) for a, b in want if (0.0, a, b) in set(pairs)} and len(same) > 40
