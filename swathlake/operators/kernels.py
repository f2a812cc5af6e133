"""The sounding pipeline's stages as column expressions on long rows, one sounding each.

orientation -> beam vectors -> ray trace -> position -> uncertainty, and backscatter. Every stage takes and returns a
DataFrame and sets processing_status; nothing shuffles but the attitude join of the first, and the cast join where casts
are many. Settings are numbers, or columns where datasets of different settings are processed together.
The ray trace runs over Arrow batches, a layer at a time for all beams of a cast; all else stays in the JVM.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, rotation
from . import timejoin


def _vector(v: list) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("float").alias(n) for x, n in zip(v, "xyz", strict=True)])


def _parts(column: str) -> list[Column]:
    return [F.col(f"{column}.{n}").cast("double") for n in "xyz"]


# --- orientation


def _column(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def _sign(reversed_) -> Column | float:
    return F.when(reversed_, -1.0).otherwise(1.0) if isinstance(reversed_, Column) else -1.0 if reversed_ else 1.0


def ideal_vectors(tx_heading, rx_heading) -> tuple[list, list, bool | Column, bool | Column]:
    """Ideal transmitter and receiver axes, and whether each is mounted backwards."""
    flipped = lambda h: (F.abs(h) > 90) & (F.abs(h) < 270) if isinstance(h, Column) else 90 < abs(h) < 270
    t, r = flipped(tx_heading), flipped(rx_heading)
    return [_sign(t), 0.0, 0.0], [0.0, _sign(r), 0.0], t, r


#: What the attitude when a beam was sent and received is kept in, and the longest time between the two in seconds.
ATTITUDE, MOST_WAIT = [f"{n}_{a}" for a in ("tx", "rx") for n in ("roll", "pitch", "heading")], 30.0


def attitude_at_beams(soundings: DataFrame, attitude: DataFrame, latency: float | Column = 0.0) -> DataFrame:
    """Adds the columns of ATTITUDE, for both times of a beam in one shuffle. No mounting angle counts here, so that settings may be joined, or varied, afterwards."""
    wait = F.greatest(F.lit(0.0), F.least(F.col("traveltime").cast("double"), F.lit(MOST_WAIT)))
    sent = (F.col("time") + latency + F.col("delay")).cast("double")
    out = soundings.withColumns({"__sent": sent, "__back": sent + wait})
    names = ["roll", "pitch", "heading"]
    # a second more than the wait, as sums of times are rounded
    out = timejoin.interpolate_at(out, attitude.select("system", "time", *names), names, {"__sent": "_tx", "__back": "_rx"}, MOST_WAIT + 1, headings=("heading",))
    return out.drop("__sent", "__back")


def orientation(soundings: DataFrame, attitude: DataFrame | None, tx_angles: tuple, rx_angles: tuple, latency: float | Column = 0.0) -> DataFrame:
    """Adds tx and rx: the axes in the geographic frame when each beam was sent and received; status 1. Soundings that have the columns of ATTITUDE keep what they say."""
    tx, rx, _, _ = ideal_vectors(tx_angles[2], rx_angles[2])
    out = soundings if set(ATTITUDE) <= set(soundings.columns) else attitude_at_beams(soundings, attitude, latency)
    for axis, ideal, angles in (("tx", tx, tx_angles), ("rx", rx, rx_angles)):
        mounted = rotation.apply(rotation.mounting(*angles), ideal)
        m = rotation.matrix(*[F.col(f"{n}_{axis}") for n in ("roll", "pitch", "heading")])
        out = out.withColumn(axis, _vector(rotation.apply(m, mounted)))
    return out.drop(*ATTITUDE).withColumn("processing_status", F.lit(1).cast("smallint"))


# --- beam vectors


def array_vector(tx: list[Column], rx: list[Column], tx_angle: Column, rx_angle: Column) -> list[Column]:
    """Beam in the frame of the arrays, from the angle that the axes make."""
    off = F.acos(F.greatest(F.least(rotation.dot(tx, rx), F.lit(1.0)), F.lit(-1.0))) - math.pi / 2
    y = -F.sin(rx_angle) / F.cos(off) + F.sin(tx_angle) * F.tan(off)
    x = F.sin(tx_angle)
    return [x, y, F.sqrt(F.greatest(1 - (x * x + y * y), F.lit(0.0)))]


def beam_vectors(soundings: DataFrame, tx_reversed: bool | Column = False, rx_reversed: bool | Column = False) -> DataFrame:
    """Adds rel_azimuth and corr_pointing_angle in radians, from tx, rx, tiltangle, beampointingangle and heading; status 2."""
    rx_angle = F.radians(F.greatest(F.least(F.col("beampointingangle").cast("double"), F.lit(180.0)), F.lit(-180.0))) * _sign(rx_reversed)
    tx_angle = F.radians(F.col("tiltangle").cast("double")) * _sign(tx_reversed)
    x = soundings.withColumns({"__rx": rx_angle, "__tx": tx_angle})
    tx, rx = _parts("tx"), _parts("rx")
    v = array_vector(tx, rx, F.col("__tx"), F.col("__rx"))
    x = x.withColumns({f"__v{k}": c for k, c in enumerate(v)})
    z = rotation.cross(tx, rx)
    size = F.sqrt(rotation.dot(z, z))
    x = x.withColumns({f"__z{k}": c / size for k, c in enumerate(z)})
    z = [F.col(f"__z{k}") for k in range(3)]
    y = rotation.cross(z, tx)
    x = x.withColumns({f"__g{k}": tx[k] * F.col("__v0") + y[k] * F.col("__v1") + z[k] * F.col("__v2") for k in range(3)})
    g = [F.col(f"__g{k}") for k in range(3)]
    azimuth = F.radians(F.pmod(F.degrees(F.atan2(g[1], g[0])) - F.col("heading") + 360.0, F.lit(360.0)))
    steep = math.pi / 2 - F.atan2(g[2], F.sqrt(g[0] * g[0] + g[1] * g[1]))
    x = x.withColumns({"rel_azimuth": azimuth, "corr_pointing_angle": F.when(F.col("__rx") < 0, -steep).otherwise(steep), "processing_status": F.lit(2).cast("smallint")})
    return x.drop("__rx", "__tx", *[f"__{a}{k}" for a in "vzg" for k in range(3)])


# --- ray trace

#: Depth and speed of the layer that casts shallower than the limit get.
TAIL_DEPTH, TAIL_SPEED, TAIL_LIMIT = 12000.0, 1669.0, 10000.0


def prepared_cast(layers: Column) -> Column:
    """Layers (depth, sv) in order of depth, with the tail."""
    deep = F.array_max(F.transform(layers, lambda p: p["depth"].cast("double")))
    tail = F.array(F.struct(F.lit(TAIL_DEPTH).alias("depth"), F.lit(TAIL_SPEED).alias("sv")))
    x = F.transform(layers, lambda p: F.struct(p["depth"].cast("double").alias("depth"), p["sv"].cast("double").alias("sv")))
    return F.array_sort(F.when(deep < TAIL_LIMIT, F.concat(x, tail)).otherwise(x))


#: What comes of a ray, and bytes of casts that may be broadcast; counted first.
RAY, BROADCAST_BYTES = "struct<down:double,across:double,done:boolean>", 16_000_000


def bent(angle, one_way, speed, depths, speeds):
    """(down, across, done) of beams that leave at an angle with the surface speed and bend at each layer of one cast; where half the travel time ends, the layer is interpolated. Arrays, a layer at a time."""
    import numpy as np

    z, sine, c = 0.0, np.sin(angle), speed
    h, t, down, across = (np.zeros(len(angle)) for _ in range(4))
    done = np.zeros(len(angle), bool)
    for depth, below in zip(depths, speeds, strict=True):
        cos = np.sqrt(np.maximum(1 - sine * sine, 1e-12))
        dz = depth - z
        dh, dt = dz * sine / cos, dz / cos / c
        here = ~done & (dt > 0) & (one_way >= t) & (one_way <= t + dt) & (one_way > 0)
        if here.any():
            share = (one_way[here] - t[here]) / dt[here]
            down[here], across[here] = z + share * dz, h[here] + share * dh[here]
            done |= here
            if done.all():
                break
        h, t, z = h + dh, t + dt, depth
        sine, c = np.clip(below / c * sine, -1.0, 1.0), below
    return down, across, done


def _values(a: pa.Array):
    return a.to_numpy(zero_copy_only=False).astype(float)


def _bent_groups(key: pa.Array, waterline: pa.Array, cast, angle: pa.Array, one_way: pa.Array, speed: pa.Array) -> pa.Array:
    """Rays of a batch: beams of one cast and waterline bend together. cast: gives depths and speeds of a row's cast, or None."""
    import numpy as np

    x, w, c = (_values(a) for a in (angle, one_way, speed))
    n = len(x)
    down, across, done = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    codes = [a.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1 for a in (key, waterline)]
    _, first, of = np.unique(codes[0] * (n + 1) + codes[1], return_index=True, return_inverse=True)
    order = np.argsort(of, kind="stable") if len(first) > 1 else np.arange(n)
    ends = np.cumsum(np.bincount(of, minlength=len(first)))
    for g, i in enumerate(first.tolist()):
        layers = cast(i)
        if layers is None:
            continue
        rows = order[ends[g - 1] if g else 0 : ends[g]]
        wl = waterline[i].as_py()
        d, v = layers[0] - (math.nan if wl is None else wl), layers[1]
        with np.errstate(all="ignore"):
            down[rows], across[rows], done[rows] = bent(x[rows], w[rows], c[rows], d[d > 0], v[d > 0])
    return pa.StructArray.from_arrays([pa.array(down), pa.array(across), pa.array(done)], ["down", "across", "done"])


def _rays():
    """The ray trace as a function of (cast's key, waterline, depths, speeds, angle, one-way time, surface speed)."""
    import numpy as np

    def trace(key: pa.Array, waterline: pa.Array, depths: pa.Array, speeds: pa.Array, angle: pa.Array, one_way: pa.Array, speed: pa.Array) -> pa.Array:
        cast = lambda i: tuple(np.array(a[i].as_py(), float) for a in (depths, speeds)) if depths[i].is_valid else None
        return _bent_groups(key, waterline, cast, angle, one_way, speed)

    return F.arrow_udf(trace, RAY)


def _rays_of(casts: DataFrame):
    """The same of few casts (key, depths, speeds), which every task holds: a function of (cast's key, waterline, angle, one-way time, surface speed)."""
    import numpy as np

    held = casts.sparkSession.sparkContext.broadcast({r[0]: (np.array(r[1], float), np.array(r[2], float)) for r in casts.collect() if r[1] is not None})

    def trace(key: pa.Array, waterline: pa.Array, angle: pa.Array, one_way: pa.Array, speed: pa.Array) -> pa.Array:
        return _bent_groups(key, waterline, lambda i: held.value.get(key[i].as_py()), angle, one_way, speed)

    return F.arrow_udf(trace, RAY)


def ray_trace(soundings: DataFrame, casts: DataFrame, waterline_offset: float | Column = 0.0, offsets: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """Adds alongtrack, acrosstrack, depthoffset and in_cast; status 3.

    soundings: corr_pointing_angle, rel_azimuth, traveltime, soundspeed, cast_id; casts: cast_id, layers. A beam leaves
    with the surface speed and bends at each layer; in the layer where half its travel time ends, it is interpolated.
    Depths of a cast count from the transmitter, layers above it are left out. Beams that the cast doesn't reach get 0
    and in_cast false. Each beam starts from the cast as given.
    """
    c = casts.select("cast_id", prepared_cast(F.col("layers")).alias("__l"))
    c = c.select("cast_id", F.transform("__l", lambda p: p["depth"]).alias("__depths"), F.transform("__l", lambda p: p["sv"]).alias("__speeds"))
    size = c.agg(F.coalesce(F.sum(F.size("__depths").cast("long") * 16 + 32), F.lit(0)).alias("bytes"), F.count("cast_id").alias("n"), F.countDistinct("cast_id").alias("different")).first()
    key, small = F.col("cast_id").cast("string"), size["bytes"] <= BROADCAST_BYTES
    beam = F.abs(F.col("corr_pointing_angle").cast("double")), F.col("traveltime").cast("double") / 2, F.col("soundspeed").cast("double")
    if small and size["n"] == size["different"]:  # no row carries its cast
        x = soundings
        ray = _rays_of(c.where("cast_id is not null").select(key, "__depths", "__speeds"))(key, _column(waterline_offset).cast("double"), *beam)
    else:
        x = soundings.join(F.broadcast(c) if small else c, "cast_id", "left")
        ray = _rays()(key, _column(waterline_offset).cast("double"), "__depths", "__speeds", *beam)
    x = x.withColumn("__ray", ray)
    h, az = F.abs(F.col("__ray.across")), F.col("rel_azimuth").cast("double")
    along, across, down = map(_column, offsets)
    return x.withColumns(
        {
            "alongtrack": F.bround(h * F.cos(az) + along, 3).cast("float"),
            "acrosstrack": F.bround(h * F.sin(az) + across, 3).cast("float"),
            "depthoffset": F.bround(F.col("__ray.down") + down, 3).cast("float"),
            "in_cast": F.col("__ray.done"),
            "processing_status": F.lit(3).cast("smallint"),
        }
    ).drop("__ray", "__depths", "__speeds")


# --- position


#: Names of vertical references.
WATERLINE, ELLIPSE = ("vessel", "waterline", "Aviso MLLW"), ("ellipse", "MLLW", "MHW")


def vertical(reference: str | Column, depth: Column, altitude: Column, heave: Column, waterline: Column, tide: Column) -> Column:
    """Depth, or height above the ellipsoid, by the vertical reference; of a column of references, null for unknown ones."""
    if isinstance(reference, Column):
        by = lambda r: vertical(r, depth, altitude, heave, waterline, tide)
        return F.when(reference.isin(*ELLIPSE), by("ellipse")).when(reference == "vessel", by("vessel")).when(reference == "waterline", by("waterline")).when(reference.startswith("Aviso"), by("Aviso"))
    if reference in ELLIPSE:
        return altitude - depth
    if reference == "vessel":
        return depth + heave
    if reference == "waterline":
        return depth + heave - waterline
    if reference.startswith("Aviso"):
        return depth + heave - waterline - tide
    raise ValueError(f"no vertical reference {reference}")


def _turned(lever: tuple) -> Column:
    """How much deeper a lever arm's end is under roll, pitch and heading than at rest."""
    m = rotation.matrix(F.col("roll"), F.col("pitch"), F.col("heading"))
    return rotation.apply(m, [_column(v) for v in lever])[2] - _column(lever[2])


def induced_heave(pings: DataFrame, primary: tuple[float, float, float], secondary: tuple[float, float, float]) -> DataFrame:
    """pings (roll, pitch, heading, heave) of the second of two heads with the heave that its own place adds: heave is told at the first head's transmitter."""
    return pings.withColumn("heave", F.col("heave") - _turned(tuple(a - b for a, b in zip(primary, secondary, strict=True))))


def altitude_at_transmitter(pings: DataFrame, lever: tuple) -> DataFrame:
    """pings (roll, pitch, heading, altitude) with the altitude moved from the reference point to the transmitter, whose lever arm this is."""
    if not any(isinstance(v, Column) or v for v in lever):
        return pings
    return pings.withColumn("altitude", F.col("altitude") + _turned(tuple(-v for v in lever)))


#: Settings of a dataset and their defaults; angles in degrees, lengths in metres.
SETTINGS = {
    "tx_roll": 0.0, "tx_pitch": 0.0, "tx_heading": 0.0, "rx_roll": 0.0, "rx_pitch": 0.0, "rx_heading": 0.0, "latency": 0.0, "waterline": 0.0, "offset_x": 0.0, "offset_y": 0.0, "offset_z": 0.0,
    "lever_x": 0.0, "lever_y": 0.0, "lever_z": 0.0, "zone": 1, "south": False, "reference": "waterline", "ifremer": True,
}
STAGES = ("orientation", "beam_vectors", "sound_velocity", "georeference", "uncertainty")


def stage(number: int, x: DataFrame, settings: dict, attitude: DataFrame | None = None, casts: DataFrame | None = None) -> DataFrame:
    """One stage, by its number from 0. settings: names of SETTINGS and TPU with numbers or columns; missing ones have their defaults."""
    s = SETTINGS | settings
    tx, rx = ([s[f"{a}_{n}"] for n in ("roll", "pitch", "heading")] for a in ("tx", "rx"))
    if number == 0:
        return orientation(x, attitude, tuple(tx), tuple(rx), s["latency"])
    if number == 1:
        return beam_vectors(x, *ideal_vectors(tx[2], rx[2])[2:])
    if number == 2:
        return ray_trace(x, casts, s["waterline"], tuple(s[f"offset_{n}"] for n in "xyz"))
    if number == 3:
        names = x.columns
        if "primary" in s:
            x = induced_heave(x.withColumn("__heave", F.col("heave")), s["primary"], s["secondary"])
        x = altitude_at_transmitter(x.withColumn("__altitude", F.col("altitude")), tuple(s[f"lever_{n}"] for n in "xyz"))
        x = georeference(x, s["zone"], s["south"], s["reference"], waterline=s["waterline"])
        for c in ("heave", "altitude"):  # as recorded, so that a later run starts from the same
            if f"__{c}" in x.columns:
                x = x.withColumn(c, F.col(f"__{c}")).drop(f"__{c}")
        return x.select(*names, *[c for c in x.columns if c not in names])
    return uncertainty(x, s["reference"], {k: v for k, v in settings.items() if k in TPU}, s["ifremer"])


def processed(soundings: DataFrame, attitude: DataFrame, casts: DataFrame, settings: dict) -> DataFrame:
    """All stages in one lazy plan: orientation, beam vectors, ray trace, position and uncertainty; status 5.

    soundings: time, system, delay, traveltime, beampointingangle, tiltangle, soundspeed, heading, roll, pitch, heave,
    altitude, latitude, longitude, qualityfactor and cast_id. settings: as for stage(), and for a second head primary and
    secondary lever arms; each may be left out, and each may be a column.
    """
    x = soundings
    for k in range(len(STAGES)):
        x = stage(k, x, settings, attitude, casts)
    return x


def georeference(soundings: DataFrame, zone: int | Column, south: bool | Column = False, reference: str | Column = "waterline", z_offset: float = 0.0, waterline: float | Column = 0.0) -> DataFrame:
    """Adds x, y, z and geohash from the offsets, heading, heave, altitude and position; status 4. Where a coordinate can't be had, x, y and z are null and the geohash is blank."""
    along, across = F.col("alongtrack").cast("double"), F.col("acrosstrack").cast("double")
    azimuth = F.pmod(F.degrees(F.atan2(across, along)) + F.col("heading"), F.lit(360.0))
    far = F.sqrt(along * along + across * across)
    tide = F.col("tide") if "tide" in soundings.columns else F.lit(0.0)
    z = vertical(reference, F.col("depthoffset").cast("double") + z_offset, F.col("altitude").cast("double"), F.col("heave").cast("double"), _column(waterline), tide)
    x = soundings.withColumns({"__to": azimuth, "__far": far, "__z": z})
    x = geo.along_geodesic(x, F.col("latitude"), F.col("longitude"), F.col("__to"), F.col("__far"), ("__lat", "__long"))
    x = geo.in_utm(geo.apart(x, "__lat", "__long"), F.col("__lat"), F.col("__long"), zone, south, ("__x", "__y"))
    ok = F.col("__x").isNotNull() & ~F.isnan("__x") & (F.abs("__x") < 1e9)
    x = x.withColumns({n: F.when(ok, c) for n, c in (("x", F.bround("__x", 3)), ("y", F.bround("__y", 3)), ("z", F.bround(F.col("__z").cast("float").cast("double"), 3).cast("float")))})
    x = geo.with_geohash(geo.apart(x, "__x"), "__lat", "__long", 7, "geohash")
    x = x.withColumns({"geohash": F.when(ok, F.col("geohash")).otherwise(F.lit("       ")), "processing_status": F.lit(4).cast("smallint")})
    return x.drop("__to", "__far", "__z", "__lat", "__long", "__x", "__y")


# --- uncertainty

#: Default one-sigma uncertainties (metres, degrees, metres a second).
TPU = {
    "heave_error": 0.05, "roll_sensor_error": 0.0005, "pitch_sensor_error": 0.0005, "heading_sensor_error": 0.02, "roll_patch_error": 0.1, "surface_sv_error": 0.5,
    "horizontal_positioning_error": 1.5, "vertical_positioning_error": 1.0, "separation_model_error": 0.0, "waterline_error": 0.02, "beam_opening_angle": 1.0,
    "tx_to_antenna_x": 0.0, "tx_to_antenna_y": 0.0, "tx_to_antenna_z": 0.0,
}


def sounder_variance(depth: Column, across: Column, quality: Column, ifremer: bool | Column) -> tuple[Column, Column]:
    """(vertical, horizontal) of the sounder's own measurement, from its quality factor."""
    q = quality / (F.when(ifremer, 100.0).otherwise(2500.0) if isinstance(ifremer, Column) else 100.0 if ifremer else 2500.0)
    return depth * q, F.abs(across) * q


def uncertainty(soundings: DataFrame, reference: str | Column = "waterline", settings: dict | None = None, ifremer: bool | Column = True, singlebeam: bool = False) -> DataFrame:
    """Adds tvu and thu, 1.96 sigma; status 5. Needs depthoffset, acrosstrack, roll, beampointingangle, corr_pointing_angle, soundspeed and qualityfactor. Settings are numbers or columns; of a column of references unknown ones give null."""
    s = {k: _column(v) for k, v in (TPU | (settings or {})).items()}
    square = lambda v: v * v
    d, a = F.col("depthoffset").cast("double"), F.col("acrosstrack").cast("double")
    theta, raw = F.col("corr_pointing_angle").cast("double"), F.radians(F.col("beampointingangle").cast("double"))
    c = F.col("soundspeed").cast("double")
    v, h = sounder_variance(d, a, F.col("qualityfactor").cast("double"), ifremer)
    beam = d - d * F.cos(F.radians(s["beam_opening_angle"]) / 2)
    # the roll angles multiply, a length is among the variances, and the waterline total takes the measured error unsquared: fixed by results that must be matched
    roll = a * a * (square(F.radians(s["roll_sensor_error"])) * square(F.radians(s["roll_patch_error"])))
    refraction = F.lit(0.0) if singlebeam else (F.pow(d / c, 2) + a * a * (F.pow(F.tan(theta) / (2 * c), 2) + F.pow(F.tan(theta - raw) / c, 2))) * square(s["surface_sv_error"])
    common, separation = v * v + roll + refraction + beam, square(s["separation_model_error"])
    by_waterline = F.sqrt(F.sqrt(common + square(s["heave_error"])) + separation + square(s["waterline_error"]))
    by_ellipse = F.sqrt(common + square(s["vertical_positioning_error"]) + separation)
    if isinstance(reference, Column):
        tvu = F.when(reference.isin(*WATERLINE), by_waterline).when(reference.isin(*ELLIPSE), by_ellipse)
    elif reference in WATERLINE + ELLIPSE:
        tvu = by_waterline if reference in WATERLINE else by_ellipse
    else:
        raise ValueError(f"no vertical reference {reference}")
    lever = (square(s["tx_to_antenna_x"]) + square(s["tx_to_antenna_y"])) * s["heading_sensor_error"] + (square(s["roll_sensor_error"]) + square(s["pitch_sensor_error"])) * s["tx_to_antenna_z"]
    thu = F.sqrt(h * h + 2 * square(s["horizontal_positioning_error"]) + lever)
    return soundings.withColumns({"tvu": (1.96 * tvu).cast("float"), "thu": (1.96 * thu).cast("float"), "processing_status": F.lit(5).cast("smallint")})


# --- backscatter


def spreading(slant: Column) -> Column:
    return 20 * F.log10(slant)


def transmission_loss(slant: Column, absorption_db_km: Column) -> Column:
    return 2 * (spreading(slant) + absorption_db_km / 1000.0 * slant)


def area_correction(slant: Column, angle_deg: Column, pulse: Column, soundspeed: Column, tx_width_deg: float, rx_width_deg: float) -> Column:
    """10 log10 of the smaller of the beam-limited and the pulse-limited area."""
    tx, rx = math.radians(tx_width_deg), math.radians(rx_width_deg)
    beam = tx * rx * slant * slant
    sin = F.abs(F.sin(F.radians(angle_deg)))
    flat = soundspeed * pulse / 2 * tx * slant / F.when(sin > 1e-9, sin).otherwise(1e-9)
    return 10 * F.log10(F.least(beam, flat))


def gain_over_time(kind: str, slant: Column, absorption_db_km: Column, near_normal: Column | None = None, spreading_loss: Column | None = None, recorded: Column | None = None) -> Column:
    """The gain that a sonar family applied: modelled for .all (less the near-normal corrector) and .s7k (with its spreading loss), recorded for .kmall."""
    weakening = absorption_db_km / 1000.0 * slant
    if kind == ".all":
        return 2 * (spreading(slant) + weakening) - near_normal
    if kind == ".s7k":
        return 2 * (spreading_loss * F.log10(slant) + weakening)
    return recorded


def backscatter(soundings: DataFrame, tx_width_deg: float, rx_width_deg: float, fixed_gain: bool = True, tvg: bool = True, loss: bool = True, area: bool = True) -> DataFrame:
    """Adds backscatter: raw intensity less fixed gain and gain over time, plus transmission loss, less the area term; each can be left out."""
    slant = F.sqrt(sum(F.pow(F.col(c).cast("double"), 2) for c in ("acrosstrack", "alongtrack", "depthoffset")))
    x = soundings.withColumn("__r", slant)
    b = F.col("reflectivity").cast("double")
    if fixed_gain:
        b = b - F.coalesce(F.col("fixedgain").cast("double"), F.lit(0.0))
    if tvg:
        b = b - F.coalesce(F.col("tvg").cast("double"), F.lit(0.0))
    if loss:
        b = b + transmission_loss(F.col("__r"), F.col("absorption").cast("double"))
    if area:
        b = b - area_correction(F.col("__r"), F.col("beampointingangle").cast("double"), F.col("pulselength").cast("double"), F.col("soundspeed").cast("double"), tx_width_deg, rx_width_deg)
    return x.withColumn("backscatter", b.cast("float")).drop("__r")


def angle_bin(angle_deg: Column, width: float = 1.0) -> Column:
    """Right-closed bin of an angle, from -90 degrees on."""
    return (F.ceil((angle_deg + 90.0) / width) - 1).cast("int")


def angle_gain_tables(soundings: DataFrame, key: str, width: float = 1.0, reference: float = 45.0, value: str = "backscatter", angle: str = "corr_angle_deg") -> DataFrame:
    """(key, bin, correction) of every dataset and bin of 180 degrees: its mean, empty ones interpolated, less the mean at the reference angle. Windows run over the bins of one dataset."""
    from pyspark.sql import Window

    n = int(round(180 / width))
    mean = soundings.where(F.col(value).isNotNull() & F.col(angle).isNotNull()).groupBy(F.col(key).alias("key"), angle_bin(F.col(angle), width).alias("bin")).agg(F.avg(value).alias("m"))
    t = mean.select("key").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(mean, ["key", "bin"], "left")
    up, down = (Window.partitionBy("key").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("bin"), F.desc("bin")))
    known = F.when(F.col("m").isNotNull(), F.struct("bin", "m"))
    t = t.withColumns({"a": F.last(known, True).over(up), "b": F.last(known, True).over(down)})
    y = F.when(F.col("a").isNull(), F.col("b.m")).when(F.col("b").isNull() | (F.col("a.bin") == F.col("b.bin")), F.col("a.m"))
    y = y.otherwise(F.col("a.m") + (F.col("b.m") - F.col("a.m")) * (F.col("bin") - F.col("a.bin")) / (F.col("b.bin") - F.col("a.bin")))
    t = t.select("key", "bin", y.alias("y"))
    at = int(math.ceil((reference + 90.0) / width) - 1)
    zero = F.max(F.when(F.col("bin") == at, F.col("y"))).over(Window.partitionBy("key"))
    return t.select(F.col("key").alias(key), "bin", (F.col("y") - zero).alias("correction"))


def angle_gain_table(soundings: DataFrame, width: float = 1.0, reference: float = 45.0, value: str = "backscatter", angle: str = "corr_angle_deg") -> DataFrame:
    """(bin, correction) of all soundings together."""
    return angle_gain_tables(soundings.withColumn("__all", F.lit(0)), "__all", width, reference, value, angle).drop("__all")


def angle_gain_correct(soundings: DataFrame, table: DataFrame, width: float = 1.0, value: str = "backscatter", angle: str = "corr_angle_deg") -> DataFrame:
    """Takes the bin's correction off; a table of at most 180 / width rows is broadcast."""
    x = soundings.withColumn("__bin", angle_bin(F.col(angle), width)).join(F.broadcast(table.select(F.col("bin").alias("__bin"), "correction")), "__bin", "left")
    return x.withColumn(value, (F.col(value) - F.coalesce("correction", F.lit(0.0))).cast("float")).drop("__bin", "correction")
