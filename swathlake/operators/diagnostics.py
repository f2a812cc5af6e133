"""Motion-artefact tests and the patch test."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import series
from .tables import kept


def wobble_data(soundings: DataFrame, attitude_at_ping: DataFrame, max_period: float, step: float, inner_deg: float = 45.0, most_deviation: float | None = None, taps: int = 101) -> DataFrame:
    """One row a ping: mean depth and slope across track, both high-passed, the slopes of the inner fan and of both sides, and the attitude with its rate of roll."""
    key = ["system", "time"]
    full = series.regression(soundings, "acrosstrack", "depth", key).select(*key, "slope", "percent_deviation")
    mean = soundings.groupBy(*key).agg(F.avg("depth").alias("mean_depth"))
    part = lambda where, name: series.regression(soundings.where(where), "acrosstrack", "depth", key).select(*key, F.col("slope").alias(name))
    angle = F.abs(F.degrees(F.col("corr_pointing_angle")))
    x = mean.join(full, key).join(part(angle <= inner_deg, "inner"), key, "left").join(part("acrosstrack < 0", "port"), key, "left").join(part("acrosstrack > 0", "starboard"), key, "left")
    if most_deviation is not None:
        x = x.where(F.col("percent_deviation") < most_deviation)
    c = series.high_pass(max_period, step, taps)
    for name in ("mean_depth", "slope", "inner", "port", "starboard"):
        x = series.filtered(x, name, c, f"hp_{name}")
    return series.rate(attitude_at_ping, "roll").withColumnRenamed("rate", "roll_rate").join(x, key)


#: Each test: what is plotted against what.
WOBBLE_TESTS = {
    "attitude_scaling": ("roll", "hp_slope"), "attitude_scaling_inner": ("roll", "hp_inner"), "attitude_latency": ("roll_rate", "hp_slope"), "yaw_alignment": ("pitch", "hp_slope"), "x_lever_arm": ("pitch", "hp_mean_depth"),
    "y_lever_arm": ("roll", "hp_mean_depth"), "heave_sound_speed_port": ("heave", "hp_port"), "heave_sound_speed_starboard": ("heave", "hp_starboard"),
}


def wobble_table(data: DataFrame, tests: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(test, slope, intercept, r2, n) of every test, in one pass."""
    tests = tests or WOBBLE_TESTS
    one = data.agg(*[F.struct(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n")).alias(k) for k, (x, y) in tests.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("test"), F.col(k).alias("v")) for k in tests])).alias("t")).select("t.test", "t.v.*")


#: Samples from whose spectrum the first frequency is taken; a fit's span grows FACTOR times a stage, ROUNDS corrections each.
FIRST, FACTOR, ROUNDS = 4096, 4, 4


def _first_sine(p):
    """The strongest frequency of a system's first samples, and the least squares of a sine of it."""
    import pandas as pd

    p = p.sort_values("t")
    t, v = p["t"].to_numpy(float), p["v"].to_numpy(float)
    t0, w, a, b, c = float(t[0]), None, None, None, float(v.mean())
    if len(t) > 8 and t[-1] > t[0]:
        grid = np.linspace(t[0], t[-1], len(t))
        power = np.abs(np.fft.rfft(np.interp(grid, t, v) - v.mean()))
        w = float(2 * np.pi * np.fft.rfftfreq(len(grid), grid[1] - grid[0])[int(power[1:].argmax()) + 1])
        x = w * (t - t0)
        a, b, c = map(float, np.linalg.lstsq(np.stack([np.sin(x), np.cos(x), np.ones_like(x)], 1), v, rcond=None)[0])
    return pd.DataFrame({"k": [p["k"].iloc[0]], "t0": [t0], "w": [w], "a": [a], "b": [b], "c": [c]}).astype({n: float for n in ("w", "a", "b", "c")})


def fit_sine(df: DataFrame, column: str, by: str = "system", time: str = "time") -> DataFrame:
    """(by, amplitude, frequency, phase, offset) of the sine that fits a series best; all but the offset null for eight samples or fewer. Null times and values count for nothing.

    The frequency begins at the strongest of the first FIRST samples and is then corrected by least squares over a span
    FACTOR times as long each stage, until all samples count: each correction is one aggregate of sums a system.
    """
    import pandas as pd

    kind = df.schema[by].dataType.simpleString()
    x = df.select(F.col(by).alias("k"), F.col(time).cast("double").alias("t"), F.col(column).cast("double").alias("v")).where("k is not null and t is not null and v is not null")
    x = kept(series.numbered(x, "k", "t"))  # the stages read it again and again
    most = x.agg(F.max("__k")).first()[0]
    if most is None:
        return x.select(F.col("k").alias(by), *[F.lit(None).cast("double").alias(n) for n in ("amplitude", "frequency", "phase", "offset")])
    fits = kept(x.where(F.col("__k") < FIRST).select("k", "t", "v").groupBy("k").applyInPandas(_first_sine, f"k {kind}, t0 double, w double, a double, b double, c double"))

    def corrected(p: pd.DataFrame) -> pd.DataFrame:
        out = p[["k", "t0", "w", "a", "b", "c"]].copy()
        for i, r in enumerate(p.itertuples()):
            m = np.zeros((4, 4))
            m[np.triu_indices(4)] = r.m
            scale = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
            m = (m + np.triu(m, 1).T) / np.outer(scale, scale)
            d = np.linalg.lstsq(m, np.array(r.y) / scale, rcond=1e-12)[0] / scale
            out.iloc[i, 2:] = [r.w + d[3], r.a + d[0], r.b + d[1], r.c + d[2]]
        return out

    span = FIRST
    while True:
        for _ in range(ROUNDS):
            z = x.where(F.col("__k") < span).join(fits.where("w is not null"), "k")
            u = F.col("t") - F.col("t0")
            sin, cos = F.sin(F.col("w") * u), F.cos(F.col("w") * u)
            design = [sin, cos, F.lit(1.0), u * (F.col("a") * cos - F.col("b") * sin)]
            z = z.select("k", "t0", "w", "a", "b", "c", *[d.alias(f"d{i}") for i, d in enumerate(design)], (F.col("v") - F.col("a") * sin - F.col("b") * cos - F.col("c")).alias("left"))
            sums = z.groupBy("k", "t0", "w", "a", "b", "c").agg(
                F.array(*[F.sum(F.col(f"d{i}") * F.col(f"d{j}")) for i in range(4) for j in range(i, 4)]).alias("m"), F.array(*[F.sum(F.col(f"d{i}") * F.col("left")) for i in range(4)]).alias("y"),
            )
            new = sums.mapInPandas(lambda batches: map(corrected, batches), f"k {kind}, t0 double, w double, a double, b double, c double")
            fits = kept(new.unionByName(fits.where("w is null")))
        if span > most:
            break
        span *= FACTOR
    return fits.select(F.col("k").alias(by), F.hypot("a", "b").alias("amplitude"), (F.col("w") / (2 * math.pi)).alias("frequency"), (F.atan2("b", "a") - F.col("w") * F.col("t0")).alias("phase"), F.col("c").alias("offset"))


def rotated(points: DataFrame, azimuth_deg: float) -> DataFrame:
    """Points turned so that x runs along a line's azimuth, from their least x and y."""
    a = np.radians(azimuth_deg)
    x, y = F.col("x"), F.col("y")
    r = points.withColumns({"x": x * float(np.sin(a)) + y * float(np.cos(a)), "y": x * float(np.cos(a)) - y * float(np.sin(a))})
    low = r.agg(F.min("x").alias("__x"), F.min("y").alias("__y"))
    return r.join(F.broadcast(low)).withColumns({"x": x - F.col("__x"), "y": y - F.col("__y")}).drop("__x", "__y")


def normal_equations(rows: DataFrame, design: list[Column], observed: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """A'A, A'L and the number of rows, by one aggregate of n (n + 3) / 2 sums."""
    n, w = len(design), weight if weight is not None else F.lit(1.0)
    sums = [F.coalesce(F.sum(design[i] * design[j] * w), F.lit(0.0)) for i in range(n) for j in range(i, n)] + [F.coalesce(F.sum(design[i] * observed * w), F.lit(0.0)) for i in range(n)] + [F.count("*")]
    v = rows.agg(*sums).first()
    a, k = np.zeros((n, n)), 0
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = v[k]
            k += 1
    return a, np.array(v[k : k + n], float), v[-1]


def patch_design(depth: str = "depth", along: str = "along", across: str = "across", x_slope: str = "x_slope", y_slope: str = "y_slope") -> list[Column]:
    """Columns of the patch test's design: roll, pitch, heading, x offset, y offset and horizontal scale."""
    d, p, q, sx, sy = (F.col(c) for c in (depth, along, across, x_slope, y_slope))
    return [sy * d - q, sx * d + p, sx * q - sy * p, sx, sy, sx * p + sy * q]


def patch_adjustment(rows: DataFrame, observed: str = "diff", prior: tuple[float, ...] = (1e-3,) * 6) -> tuple[np.ndarray, np.ndarray]:
    """Adjustments and their variances by weighted least squares; the 6 x 6 system is solved on the driver."""
    design = patch_design()
    a, l, n = normal_equations(rows, design, F.col(observed))  # noqa: E741
    inverse = np.linalg.inv(a + np.diag(prior))
    x = inverse @ l
    rest = rows.agg(F.coalesce(F.sum(F.pow(F.col(observed) - sum(c * float(v) for c, v in zip(design, x, strict=True)), 2)), F.lit(0.0))).first()[0]
    return x, np.diag(inverse) * rest / max(n - len(x), 1)
