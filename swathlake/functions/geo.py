"""Positions as column expressions: distances, geodesics, geohashes, UTM and polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
#: WGS84.
A, INVERSE_F = 6378137.0, 298.257223563
FLAT = 1 / INVERSE_F
B = A * (1 - FLAT)
#: Rounds of the geodesic series; more change nothing in millimetres but near antipodes.
ROUNDS = 6


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.asin(F.sqrt(h)) * (2 * 6371.0)


def on_circle(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """What haversine() takes of a position, had once a row and not once a pair: longitude and latitude in radians and the latitude's cosine."""
    return F.radians(lon), F.radians(lat), F.cos(F.radians(lat))


def haversine(lon1: Column, lat1: Column, cos1: Column, lon2: Column, lat2: Column, cos2: Column) -> Column:
    """Squared half chord, which grows with the distance; km_of() makes kilometres of it."""
    y, x = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    return y * y + cos1 * cos2 * (x * x)


def km_of(h: Column) -> Column:
    return F.asin(F.sqrt(h)) * (2 * 6371.0)


def _series(cos2alpha: Column) -> tuple[Column, Column]:
    u2 = cos2alpha * ((A * A - B * B) / (B * B))
    return 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))), u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the ellipsoid by the inverse series; 0 for equal points. Each round is a step of a fold, so the expression stays small."""
    u1, u2 = F.atan(F.tan(F.radians(lat1)) * (1 - FLAT)), F.atan(F.tan(F.radians(lat2)) * (1 - FLAT))
    start = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lon2 - lon1).alias("l"))
    zero = F.lit(0.0)
    state = F.struct(start.alias("p"), F.radians(lon2 - lon1).alias("lam"), zero.alias("sin"), zero.alias("cos"), zero.alias("sigma"), zero.alias("cos2a"), zero.alias("c2m"))

    def step(x: Column, _: Column) -> Column:
        p, lam = x["p"], x["lam"]
        sin = F.sqrt(F.pow(p["c2"] * F.sin(lam), 2) + F.pow(p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam), 2))
        cos = p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam)
        sina = F.when(sin == 0, 0.0).otherwise(p["c1"] * p["c2"] * F.sin(lam) / F.when(sin == 0, 1.0).otherwise(sin))
        return F.struct(p.alias("p"), lam.alias("lam"), sin.alias("sin"), cos.alias("cos"), sina.alias("sigma"), (1 - sina * sina).alias("cos2a"), zero.alias("c2m"))

    def turn(x: Column, k: Column) -> Column:
        y = step(x, k)
        # two folds of one element bind y once instead of copying it
        def close(y: Column) -> Column:
            p = y["p"]
            sigma = F.atan2(y["sin"], y["cos"])
            c2m = F.when(y["cos2a"] == 0, 0.0).otherwise(y["cos"] - 2 * p["s1"] * p["s2"] / F.when(y["cos2a"] == 0, 1.0).otherwise(y["cos2a"]))
            c = y["cos2a"] * (FLAT / 16) * (4 + FLAT * (4 - 3 * y["cos2a"]))
            lam = p["l"] + (1 - c) * FLAT * y["sigma"] * (sigma + c * y["sin"] * (c2m + c * y["cos"] * (2 * c2m * c2m - 1)))
            return F.struct(p.alias("p"), lam.alias("lam"), y["sin"].alias("sin"), y["cos"].alias("cos"), sigma.alias("sigma"), y["cos2a"].alias("cos2a"), c2m.alias("c2m"))

        return F.transform(F.array(y), close)[0]

    def finish(x: Column) -> Column:
        a, b = _series(x["cos2a"])
        m, s, c = x["c2m"], x["sin"], x["cos"]
        delta = b * s * (m + b / 4 * (c * (2 * m * m - 1) - b / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))
        return F.when(s == 0, 0.0).otherwise(B * a * (x["sigma"] - delta))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, turn, finish)


def geodesic_forward(lat: Column, lon: Column, azimuth_deg: Column, distance: Column) -> Column:
    """(lat, lon) in degrees at a distance along an azimuth, by the direct series."""
    start = F.transform(
        F.array(F.struct(F.atan(F.tan(F.radians(lat)) * (1 - FLAT)).alias("u"), F.radians(azimuth_deg).alias("az"), distance.alias("d"), F.radians(lon).alias("lon"))),
        lambda x: F.struct(x["u"].alias("u"), x["az"].alias("az"), x["lon"].alias("lon"), F.atan2(F.tan(x["u"]), F.cos(x["az"])).alias("s1"), (F.cos(x["u"]) * F.sin(x["az"])).alias("sina"), x["d"].alias("d")),
    )[0]

    def series(x: Column) -> Column:
        a, b = _series(1 - x["sina"] * x["sina"])
        return F.struct(x.alias("x"), (x["d"] / (B * a)).alias("base"), b.alias("b"), (x["d"] / (B * a)).alias("sigma"))

    state = F.transform(F.array(start), series)[0]

    def step(y: Column, _: Column) -> Column:
        m = F.cos(2 * y["x"]["s1"] + y["sigma"])
        s, c, b = F.sin(y["sigma"]), F.cos(y["sigma"]), y["b"]
        delta = b * s * (m + b / 4 * (c * (2 * m * m - 1) - b / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))
        return F.struct(y["x"].alias("x"), y["base"].alias("base"), b.alias("b"), (y["base"] + delta).alias("sigma"))

    def finish(y: Column) -> Column:
        x, sg = y["x"], y["sigma"]
        s, c, su, cu, ca = F.sin(sg), F.cos(sg), F.sin(x["u"]), F.cos(x["u"]), F.cos(x["az"])
        cos2a = 1 - x["sina"] * x["sina"]
        phi = F.atan2(su * c + cu * s * ca, (1 - FLAT) * F.sqrt(x["sina"] * x["sina"] + F.pow(su * s - cu * c * ca, 2)))
        lam = F.atan2(s * F.sin(x["az"]), cu * c - su * s * ca)
        k = cos2a * (FLAT / 16) * (4 + FLAT * (4 - 3 * cos2a))
        m = F.cos(2 * x["s1"] + sg)
        l = lam - (1 - k) * FLAT * x["sina"] * (sg + k * s * (m + k * c * (2 * m * m - 1)))  # noqa: E741
        return F.struct(F.degrees(phi).alias("lat"), F.degrees(x["lon"] + l).alias("lon"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), state, step, finish)


def along_geodesic(df: DataFrame, lat: Column, lon: Column, azimuth_deg: Column, distance: Column, to: tuple[str, str]) -> DataFrame:
    """df with the position that geodesic_forward() gives, in columns of these names. Steps are columns of their own, so each is generated code and nothing is worked out twice."""
    c, last = F.col, df.columns
    x = df.withColumns({"__u": F.atan(F.tan(F.radians(lat)) * (1 - FLAT)), "__az": F.radians(azimuth_deg), "__d": distance, "__lon": F.radians(lon)})
    x = x.withColumns({"__su": F.sin("__u"), "__cu": F.cos("__u"), "__sz": F.sin("__az"), "__cz": F.cos("__az")})
    x = x.withColumns({"__s1": F.atan2(F.tan("__u"), c("__cz")), "__sa": c("__cu") * c("__sz")})
    x = x.withColumn("__c2", 1 - c("__sa") * c("__sa"))
    a, b = _series(c("__c2"))
    x = x.withColumns({"__base": c("__d") / (B * a), "__b": b, "__k": c("__c2") * (FLAT / 16) * (4 + FLAT * (4 - 3 * c("__c2")))})
    x = x.withColumn("__sg", c("__base"))
    for _ in range(4):
        x = x.withColumns({"__m": F.cos(2 * c("__s1") + c("__sg")), "__s": F.sin("__sg"), "__c": F.cos("__sg")})
        m, s, k = c("__m"), c("__s"), c("__c")
        x = x.withColumn("__sg", c("__base") + c("__b") * s * (m + c("__b") / 4 * (k * (2 * m * m - 1) - c("__b") / 6 * m * (4 * s * s - 3) * (4 * m * m - 3))))
    x = x.withColumns({"__m": F.cos(2 * c("__s1") + c("__sg")), "__s": F.sin("__sg"), "__c": F.cos("__sg")})
    s, k, su, cu = c("__s"), c("__c"), c("__su"), c("__cu")
    phi = F.atan2(su * k + cu * s * c("__cz"), (1 - FLAT) * F.sqrt(c("__sa") * c("__sa") + F.pow(su * s - cu * k * c("__cz"), 2)))
    lam = F.atan2(s * c("__sz"), cu * k - su * s * c("__cz"))
    turn = lam - (1 - c("__k")) * FLAT * c("__sa") * (c("__sg") + c("__k") * s * (c("__m") + c("__k") * k * (2 * c("__m") * c("__m") - 1)))
    return x.select(*last, F.degrees(phi).alias(to[0]), F.degrees(c("__lon") + turn).alias(to[1]))


def in_utm(df: DataFrame, lat: Column, lon: Column, zone: int | Column, south: bool | Column, to: tuple[str, str]) -> DataFrame:
    """df with the coordinates that utm() gives, in columns of these names; steps as in along_geodesic()."""
    c, last = F.col, df.columns
    n = FLAT / (2 - FLAT)
    radius, e = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256), 2 * math.sqrt(n) / (1 + n)
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    x = df.withColumns({"__sp": F.sin(F.radians(lat)), "__dl": F.radians(lon - (zone * 6 - 183))})
    x = x.withColumn("__t", F.sinh(atanh(c("__sp")) - e * atanh(e * c("__sp"))))
    x = x.withColumns({"__xi": F.atan2(c("__t"), F.cos("__dl")), "__q": F.sin("__dl") / F.sqrt(1 + c("__t") * c("__t"))})
    x = x.withColumn("__eta", atanh(c("__q")))
    # multiples of the angles from the first: sin and cos, sinh and cosh of sums
    x = x.withColumns({"__s2": F.sin(2 * c("__xi")), "__c2": F.cos(2 * c("__xi")), "__sh2": F.sinh(2 * c("__eta")), "__ch2": F.cosh(2 * c("__eta"))})
    east, north = c("__eta"), c("__xi")
    for j, a in enumerate(series_of_utm(n), 1):
        if j > 1:
            p = 2 * (j - 1)
            x = x.withColumns({
                f"__s{2 * j}": c(f"__s{p}") * c("__c2") + c(f"__c{p}") * c("__s2"), f"__c{2 * j}": c(f"__c{p}") * c("__c2") - c(f"__s{p}") * c("__s2"),
                f"__sh{2 * j}": c(f"__sh{p}") * c("__ch2") + c(f"__ch{p}") * c("__sh2"), f"__ch{2 * j}": c(f"__ch{p}") * c("__ch2") + c(f"__sh{p}") * c("__sh2"),
            })
        east, north = east + a * c(f"__c{2 * j}") * c(f"__sh{2 * j}"), north + a * c(f"__s{2 * j}") * c(f"__ch{2 * j}")
    shift = F.when(south, 10000000.0).otherwise(0.0) if isinstance(south, Column) else F.lit(10000000.0 if south else 0.0)
    return x.select(*last, (500000.0 + 0.9996 * radius * east).alias(to[0]), (shift + 0.9996 * radius * north).alias(to[1]))


def series_of_utm(n: float) -> list[float]:
    """Coefficients of the forward series, from the third flattening."""
    return [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]


def utm(lat: Column, lon: Column, zone: int | Column, south: bool | Column = False) -> Column:
    """(x, y) in a UTM zone by the series of order 6 in the third flattening."""
    shift = F.when(south, 10000000.0).otherwise(0.0) if isinstance(south, Column) else F.lit(10000000.0 if south else 0.0)
    n = FLAT / (2 - FLAT)
    alpha = series_of_utm(n)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, d = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    first = F.array(F.struct(F.atan2(t, F.cos(d)).alias("xi"), atanh(F.sin(d) / F.sqrt(1 + t * t)).alias("eta"), shift.alias("shift")))

    def place(p: Column) -> Column:
        x = p["eta"] + sum(a * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"]) for j, a in enumerate(alpha, 1))
        y = p["xi"] + sum(a * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"]) for j, a in enumerate(alpha, 1))
        return F.struct((500000.0 + 0.9996 * radius * x).alias("x"), (p["shift"] + 0.9996 * radius * y).alias("y"))

    return F.transform(first, place)[0]


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    """Base-32 hash by interleaving the bits of both coordinates; null for a null or NaN coordinate."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    cell = lambda x, low, span, n: F.least(F.greatest(F.floor((x - low) / span * float(1 << n)), F.lit(0)), F.lit((1 << n) - 1)).cast("long")
    q = F.transform(F.array(F.struct(cell(lon, -180.0, 360.0, n_lon).alias("a"), cell(lat, -90.0, 180.0, n_lat).alias("b"))), lambda p: _hash_text(p["a"], p["b"], precision, n_lon, n_lat))[0]
    return F.when(lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon), q)


def with_geohash(df: DataFrame, lat: str, lon: str, precision: int, name: str, blank: str | None = None) -> DataFrame:
    """df with the hash of two columns, or `blank` where one is null or NaN; cells are columns of their own, so that all of it is generated code."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    cell = lambda x, low, span, n: F.least(F.greatest(F.floor((F.col(x) - low) / span * float(1 << n)), F.lit(0)), F.lit((1 << n) - 1)).cast("long")
    ok = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    x = df.withColumns({"__a": F.when(ok, cell(lon, -180.0, 360.0, n_lon)), "__b": F.when(ok, cell(lat, -90.0, 180.0, n_lat))})
    return x.withColumn(name, F.when(F.col("__a").isNotNull(), _hash_text(F.col("__a"), F.col("__b"), precision, n_lon, n_lat)).otherwise(F.lit(blank))).drop("__a", "__b")


def apart(df: DataFrame, *columns: str) -> DataFrame:
    """df unchanged, with a step that generated code does not span: methods stay small enough for the virtual machine to compile them."""
    return df.withColumns({c: F.transform(F.array(c), lambda v: v)[0] for c in columns})


def _hash_text(a: Column, b: Column, precision: int, n_lon: int, n_lat: int) -> Column:
    letters = []
    for k in range(precision):
        value = F.lit(0).cast("long")
        for j in range(5):
            i = 5 * k + j  # even bits are the longitude's
            bit = F.shiftright(a, n_lon - 1 - i // 2) if i % 2 == 0 else F.shiftright(b, n_lat - 1 - i // 2)
            value = value + bit.bitwiseAND(1) * (1 << (4 - j))
        letters.append(F.substring(F.lit(ALPHABET), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def geohash_bounds(text: Column) -> Column:
    """(min_lat, max_lat, min_lon, max_lon) of a cell."""
    start = F.struct(F.lit(-90.0).alias("min_lat"), F.lit(90.0).alias("max_lat"), F.lit(-180.0).alias("min_lon"), F.lit(180.0).alias("max_lon"))
    bits = _bits(text)

    def halve(x: Column, p: Column) -> Column:
        mid_lat, mid_lon = (x["min_lat"] + x["max_lat"]) / 2, (x["min_lon"] + x["max_lon"]) / 2
        up, lon = p["bit"] == 1, F.pmod(p["i"], F.lit(2)) == 0
        pick = lambda on, new, old: F.when(on, new).otherwise(old)
        return F.struct(pick(~lon & up, mid_lat, x["min_lat"]).alias("min_lat"), pick(~lon & ~up, mid_lat, x["max_lat"]).alias("max_lat"), pick(lon & up, mid_lon, x["min_lon"]).alias("min_lon"), pick(lon & ~up, mid_lon, x["max_lon"]).alias("max_lon"))

    return F.aggregate(bits, start, halve)


def _bits(text: Column) -> Column:
    numbers = F.create_map(*[x for k, c in enumerate(ALPHABET) for x in (F.lit(c), F.lit(k))])
    letters = F.split(text, "")
    each = F.flatten(F.transform(letters, lambda c, i: F.transform(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(1 << (4 - j)).alias("w")) for j in range(5)]), lambda p: F.struct((i * 5 + p["j"]).alias("i"), F.pmod(F.floor(F.element_at(numbers, c) / p["w"]), F.lit(2)).alias("bit")))))
    return each


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """0 outside, 1 inside, 2 on an edge; polygon is a short literal ring of (x, y)."""
    ring = list(zip(polygon, [*polygon[1:], polygon[0]], strict=True))
    inside, edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in ring:
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        edge = edge | ((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            inside = inside + (((y >= min(y1, y2)) & (y < max(y1, y2)) & (x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)))).cast("int"))
    return F.when(edge, 2).otherwise(F.pmod(inside, F.lit(2)))


# --- covers of a polygon by geohash cells, for pruning; made on the driver from the polygon alone


def _encode(lat: float, lon: float, precision: int) -> str:
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    a = min(max(int((lon + 180) / 360 * (1 << n_lon)), 0), (1 << n_lon) - 1)
    b = min(max(int((lat + 90) / 180 * (1 << n_lat)), 0), (1 << n_lat) - 1)
    return _letters(a, b, precision)


def _letters(a: int, b: int, precision: int) -> str:
    bits = 5 * precision
    n_lon, n_lat, value = (bits + 1) // 2, bits // 2, 0
    for i in range(bits):
        value = value << 1 | ((a >> (n_lon - 1 - i // 2)) & 1 if i % 2 == 0 else (b >> (n_lat - 1 - i // 2)) & 1)
    return "".join(ALPHABET[value >> (bits - 5 - 5 * k) & 31] for k in range(precision))


def _crosses(p, q, box) -> bool:
    """Whether a segment meets a box."""
    (x1, y1), (x2, y2), (x0, y0, xe, ye) = p, q, box
    low, high = 0.0, 1.0
    for s, d, a, b in ((x1, x2 - x1, x0, xe), (y1, y2 - y1, y0, ye)):
        if d == 0:
            if s < a or s > b:
                return False
        else:
            t1, t2 = sorted(((a - s) / d, (b - s) / d))
            low, high = max(low, t1), min(high, t2)
            if low > high:
                return False
    return True


def _contains(polygon, x, y) -> bool:
    inside = False
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y1 != y2 and min(y1, y2) <= y < max(y1, y2) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


def polygon_cover(polygon: list[tuple[float, float]], precision: int = 7) -> tuple[list[str], list[str]]:
    """(cells inside, all cells that the polygon meets) of a ring of (lon, lat)."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    w, h = 360 / (1 << n_lon), 180 / (1 << n_lat)
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    inner, outer = [], []
    for a in range(int((min(xs) + 180) / w), int((max(xs) + 180) / w) + 1):
        for b in range(int((min(ys) + 90) / h), int((max(ys) + 90) / h) + 1):
            box = (a * w - 180, b * h - 90, (a + 1) * w - 180, (b + 1) * h - 90)
            if any(_crosses(p, q, box) for p, q in zip(polygon, [*polygon[1:], polygon[0]], strict=True)):
                outer.append(_letters(a, b, precision))
            elif _contains(polygon, (box[0] + box[2]) / 2, (box[1] + box[3]) / 2):
                inner.append(_letters(a, b, precision))
    return inner, sorted(inner + outer)
