"""Degrees, minutes and seconds; UTM zones; EPSG codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dms_to_degrees(d: Column, m: Column, s: Column) -> Column:
    """Decimal degrees; the sign of the degrees holds for all three parts."""
    size = F.abs(d) + m / 60.0 + s / 3600.0
    return F.when(d < 0, -size).otherwise(size)


def degrees_to_dms(x: Column) -> Column:
    """(d, m, s) of decimal degrees, the sign on d."""
    a = F.abs(x)
    d = F.floor(a)
    m = F.floor((a - d) * 60.0)
    s = (a - d - m / 60.0) * 3600.0
    return F.struct((F.signum(x) * d).cast("int").alias("d"), m.cast("int").alias("m"), s.alias("s"))


def parse_dms(text: Column) -> Column:
    """Decimal degrees of text such as 37:58:01.3 N or -70/10/30: three numbers, and N, E, S or W or a sign. Other text is null."""
    part = F.split(F.trim(text), r"[:/ ,]+")
    number = [F.regexp_extract(F.element_at(part, k), r"(-?[0-9.]+)", 1).try_cast("double") for k in (1, 2, 3)]
    value = F.abs(number[0]) + number[1] / 60.0 + number[2] / 3600.0
    south = F.upper(text).rlike("[SW]") | F.ltrim(text).startswith("-")
    return F.when(F.size(part) >= 3, F.when(south, -value).otherwise(value))


def utm_zone(max_longitude: Column, min_latitude: Column) -> Column:
    """Zone number and hemisphere letter, from the largest longitude and the smallest latitude."""
    zone = F.ceil((max_longitude + 180.0) / 6.0)
    return F.concat(zone.cast("string"), F.when(min_latitude > 0, "N").otherwise("S"))


def epsg(datum: str, zone: int, hemisphere: str) -> int:
    """Projected code of a UTM zone on WGS84 or NAD83."""
    d = datum.upper()
    if d in ("NAD83", "NAD83(2011)", "NAD83_2011"):
        if hemisphere.upper() != "N":
            raise ValueError("NAD83 zones are northern")
        if zone <= 19:
            return 6329 + zone
        if zone in (59, 60):
            return 6328 + zone - 58
    elif d in ("WGS84", "WGS 84"):
        return (32600 if hemisphere.upper() == "N" else 32700) + zone
    raise ValueError(f"no code for {datum} zone {zone}{hemisphere}")
