"""Sounding filters: named, with described parameters; each gives a new detection flag as a column expression."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series
from .subset import REACCEPTED, REJECTED, set_where


@dataclass
class Filter:
    name: str
    description: str
    flag: Callable[..., Column]
    controls: list[tuple[str, str, object]] = field(default_factory=list)  # (type, name, default)


class Registry:
    """Filters by name; files in a folder can add theirs with a function `register(registry)`."""

    def __init__(self):
        self._filters: dict[str, Filter] = {}

    def add(self, f: Filter) -> None:
        self._filters[f.name] = f

    def load(self, folder: str) -> None:
        for path in sorted(Path(folder).glob("*.py")):
            spec = importlib.util.spec_from_file_location(path.stem, path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            module.register(self)

    def names(self) -> list[str]:
        return sorted(self._filters)

    def descriptions(self) -> dict[str, str]:
        return {k: f.description for k, f in self._filters.items()}

    def controls(self, name: str) -> list:
        return self._filters[name].controls

    def clear(self) -> None:
        self._filters.clear()

    def run(self, soundings: DataFrame, name: str, where: Column | None = None, flag: str = "detectioninfo", **parameters) -> DataFrame:
        """soundings with the filter's flag, only where `where` holds if it is given."""
        f = self._filters[name]
        known = {n: d for _, n, d in f.controls}
        if unknown := set(parameters) - set(known):
            raise ValueError(f"{name} has no parameter {sorted(unknown)}")
        new = f.flag(F.col(flag), **(known | parameters))
        return set_where(soundings, flag, where if where is not None else F.lit(True), new)


def _outside(value: Column, low: float | None, high: float | None) -> Column:
    """A bound of 0 counts; None is no bound."""
    out = F.lit(False)
    if low is not None:
        out = out | (value < low)
    return out | (value > high) if high is not None else out


def by_angle(flag: Column, min_angle: float | None = None, max_angle: float | None = None, angle: str = "corr_pointing_angle") -> Column:
    return F.when(_outside(F.degrees(F.col(angle).cast("double")), min_angle, max_angle), REJECTED).otherwise(flag)


def by_depth(flag: Column, min_depth: float | None = None, max_depth: float | None = None, depth: str = "z") -> Column:
    return F.when(_outside(F.col(depth), min_depth, max_depth), REJECTED).otherwise(flag)


def reaccept(flag: Column) -> Column:
    return F.when(flag == REJECTED, REACCEPTED).otherwise(flag)


def reject_all(flag: Column) -> Column:
    return F.lit(REJECTED)


def second_return(flag: Column, percent_depth: float = 90.0, nadir_min: str = "nadir_min", depth: str = "z") -> Column:
    """Rejects what lies deeper than a share of twice the running least nadir depth (see rolling_nadir)."""
    return F.when(F.col(depth) > F.col(nadir_min) * (2 * percent_depth / 100.0), REJECTED).otherwise(flag)


def rolling_nadir(soundings: DataFrame, system: str = "system", time: str = "time", beam: str = "beam", depth: str = "z", pings: int = 10, day: float = 86_400.0) -> DataFrame:
    """Adds nadir_min: the least nadir depth of `pings` pings up to each; the first ones get the first full window's."""
    middle = soundings.groupBy(F.col(system)).agg((F.max(beam) + 1).alias("__n")).withColumn("__nadir", F.greatest(F.floor(F.col("__n") / 2 - 1), F.lit(0)))
    n = soundings.join(middle, system).where(F.col(beam) == F.col("__nadir")).groupBy(system, time).agg(F.min(depth).alias("d"))
    w = Window.partitionBy(system, "__block").orderBy("__k").rowsBetween(1 - pings, 0)
    n = series.consecutive(n, pings - 1, 0, system, time).withColumn("m", F.min("d").over(w)).where("__own")
    first = n.where(F.col("__k") == pings - 1).select(system, F.col("m").alias("first"))  # a row a system
    n = n.join(first, system, "left").select(system, time, F.when(F.col("__k") < pings - 1, F.col("first")).otherwise(F.col("m")).alias("nadir_min"))
    return soundings.join(n, [system, time], "left")


REGISTRY = Registry()
REGISTRY.add(Filter("filter_by_angle", "Reject soundings outside a range of beam angles in degrees", by_angle, [("float", "min_angle", None), ("float", "max_angle", None)]))
REGISTRY.add(Filter("filter_by_depth", "Reject soundings outside a range of depths", by_depth, [("float", "min_depth", None), ("float", "max_depth", None)]))
REGISTRY.add(Filter("reaccept_rejected", "Accept rejected soundings again", reaccept))
REGISTRY.add(Filter("reject_all", "Reject every sounding", reject_all))
REGISTRY.add(Filter("second_return", "Reject second returns by the running least nadir depth", second_return, [("float", "percent_depth", 90.0)]))
