"""The nearest of some positions, found in a tree that every task holds: no cell is hot, and rows stay where they are.

Positions are split at medians into boxes of a few; a batch of points goes down the tree together, and a box is entered
only by those points whose best so far lies farther than the box does. Exact, ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
LEAF = 32
#: Positions that a tree may hold in each task (32 bytes each), counted first.
MOST = 500_000


def km(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Haversine distances of arrays in degrees."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin((np.radians(lon2) - np.radians(lon1)) / 2) ** 2
    return np.arcsin(np.sqrt(np.minimum(h, 1.0))) * (2 * RADIUS_KM)


def _on_sphere(lon, lat) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=1)


class Tree:
    """lon, lat: arrays in degrees, in ascending order of their ids; places are numbers in these."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray):
        self.lon, self.lat, self.xyz = lon, lat, _on_sphere(lon, lat)
        self.root = self._split(np.arange(len(lon)))

    def _split(self, rows: np.ndarray) -> tuple:
        p = self.xyz[rows]
        box = (p.min(0), p.max(0)) if len(rows) else (np.zeros(3), np.zeros(3))
        axis = int((box[1] - box[0]).argmax())
        if len(rows) <= LEAF or box[0][axis] == box[1][axis]:
            return box, np.sort(rows), None, None
        order = rows[np.argsort(p[:, axis], kind="stable")]
        half = len(order) // 2
        return box, None, self._split(order[:half]), self._split(order[half:])

    def nearest(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """The place of the nearest to each point, -1 where a coordinate is not a number."""
        best, place = np.full(len(lon), np.inf), np.full(len(lon), -1)
        at = _on_sphere(lon, lat)
        if len(self.lon):
            self._visit(self.root, np.flatnonzero(np.isfinite(at).all(1)), at, lon, lat, best, place)
        return place

    def _away(self, node: tuple, at: np.ndarray) -> np.ndarray:
        """Kilometres that the box lies away at least."""
        low, high = node[0]
        chord = np.sqrt((np.maximum(np.maximum(low - at, at - high), 0.0) ** 2).sum(1))
        return 2 * RADIUS_KM * np.arcsin(np.minimum(chord / 2, 1.0)) * (1 - 1e-9) - 1e-6

    def _visit(self, node: tuple, rows, at, lon, lat, best, place) -> None:
        _, own, left, right = node
        if own is not None:
            for part in np.array_split(rows, max(1, len(rows) * len(own) // 2_000_000)):
                d = km(lon[part, None], lat[part, None], self.lon[own], self.lat[own])
                k = d.argmin(1)
                least, who = d[np.arange(len(part)), k], own[k]
                better = (least < best[part]) | ((least == best[part]) & (who < place[part]))
                best[part[better]], place[part[better]] = least[better], who[better]
            return
        a, b = self._away(left, at[rows]), self._away(right, at[rows])
        for first, second, some in ((left, right, a <= b), (right, left, a > b)):
            if some.any():
                these = rows[some]
                self._visit(first, these[self._away(first, at[these]) <= best[these]], at, lon, lat, best, place)
                these = these[self._away(second, at[these]) <= best[these]]
                if len(these):
                    self._visit(second, these, at, lon, lat, best, place)


def _with_place(points: DataFrame, find, kind: str, name: str) -> DataFrame:
    """points with a column of what find(batch) gives for each, an Arrow array."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, find(b)], [*b.schema.names, name])

    ddl = ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(add, f"{ddl}, `{name}` {kind}")


def _ids(values: list, kind: str) -> pa.Array:
    return pa.array(values, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}.get(kind))


def _numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def in_space(points: DataFrame, places: list[tuple], kind: str, name: str) -> DataFrame:
    """points (lat, lon, ...) with the id of the nearest of some places (id, lat, lon), null where a coordinate is."""
    first = {}
    for i, lat, lon in sorted(places):
        first.setdefault((lat, lon), i)  # the smallest id of a position
    ids = _ids(list(first.values()), kind)
    lat, lon = (np.array([p[k] for p in first], float) for k in (0, 1))
    sent = points.sparkSession.sparkContext.broadcast((ids, lon, lat))
    kept: list[Tree] = []

    def find(b: pa.RecordBatch) -> pa.Array:
        ids, lon, lat = sent.value
        if not kept:
            kept.append(Tree(lon, lat))
        k = kept[0].nearest(_numbers(b, "lon"), _numbers(b, "lat"))
        return ids.take(pa.array(k, pa.int64(), mask=k < 0)) if len(ids) else pa.nulls(b.num_rows, ids.type)

    return _with_place(points, find, kind, name)


def in_space_and_time(points: DataFrame, places: list[tuple], seconds: float, kind: str, name: str) -> DataFrame:
    """points (time, lat, lon, ...) with the id of the nearest of the places (id, lat, lon, time) that are at most so many seconds away; null where there is none."""
    rows = sorted(places, key=lambda p: p[3])
    ids = _ids([p[0] for p in rows], kind)
    lat, lon, when = (np.array([p[k] for p in rows], float) for k in (1, 2, 3))
    rank = np.empty(len(rows), np.int64)
    rank[sorted(range(len(rows)), key=lambda k: rows[k][0])] = np.arange(len(rows))
    sent = points.sparkSession.sparkContext.broadcast((ids, lat, lon, when, rank))

    def find(b: pa.RecordBatch) -> pa.Array:
        ids, lat, lon, when, rank = sent.value
        t, y, x = (_numbers(b, c) for c in ("time", "lat", "lon"))
        low, high = np.searchsorted(when, t - seconds, "left"), np.searchsorted(when, t + seconds, "right")
        ok = np.isfinite(t) & np.isfinite(x) & np.isfinite(y)
        n = np.where(ok, high - low, 0)
        out, at = np.full(len(t), -1), 0
        while at < len(t):  # as many points at once as have two million pairs
            to = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), 2_000_000, "right")) + at)
            m = n[at:to]
            if m.sum():
                row = np.repeat(np.arange(at, to), m)
                k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[at:to], m)
                d = km(x[row], y[row], lon[k], lat[k])
                order = np.lexsort((rank[k], d, row))
                first = order[np.append(True, row[order][1:] != row[order][:-1])]
                out[row[first]] = k[first]
            at = to
        return ids.take(pa.array(out, pa.int64(), mask=out < 0)) if len(ids) else pa.nulls(b.num_rows, ids.type)

    return _with_place(points, find, kind, name)


def held(places: DataFrame, columns: list[str], most: int | None = None) -> list[tuple] | None:
    """The rows with all of the columns, if they are few enough to be sent to every task; else None."""
    x = places.select(*columns).dropna()
    if x.count() > (MOST if most is None else most):
        return None
    return [tuple(r) for r in x.select(columns[0], *[F.col(c).cast("double") for c in columns[1:]]).collect()]
