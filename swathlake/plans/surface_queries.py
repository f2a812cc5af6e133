"""Queries on surfaces, with the same statement in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid
from . import stand_ins as S


def mean_depth_surface(spark, sf_dir):
    """Mean and shoalest depth of the accepted soundings in each cell."""
    s = S.soundings(spark, sf_dir).where("detectioninfo <> 2")
    return grid.surface(s, 8192.0, 1024.0).select("cell_x", "cell_y", "density", F.bround("depth", 6).alias("depth"), "shoalest")


QUERIES = {"mean_depth_surface": mean_depth_surface}
ORACLES = {
    "mean_depth_surface": """
        SELECT CAST(floor(l_extendedprice / 8192) AS BIGINT) AS cell_x, CAST(floor(l_orderkey / 1024) AS BIGINT) AS cell_y,
               count(*) AS density, round_even(avg(l_quantity), 6) AS depth, min(l_quantity) AS shoalest
        FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2""",
}
