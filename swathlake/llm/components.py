"""Connected components of a table of links, by contraction: every round maps each node to its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link to another; links: (a, b) of one comparable type.

    Node names should be hashes: then a round leaves a fraction of the nodes, and few rounds are needed. Minima are
    taken before shuffling, and joins meet one row a node, so a hot node is split by adaptive execution. Nulls and links
    of a node to itself count for nothing; without links there are no rows.
    """
    e = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")), "contraction")
        maps.append(m)
        x = e.join(m.withColumnsRenamed({"node": "a", "to": "a2"}), "a").join(m.withColumnsRenamed({"node": "b", "to": "b2"}), "b")
        e = written(x.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    out = maps[0].select("node", F.col("to").alias("root"))
    for m in maps[1:]:
        step = m.select(F.col("node").alias("root"), "to")
        out = out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
