"""The planner: from tables of files, datasets, casts, navigation and surfaces to the ordered queue of actions.

Actions are rows; what an action needs first are rows too, and its rank is one more than the greatest rank of those. A new
plan is held against the queue: only actions that are new or whose content changed are made anew, running ones stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import datasets as D
from ..operators.tables import kept
from . import control

#: Types of actions and their priorities, the smallest first.
PRIORITY = {"multibeam": 1, "navigation": 2, "svp": 3, "processing": 5, "gridding": 10}
COLUMNS = ["id", "type", "priority", "target", "inputs", "content"]


def _action(df: DataFrame, kind: str, target: str, inputs: str, content=None) -> DataFrame:
    """One action a target: its inputs in order, and the content that makes it another one when it changes."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(inputs)))) if dict(df.dtypes)[inputs].startswith("array") else F.sort_array(F.collect_set(inputs))
    x = df.groupBy(F.col(target).cast("string").alias("target")).agg(names.alias("inputs"), F.max(content if content is not None else F.lit("")).alias("extra"))
    x = x.select(F.concat_ws(":", F.lit(kind), "target").alias("id"), F.lit(kind).alias("type"), F.lit(PRIORITY[kind]).alias("priority"), "target", "inputs", "extra")
    return x.withColumn("content", F.sha2(F.concat_ws("|", "extra", *[F.concat_ws(",", "inputs")]), 256)).select(*COLUMNS)


def multibeam(files: DataFrame, converted: DataFrame, datasets: DataFrame) -> DataFrame:
    """A conversion for each dataset with files (name, size, model, serial, start) that were not converted yet (name, size). Files go to the dataset of their serial number and day, or to a new one."""
    new = D.new_files(files, converted)
    return _action(D.grouped_files(new, datasets), "multibeam", "dataset", "name")


def navigation(matches: DataFrame, held: DataFrame) -> DataFrame:
    """An import for each dataset with matched navigation files (dataset, file) that it doesn't hold (dataset, file)."""
    return _action(matches.join(held.select("dataset", "file").distinct(), ["dataset", "file"], "left_anti"), "navigation", "dataset", "file")


def svp(casts: DataFrame, held: DataFrame, datasets: DataFrame) -> DataFrame:
    """An import for each dataset that lacks a cast (digest, file) of the project, whatever its day."""
    return _action(D.casts_to_import(casts.withColumnRenamed("file", "cast"), held, datasets), "svp", "dataset", "cast")


def processing(datasets: DataFrame, reprocess: str | None = None) -> DataFrame:
    """A run for each dataset (status and the flags of control.stages_to_run()) with stages to do; `reprocess` names one that is done from the start."""
    x = datasets.withColumn("status", F.when(F.col("dataset") == reprocess, 1).otherwise(F.col("status"))) if reprocess is not None else datasets
    x = control.stages_to_run(x).where("stages <> ''")
    return _action(x.withColumn("__in", F.split("stages", ",")), "processing", "dataset", "__in", F.col("first").cast("string"))


def gridding(dataset_lines: DataFrame, surface_lines: DataFrame) -> DataFrame:
    """An update for each surface (surface, container, line, added) with lines of its containers that are new, were processed since or are gone from their dataset."""
    out = control.stale_lines(dataset_lines, surface_lines.select("container", "line", "added").distinct()).where("state <> 'current'")
    lines = surface_lines.select("surface", "container").distinct().join(out, "container")
    return _action(lines.withColumn("__in", F.concat_ws("/", "container", "line", "state")), "gridding", "surface", "__in")


def needs(actions: DataFrame, containers: DataFrame | None = None) -> DataFrame:
    """(id, needed): imports need the conversion of their dataset, processing needs all of these, a surface the processing of its containers (surface, container)."""
    a = actions.select("id", "type", "target")
    b = actions.select(F.col("id").alias("needed"), F.col("type").alias("t"), F.col("target").alias("on"))
    own = a.join(b, F.col("target") == F.col("on")).where(((F.col("type").isin("navigation", "svp")) & (F.col("t") == "multibeam")) | ((F.col("type") == "processing") & F.col("t").isin("multibeam", "navigation", "svp"))).select("id", "needed")
    if containers is None:
        return own
    g = a.where("type = 'gridding'").join(containers.select(F.col("surface").cast("string").alias("target"), F.col("container").cast("string").alias("on")).distinct(), "target")
    return own.unionByName(g.join(b.where("t <> 'gridding'"), "on").select("id", "needed"))


def ranked(actions: DataFrame, needs_: DataFrame, most: int = 50) -> DataFrame:
    """actions with rank: 0 where nothing is needed first, else one more than the greatest of what is. A circle raises ValueError."""
    edges = needs_.join(actions.select("id"), "id", "left_semi").join(actions.select(F.col("id").alias("needed")), "needed", "left_semi").distinct()
    left, rank, k = kept(edges), actions.select("id", F.lit(0).alias("rank")), 0
    while not left.isEmpty():
        k += 1
        if k > most:
            raise ValueError("actions need each other in a circle")
        waiting = left.select("id").distinct()  # not of a rank below k
        rank = rank.join(waiting.withColumn("w", F.lit(True)), "id", "left").select("id", F.when(F.col("w"), k).otherwise(F.col("rank")).alias("rank"))
        left = kept(left.join(waiting.withColumnRenamed("id", "needed"), "needed", "left_semi").select("id", "needed"))
    return actions.join(rank, "id")


def changes(plan: DataFrame, queue: DataFrame) -> DataFrame:
    """(id, change): against the waiting queue (id, content, running), an action is new, changed, kept or gone; running ones are running, whatever the plan says."""
    q = queue.select("id", F.col("content").alias("old"), F.coalesce("running", F.lit(False)).alias("running"))
    x = plan.select("id", "content").join(q, "id", "full")
    change = F.when(F.col("running"), "running").when(F.col("old").isNull(), "new").when(F.col("content").isNull(), "gone").when(F.col("old") == F.col("content"), "kept").otherwise("changed")
    return x.select("id", change.alias("change"))


def queued(plan: DataFrame, queue: DataFrame, needs_: DataFrame | None = None) -> DataFrame:
    """The new queue in order: place, id, type, priority, rank, change. What is gone has left it."""
    plan = kept(plan)
    x = ranked(plan, needs_ if needs_ is not None else needs(plan)).join(changes(plan, queue), "id")
    place = F.row_number().over(Window.orderBy("rank", "priority", "id"))  # the queue of a project: a row an action
    return x.select(place.alias("place"), "id", "type", "priority", "rank", "change")


def chosen_crs(datasets: DataFrame, epsg: int | None = None, force_common: bool = False) -> DataFrame:
    """(dataset, epsg, why): the project's own code, or else the one most datasets have, or else the UTM zone of each dataset's greatest longitude and least latitude. datasets: dataset, epsg, max_lon, min_lat."""
    zone = F.least(F.ceil((F.col("max_lon") + 180.0) / 6.0), F.lit(60))
    auto = (F.when(F.col("min_lat") > 0, 32600).otherwise(32700) + zone).cast("long")
    if epsg is not None:
        return datasets.select("dataset", F.lit(epsg).cast("long").alias("epsg"), F.lit("given").alias("why"))
    if force_common:
        one = D.most_common(datasets, "epsg").select(F.col("epsg").alias("__common"))
        x = datasets.join(F.broadcast(one), F.lit(True), "left")
        return x.select("dataset", F.coalesce(F.col("__common").cast("long"), auto).alias("epsg"), F.when(F.col("__common").isNull(), "zone").otherwise("common").alias("why"))
    return datasets.select("dataset", auto.alias("epsg"), F.lit("zone").alias("why"))
