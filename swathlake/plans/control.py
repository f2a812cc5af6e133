"""Which stages must run again, and the order of waiting actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("orientation", "beam_vectors", "sound_velocity", "georeference", "uncertainty")


def next_stages(status: int, *, crs: bool = False, datum: bool = False, reference: bool = False, offsets: bool = False, angles: bool = False, waterline: bool = False, tpu: bool = False, mode: str = "normal") -> tuple[str, ...]:
    """Stages to run from a dataset's least status and what changed in its settings."""
    if mode == "convert_only":
        return ()
    if mode in ("reprocess", "concatenate"):
        status = 1
    placed = crs or datum or reference or offsets or angles or waterline
    first = 5
    if status < 5 or placed or tpu:
        first = 4
    if status < 4 or placed:
        first = 3
    if status < 3 or offsets or angles or waterline:
        first = 2
    if status < 2 or angles:
        first = 0
    return STAGES[first:]


def stages_to_run(datasets: DataFrame) -> DataFrame:
    """datasets (status, and the flags crs, datum, reference, offsets, angles, waterline, tpu of what changed) with `first`, the number of the first stage that must run again (5: none), and `stages`, the names from there on."""
    c = {k: F.coalesce(F.col(k), F.lit(False)) for k in ("crs", "datum", "reference", "offsets", "angles", "waterline", "tpu")}
    placed = c["crs"] | c["datum"] | c["reference"] | c["offsets"] | c["angles"] | c["waterline"]
    s = F.col("status")
    first = F.when((s < 2) | c["angles"], 0).when((s < 3) | c["offsets"] | c["waterline"], 2).when((s < 4) | placed, 3).when((s < 5) | c["tpu"], 4).otherwise(5)
    names = F.array(*map(F.lit, STAGES))
    return datasets.withColumn("first", first).withColumn("stages", F.array_join(F.slice(names, F.col("first") + 1, len(STAGES)), ","))


def next_action(actions: DataFrame) -> DataFrame:
    """The waiting action of the smallest priority number; ties to the earlier."""
    return actions.orderBy("priority", "created", "id").limit(1)


def stale_lines(dataset_lines: DataFrame, surface_lines: DataFrame) -> DataFrame:
    """Lines of datasets against those in a surface: new, stale (processed after they were added), current or removed."""
    x = dataset_lines.select("container", "line", "processed").join(surface_lines.select("container", "line", "added"), ["container", "line"], "full")
    state = F.when(F.col("added").isNull(), "new").when(F.col("processed").isNull(), "removed").when(F.col("processed") > F.col("added"), "stale").otherwise("current")
    return x.select("container", "line", state.alias("state"))
