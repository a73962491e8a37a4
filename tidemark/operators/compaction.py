"""Size-tiered compaction: which runs to merge, the merge, and what it saves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolve import latest


def merge(runs: DataFrame) -> DataFrame:
    """The newest version of each key over all rows of the runs."""
    return latest(runs)


def merge_stats(runs: DataFrame, size: Column) -> DataFrame:
    """inputs, entries merged, duplicates removed, bytes in and out, savings: one row, by one aggregation per key.

    ``size`` is the size of a row; of each key the newest row stays."""
    rows = runs.withColumn("_size", size)
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("_size").alias("all"), F.max(F.struct("ts", "seq", "_size")).alias("top"))
    inputs = runs.agg(F.countDistinct("run_id").alias("inputs"))
    sums = keys.agg(F.count("*").alias("entries_merged"), F.sum(F.col("n") - 1).alias("duplicates_removed"), F.sum("all").alias("bytes_in"), F.sum("top._size").alias("bytes_out"))
    return inputs.join(sums, F.lit(True)).withColumn("savings", F.when(F.coalesce("bytes_in", F.lit(0)) == 0, F.lit(0.0)).otherwise(1 - F.col("bytes_out") / F.col("bytes_in")))


def tier_groups(files: DataFrame, least: int = 4, group: str = "grp", ratio: float = 1.5) -> DataFrame:
    """For each anchor the files of its manifest (``group``) from it upwards in size that are at most ratio times as large.

    Files are (group, run_id, bytes). Sizes are put in bands of that ratio; an anchor's files lie in its own band or the
    next, so the range becomes an equi-join."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy("bytes", "run_id"))
    files = files.withColumn("rank", rank).withColumn("band", F.when(F.col("bytes") > 0, F.floor(F.log(F.col("bytes").cast("double")) / math.log(ratio))).otherwise(F.lit(-1)).cast("long"))
    # one band of slack on either side covers rounding of the logarithm
    anchors = files.select(group, F.col("run_id").alias("anchor"), F.col("bytes").alias("anchor_bytes"), F.col("rank").alias("anchor_rank"), F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1, 2)])).alias("band"))
    near = anchors.join(files, [group, "band"]).where("rank >= anchor_rank").where(F.col("bytes") <= ratio * F.col("anchor_bytes"))
    return near.groupBy(group, "anchor", "anchor_rank").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sort_array(F.collect_list("run_id")).alias("members")).where(F.col("files") >= least)


def tier_pick(files: DataFrame, least: int = 4, group: str = "grp") -> DataFrame:
    """The largest group of each manifest, the first by size among equals."""
    w = Window.partitionBy(group).orderBy(F.desc("files"), "anchor_rank")
    return tier_groups(files, least, group).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
