"""Point and batch lookups, key ranges, and reads over ranked sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolve import latest


def in_range(lo, hi, inclusive: bool = False, key: str = "key") -> Column:
    """lo <= key < hi, or <= hi. The key should be a stored column, so that the range reaches the scan."""
    if lo > hi:
        raise ValueError("range start is greater than range end")
    upper = F.col(key) <= hi if inclusive else F.col(key) < hi
    return (F.col(key) >= lo) & upper


def point_get(log: DataFrame, key, order: str = "ts") -> DataFrame:
    """The latest version of one key, or no row."""
    return latest(log.where(F.col("key") == key), order)


def multi_get(log: DataFrame, keys: DataFrame, order: str = "ts") -> DataFrame:
    """A row for each wanted key; ``found`` tells hits from misses. Spark broadcasts the keys if they are few."""
    wanted = keys.select("key").distinct()
    got = latest(log.join(wanted, "key", "left_semi"), order)
    return wanted.join(got.withColumn("found", F.lit(True)), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def scan(log: DataFrame, lo, hi, inclusive: bool = False, order: str = "ts") -> DataFrame:
    """The latest version of each key in a range, in order of key."""
    return latest(log.where(in_range(lo, hi, inclusive)), order).orderBy("key")


def ranked(sources: list[DataFrame]) -> DataFrame:
    """Sources in the order in which they are asked, as one table."""
    return reduce(DataFrame.unionByName, [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)])


def tiered_get(sources: DataFrame, keys: DataFrame) -> DataFrame:
    """The version of each wanted key in the first source that has the key, whatever its time."""
    w = Window.partitionBy("key").orderBy("source_rank", F.desc("seq"))
    hits = sources.join(keys.select("key").distinct(), "key", "left_semi")
    return hits.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def tiered_scan(sources: DataFrame, lo, hi, inclusive: bool = False) -> DataFrame:
    """The version with the greatest time of each key in a range; the first source wins among equals."""
    w = Window.partitionBy("key").orderBy(F.desc("ts"), "source_rank", F.desc("seq"))
    rows = sources.where(in_range(lo, hi, inclusive))
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth").orderBy("key")
