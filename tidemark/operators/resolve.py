"""Resolving versions: the latest value of each key over several ordered sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first(order: str) -> list[Column]:
    """``ts``: by time, then sequence number; ``log``: by sequence number, whatever the clock said."""
    if order not in ("ts", "log"):
        raise ValueError(f"order is ts or log, not {order!r}")
    return [F.desc("ts"), F.desc("seq")] if order == "ts" else [F.desc("seq")]


def latest(log: DataFrame, order: str = "ts") -> DataFrame:
    """The last version of each key. The rank limit is applied before the shuffle and again after it, so a hot
    key sends one row per task."""
    w = Window.partitionBy("key").orderBy(*newest_first(order))
    return log.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def latest_value(log: DataFrame) -> DataFrame:
    """The same as one aggregation, for streams, where ranks are not available."""
    return log.groupBy("key").agg(F.max(F.struct("ts", "seq", "value")).alias("top")).select("key", "top.value", "top.ts", "top.seq")


def live(log: DataFrame, order: str = "ts", compat_deletes: bool = False) -> DataFrame:
    """The latest versions without deleted keys; ``compat_deletes`` reads a delete as a put of an empty value."""
    if compat_deletes:
        return latest(log.withColumn("value", F.when(F.col("op") == "delete", F.lit("")).otherwise(F.col("value"))), order)
    return latest(log, order).where("op <> 'delete'")


def as_of(log: DataFrame, ts: int, order: str = "ts") -> DataFrame:
    """The latest versions that a reader at time ts would have seen."""
    return latest(log.where(F.col("ts") <= ts), order)


def version_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.count("*").alias("versions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
