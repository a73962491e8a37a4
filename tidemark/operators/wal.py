"""The segmented operation log: rotation, replay, retention, tailing and record checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import errors
from ..functions.scalar import record_bytes
from ..schema import MAX_KEY, MAX_RECORD, RECORD_HEADER, RECORD_OVERHEAD
from .buckets import cumulative, reset_cut


def segments(log: DataFrame, limit: int) -> DataFrame:
    """Adds ``segment`` (from 1) by the running total of record sizes (klen, vlen)."""
    return cumulative(log, record_bytes(F.col("klen"), F.col("vlen")), limit).withColumn("segment", F.col("bucket") + 1).drop("bucket")


def rotated(log: DataFrame, writer: str, limit: int) -> DataFrame:
    """Adds ``segment`` (from 1) as each writer's log rotates: before a record, once the segment holds ``limit`` bytes."""
    return reset_cut(log, writer, ["seq"], record_bytes(F.col("klen"), F.col("vlen")), limit).withColumn("segment", F.col("bucket") + 1).drop("bucket")


def segment_sizes(log: DataFrame) -> DataFrame:
    return log.groupBy("segment").agg(F.count("*").alias("records"), F.sum(record_bytes(F.col("klen"), F.col("vlen"))).alias("bytes"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def closed_segments(log: DataFrame) -> DataFrame:
    """Segments before the current one, ascending."""
    current = log.agg(F.max("segment").alias("current"))
    return log.select("segment").distinct().join(F.broadcast(current), F.col("segment") < F.col("current")).select("segment").orderBy("segment")


def current_segment(log: DataFrame) -> int:
    """The segment that is written to; 1 for an empty log."""
    return log.agg(F.coalesce(F.max("segment"), F.lit(1))).first()[0]


def is_available(log: DataFrame, segment: int) -> bool:
    """Whether a segment exists and is closed."""
    return segment < current_segment(log) and not log.where(F.col("segment") == segment).isEmpty()


def read_segment(log: DataFrame, segment: int) -> DataFrame:
    """The records of one segment in order, open or closed; NotFound if there are none."""
    rows = log.where(F.col("segment") == segment)
    if rows.isEmpty():
        raise errors.NotFound(f"segment {segment}")
    return rows.orderBy("seq")


def deletable(segments: DataFrame, flushed: Column, replica: Column) -> DataFrame:
    """Segments that retention lets go: older than the flushed one, and than the slowest replica's if there is one."""
    bound = F.when(replica > 0, F.least(flushed, replica)).otherwise(flushed)
    return segments.where((flushed > 0) & (F.col("segment") < bound))


def record_state(klen: Column, vlen: Column, op: Column, intact: Column, present: Column | None = None) -> Column:
    """ok; clean_eof: less than a header is there, the segment ends; fatal: part of the body is missing, or the op is unknown, and opening the log fails;
    stop: replay of the segment ends at a wrong checksum; too_large: refused when written. ``present`` is how many of the record's bytes the segment holds."""
    size = klen + vlen + RECORD_OVERHEAD
    state = F.when((klen > MAX_KEY) | (size > MAX_RECORD), "too_large")
    if present is not None:
        state = state.when(present < RECORD_HEADER, "clean_eof").when(present < record_bytes(klen, vlen), "fatal")
    return state.when(~intact, "stop").when(~op.isin(1, 2), "fatal").otherwise("ok")


def replay(log: DataFrame, bad: Column) -> DataFrame:
    """Records before the first bad one of their segment; later segments go on. The first bad ones are one row per segment."""
    firsts = log.where(bad).groupBy("segment").agg(F.min("seq").alias("_bad"))
    return log.join(firsts, "segment", "left").where("_bad IS NULL OR seq < _bad").drop("_bad")


def replica_lag(log: DataFrame, replicas: DataFrame) -> DataFrame:
    """Per replica (replica, last_synced): closed segments and records that it still has to fetch, and the next one."""
    sizes = log.groupBy("segment").agg(F.count("*").alias("records"))
    current = sizes.agg(F.max("segment").alias("current"))
    closed = sizes.join(F.broadcast(current), F.col("segment") < F.col("current"))
    # both sides have a row per segment or replica, not per record
    due = replicas.join(closed, F.col("segment") > F.col("last_synced"), "left")
    return due.groupBy("replica", "last_synced").agg(F.count("segment").alias("segments_behind"), F.coalesce(F.sum("records"), F.lit(0)).alias("records_behind"), F.min("segment").alias("next_segment"))


def sync_step(last_synced: int, closed: list[int], failures: int, ok: bool = True, backoff_s: int = 1) -> tuple[int, bool, int, int]:
    """One step of a replica: (last synced, whether a segment was fetched, failures, seconds to wait)."""
    due = [s for s in closed if s > last_synced]
    if not due:
        return last_synced, False, failures, 0
    if not ok:
        return last_synced, False, failures + 1, backoff_s * (failures + 1)
    return min(due), True, 0, 0
