"""Cutting an ordered table into buckets of about equal size.

Functions that differ: ``cumulative`` numbers buckets by the running total, which parallel tasks can compute;
``reset_cut`` starts each bucket at zero again once it is full, and ``resetting`` besides charges overwritten keys the difference
only, which makes them sequential within a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import digest
from ..session import ship


def cumulative(rows: DataFrame, size: Column, limit: int, seq: str = "seq", shard: int = 1 << 18) -> DataFrame:
    """Adds ``bucket``: the total size of all rows before (by seq) divided by the limit.

    Running totals are taken within shards of ``shard`` sequence numbers, and the shards' own totals are added to them: no
    window spans more than a shard's rows, or one row per shard."""
    rows = rows.withColumn("_size", size).withColumn("_shard", F.floor(F.col(seq) / shard))
    before = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = rows.groupBy("_shard").agg(F.sum("_size").alias("_total")).select("_shard", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_shard").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(shards, "_shard")
    return rows.withColumn("bucket", F.floor((F.col("_start") + F.col("_before")) / limit).cast("long")).drop("_size", "_shard", "_before", "_start")


def reset_cut(rows: DataFrame, shard: str, order: list[str], size: Column, limit: int, first: Column | None = None) -> DataFrame:
    """Adds ``bucket``: within each shard (a whole number), in order, a bucket ends with the row that fills it to the limit.

    ``size`` is a row's size, ``first`` that of a bucket's first row where it differs; both are greater than 0. A task streams its shards
    in Arrow batches and holds no more than one; within a batch it jumps from cut to cut."""
    dealt = rows.withColumns({"_size": size.cast("long"), "_first": (size if first is None else first).cast("long")})
    dealt = dealt.repartition(F.col(shard)).sortWithinPartitions(shard, *order)
    at, schema = rows.columns.index(shard), T.StructType([*rows.schema.fields, T.StructField("bucket", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, used = None, 0, 0
        for b in batches:
            shards, sizes, firsts = (b.column(i).to_numpy() for i in (at, len(schema) - 1, len(schema)))
            total = np.cumsum(sizes)
            out = np.empty(len(b), np.int64)
            ends = [*(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(b)]
            i = 0
            for end in ends:
                if shards[i] != current:
                    current, number, used = shards[i], 0, 0
                while i < end:
                    # what the bucket holds apart from the running total
                    extra = (used or int(firsts[i] - sizes[i])) - int(total[i] - sizes[i])
                    cut = min(i + int(np.searchsorted(total[i:end] + extra, limit)), end)
                    full = cut < end
                    out[i : cut + full] = number
                    used = 0 if full else int(total[end - 1]) + extra
                    number += full
                    i = cut + full
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out)], schema.names)

    ship(rows.sparkSession)
    return dealt.mapInArrow(run, schema)


def resetting(rows: DataFrame, limit: int, shards: int = 8) -> DataFrame:
    """(shard, run, entries, bytes, min_key, max_key, closed) of the runs that memory tables of ``limit`` bytes leave behind.

    Rows have seq, key, klen and vlen. Keys are dealt over shards, each with a memory table of its own, of which there should be at least as many as
    tasks; a task streams its shards in order of seq and holds one table's keys at most."""
    dealt = rows.withColumn("shard", F.pmod(digest(F.col("key")), F.lit(shards)).cast("long")).select("shard", "seq", "key", "klen", "vlen")
    dealt = dealt.repartition(F.col("shard")).sortWithinPartitions("shard", "seq")
    schema = T.StructType.fromDDL("shard long, run long, entries long, bytes long, min_key string, max_key string, closed boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, int] = {}
        shard, number, used, out = None, 0, 0, []

        def close(full: bool) -> None:
            out.append((shard, number, len(table), used, min(table), max(table), full))
            table.clear()

        for b in batches:
            for s, _, key, klen, vlen in zip(*(c.to_pylist() for c in b.columns)):
                if s != shard:
                    if table:
                        close(False)
                    shard, number, used = s, 0, 0
                # a key with an empty value counts as new
                old = table.get(key, 0)
                used += vlen - old if old else klen + vlen + 48
                table[key] = vlen
                if used >= limit:
                    close(True)
                    number, used = number + 1, 0
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], _types)
                out.clear()
        if table:
            close(False)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], _types)

    ship(rows.sparkSession)
    return dealt.mapInArrow(run, schema)


_types = pa.schema([("shard", pa.int64()), ("run", pa.int64()), ("entries", pa.int64()), ("bytes", pa.int64()), ("min_key", pa.string()), ("max_key", pa.string()), ("closed", pa.bool_())])
