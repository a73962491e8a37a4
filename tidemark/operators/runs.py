"""Immutable sorted runs: manifests, and the blocks and sizes inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import shared_prefix, varint_bytes
from .buckets import reset_cut


def manifest(rows: DataFrame) -> DataFrame:
    """One row per run of (run_id, key, ts, klen, vlen)."""
    return rows.groupBy("run_id").agg(
        F.count("*").alias("entries"),
        F.sum(F.col("klen") + F.col("vlen") + 8).alias("bytes"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
    )


def write_run(rows: DataFrame, path: str, bloom_keys: int | None = None) -> None:
    """Rows in order of key, with Parquet's own Bloom filter on the key, sized for the run."""
    out = rows.repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true")
    if bloom_keys:
        out = out.option("parquet.bloom.filter.expected.ndv#key", str(max(1, bloom_keys)))
    out.parquet(path)


def entries(rows: DataFrame, block_bytes: int = 16_384) -> DataFrame:
    """Each run's rows by key with ``block``, the prefix shared with the row before it in the block, and ``entry_bytes``.

    Blocks are cut by the running total of raw sizes within the run."""
    by_key = Window.partitionBy("run_id").orderBy("key", "seq")
    raw = F.col("klen") + F.col("vlen") + 8
    before = F.coalesce(F.sum(raw).over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("block", F.floor(before / block_bytes).cast("long"))
    last = F.lag("key").over(Window.partitionBy("run_id", "block").orderBy("key", "seq"))
    rows = rows.withColumn("shared", shared_prefix(last, F.col("key")))
    unshared = F.col("klen") - F.col("shared")
    size = varint_bytes(F.col("shared")) + varint_bytes(unshared) + varint_bytes(F.col("vlen")) + unshared + F.col("vlen") + 8
    return rows.withColumn("entry_bytes", size)


def cut_blocks(rows: DataFrame, block_bytes: int = 16_384) -> DataFrame:
    """As ``entries``, with blocks cut as a writer does: a block ends with the entry that fills it, and sizes depend on the entry before in it."""
    prefix = shared_prefix(F.lag("key").over(Window.partitionBy("run_id").orderBy("key", "seq")), F.col("key"))

    def size(shared: Column) -> Column:
        unshared = F.col("klen") - shared
        return varint_bytes(shared) + varint_bytes(unshared) + varint_bytes(F.col("vlen")) + unshared + F.col("vlen") + 8

    rows = rows.withColumn("shared", prefix)
    cut = reset_cut(rows, "run_id", ["key", "seq"], size(F.col("shared")), block_bytes, size(F.lit(0).cast("long"))).withColumnRenamed("bucket", "block")
    head = F.row_number().over(Window.partitionBy("run_id", "block").orderBy("key", "seq")) == 1
    cut = cut.withColumn("shared", F.when(head, F.lit(0)).otherwise(F.col("shared")).cast("long"))
    return cut.withColumn("entry_bytes", size(F.col("shared")))


def fences(blocks: DataFrame) -> DataFrame:
    """The index of each run: first key, entries, bytes and offset of each block, and the size of its index entry."""
    per = blocks.groupBy("run_id", "block").agg(F.min("key").alias("first_key"), F.count("*").alias("entries"), F.sum("entry_bytes").alias("bytes"))
    start = F.coalesce(F.sum("bytes").over(Window.partitionBy("run_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("offset", start.cast("long")).withColumn("index_bytes", (F.octet_length("first_key") + 14).cast("long"))


def fence_lookup(index: DataFrame, probes: DataFrame, lanes: int = 8) -> DataFrame:
    """The block of a run that may hold each probe (run_id, key): the last whose first key is not greater; null before the first.

    Fences and probes go through one window per run and lane, so there is no interval join. The probes of a run, which may be all there are,
    are dealt over ``lanes`` by their keys; its fences, one per block, go to every lane."""
    starts = index.select("run_id", F.col("first_key").alias("key"), "block", F.lit(0).alias("probe"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    asked = probes.select("run_id", "key").distinct().select("run_id", "key", F.lit(None).cast("long").alias("block"), F.lit(1).alias("probe"), F.pmod(F.xxhash64("key"), F.lit(lanes)).cast("int").alias("lane"))
    w = Window.partitionBy("run_id", "lane").orderBy("key", "probe").rowsBetween(Window.unboundedPreceding, 0)
    return starts.unionByName(asked).withColumn("block", F.last("block", ignorenulls=True).over(w)).where("probe = 1").drop("probe", "lane")


def order_audit(rows: DataFrame, position: str = "seq") -> DataFrame:
    """Per run, the rows whose key is not greater than the one written before it."""
    last = F.lag("key").over(Window.partitionBy("run_id").orderBy(position))
    return rows.withColumn("_bad", F.when(last >= F.col("key"), 1).otherwise(0)).groupBy("run_id").agg(F.count("*").alias("entries"), F.sum("_bad").cast("long").alias("out_of_order"))
