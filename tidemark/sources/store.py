"""A durable store on shared files: a segmented log, sorted runs, and a manifest that is swapped whole.

Everything is Parquet under one folder, so any Spark job can read it. A manifest is a folder named by a number higher than
the one before and by the last sequence number that runs hold; readers take the highest that its writer finished, so a lost job leaves no
half-made state. A writer claims the next number with a file that must not exist, so of two writers one fails with ``Conflict``
and neither overwrites the other. The log has a folder per segment; cleaning up deletes whole segments, one by one.

Versions are ordered by sequence number, which the store hands out. In memory the last put of a key counts, whatever the
clock said, as it does in the run that a flush makes of it; among sources a scan and a compaction take the greatest time.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors
from ..functions.scalar import memory_bytes, record_bytes
from ..operators import compaction, lookup, metrics, resolve, wal
from ..operators.runs import write_run
from ..schema import MANIFEST, MAX_KEY, MAX_RECORD, OPLOG, RECORD_OVERHEAD, schema


class Store:
    """put, delete, get, scan, flush, compact, stats over a folder."""

    def __init__(self, spark: SparkSession, path: str, memtable_bytes: int = 4 << 20, segment_bytes: int = 100 << 20, buffer_rows: int = 10_000, compaction_on: bool = True, least_runs: int = 4, clock: Callable[[], float] = time.time):
        self.spark, self.path = spark, path.rstrip("/")
        self.memtable_bytes, self.segment_bytes, self.buffer_rows = memtable_bytes, segment_bytes, buffer_rows
        self.compaction_on, self.least_runs, self.clock = compaction_on, least_runs, clock
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buffer: list[tuple] = []
        self.started, self.compacted_at = clock(), float("-inf")
        self.counts = dict.fromkeys(("writes_total", "writes_bytes", "reads_total", "reads_hits", "reads_misses", "flushes_total", "compactions_total", "bytes_in", "bytes_out"), 0)
        self.latency = {k: metrics.Histogram() for k in ("write", "read", "flush")}
        last = self.log().agg(F.max("seq"), F.max("segment")).first()
        self.next_seq = max(last[0] or 0, self._flushed()) + 1
        # a reopened log goes on in a segment of its own
        self.segment, self.segment_used = (last[1] or 0) + 1, 0
        self.unflushed = self._pending_bytes()

    # files

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(folder))) if self.fs.exists(self._at(folder)) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names("manifest") if self.fs.exists(self._at("manifest", n, "_SUCCESS"))]

    def manifest(self) -> DataFrame:
        versions = self._manifests()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{versions[-1]}") if versions else self.spark.createDataFrame([], MANIFEST)

    def _version(self) -> int:
        """The highest number of a manifest, finished or claimed."""
        return max([int(n.partition("-")[0]) for n in self._names("manifest")], default=0)

    def _commit(self, after: int, rows: DataFrame, flushed: int) -> None:
        """Write the manifest that follows number ``after``; Conflict if another writer has claimed it."""
        number = f"{after + 1:012d}"
        try:
            if self._version() > after:
                raise errors.Conflict(f"manifest {number} is taken")
            self.fs.create(self._at("manifest", f"{number}-claim"), False).close()
        except Py4JJavaError as e:
            raise errors.Conflict(f"manifest {number} is taken") from e
        rows.coalesce(1).write.parquet(f"{self.path}/manifest/{number}-{flushed}")

    def log(self) -> DataFrame:
        """What is committed to the log."""
        if not any(n.startswith("segment=") for n in self._names("log")):
            return self.spark.createDataFrame([], OPLOG)
        return self.spark.read.schema(OPLOG).parquet(f"{self.path}/log").select("seq", "segment", "op", "key", "value", "ts")

    def _flushed(self) -> int:
        """The last sequence number that runs hold."""
        versions = self._manifests()
        return int(versions[-1].partition("-")[2]) if versions else 0

    def operations(self) -> DataFrame:
        """Operations that no run holds yet, committed or buffered."""
        rows = self.log().where(F.col("seq") > self._flushed())
        return (rows.union(self.spark.createDataFrame(self.buffer, OPLOG)) if self.buffer else rows).drop("segment")

    def memtable(self) -> DataFrame:
        """The last of those operations for each key."""
        return resolve.latest(self.operations(), "log")

    def runs(self, where=None) -> DataFrame:
        """Rows of all runs, or of those whose manifest rows satisfy a condition."""
        listed = self.manifest() if where is None else self.manifest().where(where)
        paths = [f"{self.path}/{r.path}" for r in listed.select("path").collect()]
        fields = schema("seq long, op string, key string, value string, ts long")
        return self.spark.read.schema(fields).parquet(*paths) if paths else self.spark.createDataFrame([], fields)

    def _pending_bytes(self) -> int:
        return self.memtable().agg(F.sum(memory_bytes(F.octet_length("key"), F.octet_length("value")))).first()[0] or 0

    # writing

    def _append(self, op: str, key: str, value: str) -> None:
        klen, vlen = len(key.encode()), len(value.encode())
        if klen > MAX_KEY:
            raise errors.InvalidFormat(f"key of {klen} bytes")
        if klen + vlen + RECORD_OVERHEAD > MAX_RECORD:
            raise errors.InvalidFormat(f"record of {klen + vlen + RECORD_OVERHEAD} bytes")
        if self.segment_used >= self.segment_bytes:
            self.segment, self.segment_used = self.segment + 1, 0
        self.buffer.append((self.next_seq, self.segment, op, key, value, int(self.clock())))
        self.next_seq += 1
        self.segment_used += 21 + klen + vlen
        # an estimate that never falls short: overwritten keys are charged in full
        self.unflushed += 48 + klen + vlen
        if len(self.buffer) >= self.buffer_rows:
            self.sync()
        if self.unflushed >= self.memtable_bytes:
            self.flush()
            self.maybe_compact()

    def put(self, key: str, value: str) -> None:
        start = time.perf_counter()
        self._append("put", key, value)
        self.counts["writes_total"] += 1
        self.counts["writes_bytes"] += len(key.encode()) + len(value.encode())
        self.latency["write"].observe((time.perf_counter() - start) * 1e6)

    def delete(self, key: str) -> None:
        self._append("delete", key, "")

    def put_all(self, rows: DataFrame, order: str) -> None:
        """Append a table (key, value), numbered in the order of a column, as one segment."""
        self.sync()
        # numbers grow along the sorted partitions without being consecutive, so no task has to see all rows
        numbered = rows.orderBy(order).select((F.monotonically_increasing_id() + self.next_seq).alias("seq"), "key", "value")
        out = numbered.select("seq", F.lit(self.segment).cast("long").alias("segment"), F.lit("put").alias("op"), "key", "value", F.lit(int(self.clock())).cast("long").alias("ts"))
        out.write.mode("append").partitionBy("segment").parquet(f"{self.path}/log")
        self.next_seq = self.log().agg(F.max("seq")).first()[0] + 1
        self.segment, self.segment_used = self.segment + 1, 0
        self.unflushed = self._pending_bytes()

    def sync(self) -> None:
        """Commit the buffered operations to the log."""
        if self.buffer:
            rows, self.buffer = self.buffer, []
            self.spark.createDataFrame(rows, OPLOG).coalesce(1).write.mode("append").partitionBy("segment").parquet(f"{self.path}/log")

    def _write_run(self, rows: DataFrame, run_id: int) -> DataFrame:
        """Write a run and return its manifest row."""
        path = f"runs/{run_id:06d}"
        write_run(rows, f"{self.path}/{path}", rows.count())
        made = self.spark.read.parquet(f"{self.path}/{path}")
        size = self.fs.getContentSummary(self._at(path)).getLength()
        return made.agg(F.count("*").alias("entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.max("seq").alias("max_seq")).select(
            F.lit(run_id).cast("long").alias("run_id"), F.lit(path).alias("path"), F.lit(size).cast("long").alias("bytes"), "entries", "min_key", "max_key", "min_ts", "max_ts", "max_seq"
        )

    def _next_run(self) -> int:
        return 1 + max([int(n) for n in self._names("runs") if n.isdigit()], default=0)

    def flush(self) -> bool:
        """Turn the unflushed operations into a run; False if there are none."""
        self.sync()
        after, operations = self._version(), self.operations()
        last = operations.agg(F.max("seq")).first()[0]
        self.unflushed = 0
        if last is None:
            return False
        start = time.perf_counter()
        listed = self.manifest()
        added = self._write_run(resolve.latest(operations.where(F.col("seq") <= last), "log"), self._next_run())
        self._commit(after, listed.unionByName(added), last)
        self.counts["flushes_total"] += 1
        self.latency["flush"].observe((time.perf_counter() - start) * 1e6)
        return True

    def maybe_compact(self) -> DataFrame | None:
        """Compact if that is switched on and was not done within the last second."""
        if not self.compaction_on or self.clock() - self.compacted_at < 1:
            return None
        self.compacted_at = self.clock()
        return self.compact()

    def compact(self, least: int | None = None) -> DataFrame | None:
        """Merge the largest group of runs of similar size; returns its statistics, None if there is no such group."""
        after, flushed, listed = self._version(), self._flushed(), self.manifest()
        pick = compaction.tier_pick(listed.select(F.lit(0).alias("grp"), "run_id", "bytes"), least or self.least_runs).first()
        if pick is None:
            return None
        chosen = F.col("run_id").isin(pick.members)
        rows = self.runs(chosen)
        whole = len(pick.members) == listed.count()
        kept = resolve.latest(rows)
        # a delete may go only when no older run can hold its key
        kept = kept.where("op <> 'delete'") if whole else kept
        stats = self.spark.createDataFrame([compaction.merge_stats(rows.withColumn("run_id", F.lit(0)), F.octet_length("key") + F.octet_length("value") + 8).withColumn("inputs", F.lit(len(pick.members))).first().asDict()])
        if kept.isEmpty():
            self._commit(after, listed.where(~chosen), flushed)
        else:
            self._commit(after, listed.where(~chosen).unionByName(self._write_run(kept, self._next_run())), flushed)
        done = stats.first()
        self.counts["compactions_total"] += 1
        self.counts["bytes_in"] += done.bytes_in
        self.counts["bytes_out"] += done.bytes_out
        return stats

    def cleanup(self, replica_segment: int = 0) -> list[int]:
        """Delete log segments that runs hold in full and that no replica still needs; returns their numbers."""
        self.sync()
        log, flushed = self.log(), self._flushed()
        sizes = wal.segment_sizes(log.withColumns({"klen": F.octet_length("key"), "vlen": F.octet_length("value")}))
        gone = sizes.where((F.col("max_seq") <= flushed) & (F.col("segment") < self.segment))
        gone = gone.where(F.col("segment") < replica_segment) if replica_segment > 0 else gone
        numbers = sorted(r.segment for r in gone.select("segment").collect())
        for n in numbers:
            self.fs.delete(self._at("log", f"segment={n}"), True)
        return numbers

    # reading

    def versions(self, where=None) -> DataFrame:
        """The versions of all keys, one from memory and one from each run that satisfies a condition on the manifest."""
        return self.memtable().unionByName(self.runs(where))

    def get(self, key: str) -> str | None:
        start = time.perf_counter()
        # the buffer's operations are later than all others
        found = next(((op, value) for _, _, op, k, value, _ in reversed(self.buffer) if k == key), None)
        if found is None:
            holds = (F.col("min_key") <= key) & (F.col("max_key") >= key)
            rows = self.log().where((F.col("seq") > self._flushed()) & (F.col("key") == key)).drop("segment")
            row = resolve.latest(rows.unionByName(self.runs(holds).where(F.col("key") == key)), "log").first()
            found = row and (row.op, row.value)
        value = None if found is None or found[0] == "delete" else found[1]
        self.counts["reads_total"] += 1
        self.counts["reads_misses" if value is None else "reads_hits"] += 1
        self.latency["read"].observe((time.perf_counter() - start) * 1e6)
        return value

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return lookup.multi_get(resolve.live(self.versions(), "log"), keys, "log")

    def scan(self, lo: str, hi: str, inclusive: bool = False) -> DataFrame:
        """(key, value, ts) in order of key; half-open unless inclusive."""
        holds = (F.col("max_key") >= lo) & (F.col("min_key") <= hi)
        rows = self.versions(holds).where(lookup.in_range(lo, hi, inclusive))
        return resolve.live(rows).select("key", "value", "ts").orderBy("key")

    def stats(self) -> DataFrame:
        """One row: entries and bytes in memory, runs, entries in runs, bytes of runs and log."""
        memory = self.memtable().agg(F.count("*").alias("memtable_entries"), F.coalesce(F.sum(memory_bytes(F.octet_length("key"), F.octet_length("value"))), F.lit(0)).alias("memtable_bytes"), F.lit(0).cast("long").alias("immutable_count"))
        runs = self.manifest().agg(F.count("*").alias("sstable_count"), F.coalesce(F.sum("entries"), F.lit(0)).alias("sstable_entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("sstable_bytes"))
        log = self.log().agg(F.coalesce(F.sum(record_bytes(F.octet_length("key"), F.octet_length("value"))), F.lit(0)).alias("wal_bytes"))
        return memory.join(runs, F.lit(True)).join(log, F.lit(True)).withColumn("disk_bytes", F.col("sstable_bytes") + F.col("wal_bytes"))

    def metrics(self) -> DataFrame:
        """One row: this session's counters and latencies, the derived rates, and the store's state."""
        now = dict(self.counts, node_id=self.path, uptime_seconds=int(self.clock() - self.started))
        now |= {f"{k}_{name}": float(h.percentile(p)) for k, h in self.latency.items() for name, p in (("p50", 0.5), ("p99", 0.99))}
        row = self.spark.createDataFrame([now])
        return metrics.space_rates(metrics.read_rates(row.join(self.stats(), F.lit(True))))

    def prometheus(self, prefix: str = "engine") -> DataFrame:
        """The scrape format (line_no, line) of the same."""
        names = {"reads_hits_total": "reads_hits", "reads_misses_total": "reads_misses", "write_latency_p50_us": "write_p50", "write_latency_p99_us": "write_p99", "read_latency_p50_us": "read_p50", "read_latency_p99_us": "read_p99", "memtable_size_bytes": "memtable_bytes", "disk_usage_bytes": "disk_bytes", "wal_size_bytes": "wal_bytes", "compaction_space_savings": "space_savings"}
        now = self.metrics()
        pairs = [F.struct(F.lit(n).alias("name"), F.col(names.get(n, n)).cast("string").alias("shown")) for n, _, _ in metrics.SERIES if names.get(n, n) in now.columns]
        return metrics.prometheus(now.select(F.explode(F.array(*pairs)).alias("p")).select("p.name", "p.shown"), prefix)
