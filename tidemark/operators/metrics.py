"""Operational metrics: counters, gauges, percentiles, ratios, deltas and their text forms."""

from __future__ import annotations

import random
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(part: Column, total: Column, empty: float = 0.0) -> Column:
    return F.when(total == 0, F.lit(empty)).otherwise(part / total)


def operation_counters(ops: DataFrame, *by: str) -> DataFrame:
    """Counters of an operation table (verb, hit, bytes)."""
    put, get = F.col("verb") == "PUT", F.col("verb") == "GET"
    return ops.groupBy(*by).agg(
        F.count_if(put).alias("writes_total"),
        F.coalesce(F.sum(F.when(put, F.col("bytes"))), F.lit(0)).alias("writes_bytes"),
        F.count_if(get).alias("reads_total"),
        F.count_if(get & F.col("hit")).alias("reads_hits"),
        F.count_if(get & ~F.col("hit")).alias("reads_misses"),
    )


def read_rates(counters: DataFrame) -> DataFrame:
    """Without reads the hit rate is 0 and the miss rate 1."""
    hit = rate(F.col("reads_hits"), F.col("reads_total"))
    return counters.withColumn("read_hit_rate", hit).withColumn("read_miss_rate", 1 - hit)


def bloom_rates(counters: DataFrame) -> DataFrame:
    total = F.col("bloom_hits") + F.col("bloom_misses")
    return counters.withColumn("bloom_hit_rate", rate(F.col("bloom_hits"), total)).withColumn("bloom_fp_rate", rate(F.col("bloom_false_positives"), total))


def space_rates(counters: DataFrame) -> DataFrame:
    saved = F.when(F.col("bytes_in") == 0, F.lit(0.0)).otherwise(1 - F.col("bytes_out") / F.col("bytes_in"))
    return counters.withColumn("space_savings", saved).withColumn("write_amplification", rate(F.col("bytes_out"), F.col("writes_bytes"), 1.0))


def lower_percentiles(rows: DataFrame, value: str, by: list[str], ps: list[float], cuts: int = 32) -> DataFrame:
    """The value at rank floor((n - 1) * p) of each group, which is not the interpolated nor the discrete percentile.

    Values are numbers or times; nulls do not count. A group is reduced to its distinct values with their counts, and these are dealt over ``cuts`` buckets
    between approximate quantiles. The buckets' counts, one row each, tell which bucket holds a rank, and that one alone is sorted. The bounds
    only balance the buckets; the result is exact whatever they are."""
    freq = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    shares = [i / cuts for i in range(1, cuts)]
    bounds = freq.groupBy(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]).agg(F.percentile_approx("_v", shares, 20 * cuts).alias("_bounds"))
    freq = freq.join(bounds, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]))
    freq = freq.select(*by, "_v", "_n", F.size(F.filter("_bounds", lambda b: b < F.col("_v"))).alias("_bucket"))
    in_order = Window.partitionBy(*by).orderBy("_bucket")
    per = freq.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_in"))
    per = per.withColumn("_upto", F.sum("_in").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_in").over(Window.partitionBy(*by)))
    at = [F.floor((F.col("_all") - 1) * F.lit(float(p))) + 1 for p in ps]
    wanted = per.where(reduce(or_, [(F.col("_upto") >= a) & (F.col("_upto") - F.col("_in") < a) for a in at]))
    wanted = wanted.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_of"), (F.col("_upto") - F.col("_in")).alias("_start"), "_all")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)])
    held = freq.join(wanted, same & (F.col("_bucket") == F.col("_of")))
    within = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_rank", F.col("_start") + F.sum("_n").over(within))
    return held.groupBy(*by).agg(F.first("_all").alias("n"), *[F.min(F.when(F.col("_rank") >= a, F.col("_v"))).alias(f"p{round(p * 100)}") for a, p in zip(at, ps)])


def gauges(changes: DataFrame) -> DataFrame:
    """(name, value, changes) of each gauge after changes (name, seq, verb, amount): set, inc, dec, add or sub; a gauge starts at 0.

    The last set of each gauge is found first, then what follows it is added up: nothing is put in order."""
    verb, amount = F.col("verb"), F.col("amount")
    step = F.when(verb == "inc", 1).when(verb == "dec", -1).when(verb == "add", amount).when(verb == "sub", -amount).otherwise(0).cast("long")
    last = changes.groupBy("name").agg(F.max(F.when(verb == "set", F.struct("seq", "amount"))).alias("last"), F.count("*").alias("changes"))
    moved = changes.join(last, "name").where(F.col("last").isNull() | (F.col("seq") > F.col("last.seq"))).groupBy("name").agg(F.sum(step).alias("moved"))
    value = F.coalesce("last.amount", F.lit(0)) + F.coalesce("moved", F.lit(0))
    return last.join(moved, "name", "left").select("name", value.cast("long").alias("value"), "changes")


def sampled_percentile(rows: DataFrame, value: str, p: float, keep: int = 10_000, seed: int = 0, order: Column | None = None) -> DataFrame:
    """The same over a sample of ``keep`` values, as a bounded histogram would hold them: random, or the first by ``order``."""
    kept = rows.orderBy(F.rand(seed) if order is None else order).limit(keep).select(value)
    return lower_percentiles(kept.withColumn("_g", F.lit(1)), value, ["_g"], [p]).drop("_g")


def deltas(snapshots: DataFrame, time: str, *values: str) -> DataFrame:
    """Growth since the snapshot before, never negative, 0 for the first; snapshots are few (one per poll)."""
    w = Window.orderBy(time)
    return snapshots.withColumns({f"{v}_delta": F.coalesce(F.greatest(F.lit(0), F.col(v) - F.lag(v).over(w)), F.lit(0)) for v in values})


def rolling(snapshots: DataFrame, time: str, value: str, window: int = 60) -> DataFrame:
    """Over the last ``window`` snapshots: how many there are, their sum and their greatest."""
    w = Window.orderBy(time).rowsBetween(1 - window, 0)
    return snapshots.withColumns({"samples": F.count("*").over(w), f"{value}_sum": F.sum(value).over(w), f"{value}_max": F.max(value).over(w)})


class Histogram:
    """A bounded sample of observations: once full, each new one replaces a random one, so recent ones prevail."""

    def __init__(self, keep: int = 10_000, seed: int | None = None):
        self.keep, self.values, self.draw = keep, [], random.Random(seed)

    def observe(self, value: float) -> None:
        if len(self.values) < self.keep:
            self.values.append(value)
        else:
            self.values[self.draw.randrange(self.keep)] = value

    def percentile(self, p: float) -> float:
        """The value at rank floor((n - 1) * p); 0 if there is none."""
        return sorted(self.values)[int((len(self.values) - 1) * p)] if self.values else 0


# The series of the scrape format, in order: name, type, help.
SERIES = [
    ("writes_total", "counter", "Total write operations"),
    ("reads_total", "counter", "Total read operations"),
    ("reads_hits_total", "counter", "Total read hits"),
    ("reads_misses_total", "counter", "Total read misses"),
    ("flushes_total", "counter", "Total MemTable flushes"),
    ("compactions_total", "counter", "Total compaction runs"),
    ("write_latency_p50_us", "gauge", "Write latency 50th percentile microseconds"),
    ("write_latency_p99_us", "gauge", "Write latency 99th percentile microseconds"),
    ("read_latency_p50_us", "gauge", "Read latency 50th percentile microseconds"),
    ("read_latency_p99_us", "gauge", "Read latency 99th percentile microseconds"),
    ("memtable_size_bytes", "gauge", "Current MemTable size in bytes"),
    ("memtable_entries", "gauge", "Current MemTable entry count"),
    ("sstable_count", "gauge", "Number of SSTables on disk"),
    ("disk_usage_bytes", "gauge", "Total disk usage in bytes"),
    ("wal_size_bytes", "gauge", "Current WAL size in bytes"),
    ("read_hit_rate", "gauge", "Read hit rate (0.0 to 1.0)"),
    ("bloom_filter_hit_rate", "gauge", "Bloom filter hit rate (0.0 to 1.0)"),
    ("bloom_filter_fp_rate", "gauge", "Bloom filter false positive rate"),
    ("compaction_space_savings", "gauge", "Compaction space savings (0.0 to 1.0)"),
    ("write_amplification", "gauge", "Write amplification factor"),
    ("uptime_seconds", "gauge", "Server uptime in seconds"),
]


def prometheus(values: DataFrame, prefix: str = "engine") -> DataFrame:
    """Lines (line_no, line) of the scrape format of (name, shown) rows, for the series that are there."""
    spark = values.sparkSession
    known = spark.createDataFrame([(i, *s) for i, s in enumerate(SERIES)], "i long, name string, kind string, help string")
    rows = known.join(values, "name")
    full = F.concat(F.lit(prefix + "_"), "name")
    lines = F.array(F.concat_ws(" ", F.lit("# HELP"), full, "help"), F.concat_ws(" ", F.lit("# TYPE"), full, "kind"), F.concat_ws(" ", full, "shown"))
    return rows.select("i", F.posexplode(lines).alias("j", "line")).select((F.col("i") * 3 + F.col("j")).alias("line_no"), "line").orderBy("line_no")


def as_json(snapshot: DataFrame, nested: str = "storage_metrics", outside: tuple[str, ...] = ("node_id", "uptime_seconds")) -> DataFrame:
    """Each snapshot as one JSON document, its metrics under ``nested``."""
    inner = [c for c in snapshot.columns if c not in outside]
    return snapshot.select(F.to_json(F.struct(*outside, F.struct(*inner).alias(nested))).alias("body"))


# The sections of the text summary; {name} is a number, MB is by whole division.
SUMMARY = [
    ("Operations", [("Writes", "%d (%d MB)", ["writes_total", "writes_bytes:mb"]), ("Reads", "%d (hits: %d, misses: %d)", ["reads_total", "reads_hits", "reads_misses"]), ("Flushes", "%d", ["flushes_total"]), ("Compactions", "%d", ["compactions_total"])]),
    ("Read Performance", [("Hit Rate", "%.2f%%", ["read_hit_rate:pct"]), ("Miss Rate", "%.2f%%", ["read_miss_rate:pct"])]),
    ("Bloom Filter", [("Hit Rate", "%.2f%%", ["bloom_hit_rate:pct"]), ("FP Rate", "%.2f%%", ["bloom_fp_rate:pct"]), ("Hits", "%d", ["bloom_hits"]), ("Misses", "%d", ["bloom_misses"]), ("False Pos", "%d", ["bloom_false_positives"])]),
    ("Compaction", [("Input", "%d MB", ["bytes_in:mb"]), ("Output", "%d MB", ["bytes_out:mb"]), ("Space Saved", "%.2f%%", ["space_savings:pct"]), ("Write Amp", "%.2fx", ["write_amplification"])]),
    ("Latency (us)", [(f"{kind} {p}", "%.1f", [f"{kind.lower()}_{p}"]) for kind in ("Write", "Read", "Flush") for p in ("p50", "p99")]),
    ("System State", [("MemTable", "%d MB (%d entries)", ["memtable_bytes:mb", "memtable_entries"]), ("Immutable", "%d", ["immutable_count"]), ("SSTables", "%d", ["sstable_count"]), ("WAL Size", "%d MB", ["wal_bytes:mb"]), ("Disk Usage", "%d MB", ["disk_bytes:mb"])]),
]


def summary(snapshot: DataFrame) -> DataFrame:
    """Lines (line_no, line) of the text summary of a one-row snapshot, for the sections whose metrics are there."""

    def shown(name: str) -> Column:
        name, _, how = name.partition(":")
        col = F.col(name)
        return F.floor(col / 1_048_576).cast("long") if how == "mb" else col * 100.0 if how == "pct" else col

    lines = []
    for title, rows in SUMMARY:
        have = [r for r in rows if {c.partition(":")[0] for c in r[2]} <= set(snapshot.columns)]
        if have:
            lines.append(F.lit(title + ":"))
            lines += [F.format_string(f"  {label}: {form}", *map(shown, cols)) for label, form, cols in have]
    return snapshot.select(F.posexplode(F.array(*lines)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))
