"""The query catalogue: every operator applied to the driver's tables, with the same question in SQL.

Each query reads its whole tables. Where an operation table, commands or run numbers are needed, they are mapped
from ``events`` as the SQL beside the query says.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import bloom, buckets, compaction, lookup, metrics, resolve, runs, wal
from ..schema import events_log, load
from ..sources import wire
from ..sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The operation log as SQL.
LOG = "log AS (SELECT event_id AS seq, concat_ws(':', user_id, event_type) AS key, value, epoch(date_trunc('second', ts))::BIGINT AS ts, octet_length(encode(props))::BIGINT AS vlen FROM events)"
#: Runs: a thousand consecutive operations each.
RUN = 1000
RUN_ROWS = f"{LOG}, runs AS (SELECT seq // {RUN} AS run_id, key, value, ts, seq, octet_length(encode(key))::BIGINT AS klen, vlen FROM log)"
NEWEST = "QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    return log.select(F.floor(F.col("seq") / RUN).cast("long").alias("run_id"), "key", "value", "ts", "seq", F.octet_length("key").cast("long").alias("klen"), "vlen")


_own_folder: list[str] = []


def folder(spark: SparkSession) -> str:
    """A folder that all executors share; a local one only where the master is local and none is set (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


# resolving versions


@query(f"WITH {LOG} SELECT key, value, ts, seq FROM log {NEWEST}")
def lww_latest(spark, sf_dir):
    return resolve.latest(events_log(spark, sf_dir)).select("key", "value", "ts", "seq")


@query(f"WITH {LOG} SELECT key, max_by(value, (ts, seq)) AS value, max(ts) AS ts, max_by(seq, (ts, seq)) AS seq FROM log GROUP BY key")
def lww_by_aggregate(spark, sf_dir):
    return resolve.latest_value(events_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT key, value, ts, seq FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def lww_log_order(spark, sf_dir):
    return resolve.latest(events_log(spark, sf_dir), "log").select("key", "value", "ts", "seq")


@query(f"WITH {LOG}, days AS (SELECT key, value, ts - ts % 86400 AS ts, seq FROM log) SELECT * FROM days {NEWEST}")
def lww_day_ties(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("ts", F.col("ts") - F.col("ts") % 86400)
    return resolve.latest(log).select("key", "value", "ts", "seq")


@query("""SELECT key, value, ts, seq FROM (SELECT o_custkey AS key, o_totalprice AS value, epoch(o_orderdate)::BIGINT AS ts, o_orderkey AS seq FROM orders)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1""")
def lww_orders(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return resolve.latest(o.select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_orderkey").alias("seq")))


@query(f"WITH {LOG} SELECT key, count(*) AS versions, min(ts) AS first_ts, max(ts) AS last_ts FROM log GROUP BY key")
def version_count(spark, sf_dir):
    return resolve.version_counts(events_log(spark, sf_dir))


# reading


@query(f"WITH {LOG} SELECT key, value, ts, seq FROM log WHERE key = '7:click' {NEWEST}")
def point_get(spark, sf_dir):
    return lookup.point_get(events_log(spark, sf_dir), "7:click").select("key", "value", "ts", "seq")


@query(f"WITH {LOG} SELECT key, value, ts, seq FROM log WHERE key = 'nobody' {NEWEST}")
def negative_get(spark, sf_dir):
    return lookup.point_get(events_log(spark, sf_dir), "nobody").select("key", "value", "ts", "seq")


WANTED = "wanted AS (SELECT DISTINCT concat_ws(':', c_custkey, 'view') AS key FROM customer)"


@query(f"""WITH {LOG}, {WANTED}, got AS (SELECT * FROM log {NEWEST})
SELECT w.key, value, ts, seq, seq IS NOT NULL AS found FROM wanted w LEFT JOIN got USING (key)""")
def multi_get_with_misses(spark, sf_dir):
    keys = load(spark, sf_dir, "customer").select(F.concat_ws(":", F.col("c_custkey").cast("string"), F.lit("view")).alias("key"))
    return lookup.multi_get(events_log(spark, sf_dir), keys).select("key", "value", "ts", "seq", "found")


def _range_sql(condition: str, cols: str = "key, value") -> str:
    return f"WITH {LOG} SELECT {cols} FROM log WHERE {condition} {NEWEST}"


@query(_range_sql("key >= '10:click' AND key < '20:view'"))
def scan_half_open(spark, sf_dir):
    return lookup.scan(events_log(spark, sf_dir), "10:click", "20:view").select("key", "value")


@query(_range_sql("key >= '10:click' AND key <= '20:view'"))
def scan_inclusive(spark, sf_dir):
    return lookup.scan(events_log(spark, sf_dir), "10:click", "20:view", inclusive=True).select("key", "value")


@query(_range_sql("key >= '3' AND key < '6'", "key, value, ts"))
def scan_with_ts(spark, sf_dir):
    return lookup.scan(events_log(spark, sf_dir), "3", "6").select("key", "value", "ts")


# ranked sources: 0 memory, 1 frozen, 2.. runs from newest to oldest; deletes aside, one version per key and source

TIERS = f"{LOG}, top AS (SELECT max(seq) AS m FROM log), src AS (SELECT key, value, ts - ts % 86400 AS ts, seq, ((m - seq) * 5 // (m + 1))::INT AS source_rank FROM log, top)"


def tiers(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("ts", F.col("ts") - F.col("ts") % 86400)
    top = log.agg(F.max("seq").alias("m"))
    ranked = log.join(F.broadcast(top), F.lit(True))
    return ranked.withColumn("source_rank", F.floor((F.col("m") - F.col("seq")) * 5 / (F.col("m") + 1)).cast("int")).select("key", "value", "ts", "seq", "source_rank")


@query(f"WITH {TIERS}, {WANTED} SELECT key, value, source_rank FROM src SEMI JOIN wanted USING (key) QUALIFY row_number() OVER (PARTITION BY key ORDER BY source_rank, seq DESC) = 1")
def tiered_get(spark, sf_dir):
    keys = load(spark, sf_dir, "customer").select(F.concat_ws(":", F.col("c_custkey").cast("string"), F.lit("view")).alias("key"))
    return lookup.tiered_get(tiers(spark, sf_dir), keys).select("key", "value", "source_rank")


@query(f"WITH {TIERS} SELECT key, value, ts, source_rank FROM src WHERE key >= '1' AND key < '4' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, source_rank, seq DESC) = 1")
def tiered_scan(spark, sf_dir):
    return lookup.tiered_scan(tiers(spark, sf_dir), "1", "4").select("key", "value", "ts", "source_rank")


# memory tables and runs


@query(f"WITH {LOG} SELECT count(*) AS entries, sum(octet_length(encode(key)) + vlen + 48)::BIGINT AS bytes FROM (SELECT * FROM log {NEWEST})")
def memtable_size(spark, sf_dir):
    kept = resolve.latest(events_log(spark, sf_dir))
    return kept.agg(F.count("*").alias("entries"), F.sum(scalar.memory_bytes(F.octet_length("key"), F.col("vlen"))).alias("bytes"))


@query(f"""WITH {LOG}, cum AS (SELECT *, coalesce(sum(octet_length(encode(key)) + vlen + 48) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM log)
SELECT (before // 16384)::BIGINT AS bucket, count(*) AS entries, min(seq) AS min_seq, max(seq) AS max_seq FROM cum GROUP BY 1""")
def run_layout_cumulative(spark, sf_dir):
    cut = buckets.cumulative(events_log(spark, sf_dir), scalar.memory_bytes(F.octet_length("key"), F.col("vlen")), 16_384)
    return cut.groupBy("bucket").agg(F.count("*").alias("entries"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


_digest = "('0x' || substr(md5({0}), {1}, 15))::BIGINT"
#: Buckets that start anew once they are full, one step of the recursion for each: rows of ``r`` (shard, rn, ...), of which {0} is the size in a bucket that starts behind row ``stop``.
CUTS = """cuts(shard, number, start, stop) AS (
SELECT shard, 0::BIGINT, 1::BIGINT, min(rn) FILTER (total >= {1}) FROM (SELECT shard, rn, sum({0}) OVER (PARTITION BY shard ORDER BY rn) AS total FROM (SELECT *, 0 AS stop FROM r)) GROUP BY shard
UNION ALL SELECT shard, number + 1, start, min(rn) FILTER (total >= {1}) FROM (SELECT shard, number, stop + 1 AS start, rn, sum({0}) OVER (PARTITION BY shard ORDER BY rn) AS total FROM (SELECT r.*, number, stop FROM cuts JOIN r USING (shard) WHERE rn > stop)) GROUP BY ALL)"""
KEYED = f"keyed AS (SELECT *, ({_digest.format('key', 1)} % 8)::BIGINT AS shard, octet_length(encode(key))::BIGINT AS klen FROM log)"
EXACT_RUNS = f"""WITH RECURSIVE {LOG}, {KEYED}, n AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq) AS rn FROM keyed),
r AS (SELECT *, lag(rn) OVER w AS last_rn, lag(vlen) OVER w AS last_vlen FROM n WINDOW w AS (PARTITION BY shard, key ORDER BY seq)),
{CUTS.format("CASE WHEN last_rn > stop AND last_vlen > 0 THEN vlen - last_vlen ELSE klen + vlen + 48 END", 4096)}
SELECT shard, number AS run, count(DISTINCT key) AS entries, sum(CASE WHEN last_rn >= start AND last_vlen > 0 THEN vlen - last_vlen ELSE klen + vlen + 48 END)::BIGINT AS bytes, min(key) AS min_key, max(key) AS max_key, stop IS NOT NULL AS closed
FROM cuts JOIN r USING (shard) WHERE rn >= start AND (stop IS NULL OR rn <= stop) GROUP BY shard, number, start, stop"""


@query(EXACT_RUNS)
def run_layout_exact(spark, sf_dir):
    return buckets.resetting(events_log(spark, sf_dir).withColumn("klen", F.octet_length("key").cast("long")), 4096)


@query(f"WITH {RUN_ROWS} SELECT run_id, count(*) AS entries, sum(klen + vlen + 8)::BIGINT AS bytes, min(key) AS min_key, max(key) AS max_key, min(ts) AS min_ts, max(ts) AS max_ts FROM runs GROUP BY run_id")
def run_manifest(spark, sf_dir):
    return runs.manifest(run_rows(spark, sf_dir))


@query(f"""WITH {RUN_ROWS} SELECT count(DISTINCT run_id) AS sstable_count, count(*) AS entries, sum(klen + vlen + 8)::BIGINT AS sstable_bytes, sum(21 + klen + vlen)::BIGINT AS wal_bytes,
sum(klen + vlen + 8 + 21 + klen + vlen)::BIGINT AS disk_bytes FROM runs""")
def engine_stats(spark, sf_dir):
    r = run_rows(spark, sf_dir)
    per = r.groupBy("run_id").agg(F.count("*").alias("n"), F.sum(F.col("klen") + F.col("vlen") + 8).alias("b"), F.sum(scalar.record_bytes(F.col("klen"), F.col("vlen"))).alias("w"))
    out = per.agg(F.count("*").alias("sstable_count"), F.sum("n").alias("entries"), F.sum("b").alias("sstable_bytes"), F.sum("w").alias("wal_bytes"))
    return out.withColumn("disk_bytes", F.col("sstable_bytes") + F.col("wal_bytes"))


# compaction


@query(f"WITH {RUN_ROWS} SELECT key, value, ts, seq FROM runs {NEWEST}")
def compact_merge(spark, sf_dir):
    return compaction.merge(run_rows(spark, sf_dir)).select("key", "value", "ts", "seq")


@query(f"""WITH {RUN_ROWS}, kept AS (SELECT klen + vlen + 8 AS b FROM runs {NEWEST}), a AS (SELECT count(DISTINCT run_id) AS inputs, count(DISTINCT key) AS entries_merged, count(*) - count(DISTINCT key) AS duplicates_removed, sum(klen + vlen + 8)::BIGINT AS bytes_in FROM runs)
SELECT inputs, entries_merged, duplicates_removed, bytes_in, (SELECT sum(b)::BIGINT FROM kept) AS bytes_out, 1 - (SELECT sum(b) FROM kept)::DOUBLE / bytes_in AS savings FROM a""")
def compact_stats(spark, sf_dir):
    return compaction.merge_stats(run_rows(spark, sf_dir), F.col("klen") + F.col("vlen") + 8)


FILES = "files AS (SELECT c_nationkey AS grp, o_custkey AS run_id, sum(floor(o_totalprice))::BIGINT AS bytes FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"
GROUPS = f"""{FILES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY bytes, run_id) AS rank FROM files),
groups AS (SELECT a.grp, a.run_id AS anchor, a.rank::INT AS anchor_rank, count(*) AS files, sum(b.bytes)::BIGINT AS bytes FROM ranked a JOIN ranked b ON a.grp = b.grp AND b.rank >= a.rank AND b.bytes <= 1.5 * a.bytes GROUP BY ALL HAVING count(*) >= 4)"""


def files(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    sizes = o.groupBy("o_custkey").agg(F.sum(F.floor("o_totalprice")).alias("bytes"))
    return sizes.join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("grp"), F.col("o_custkey").alias("run_id"), "bytes")


@query(f"WITH {GROUPS} SELECT * FROM groups")
def size_tier_groups(spark, sf_dir):
    return compaction.tier_groups(files(spark, sf_dir)).drop("members")


@query(f"WITH {GROUPS} SELECT * FROM groups QUALIFY row_number() OVER (PARTITION BY grp ORDER BY files DESC, anchor_rank) = 1")
def size_tier_pick(spark, sf_dir):
    return compaction.tier_pick(files(spark, sf_dir)).drop("members")


# blocks, fences, sizes

_shared = "CASE WHEN prev IS NULL THEN 0 ELSE coalesce(list_position(list_transform(range(1, least(length(prev), length(key)) + 1), lambda i: prev[i] <> key[i]), true) - 1, least(length(prev), length(key))) END"
_varint = "(1 + ({0} >= 128)::INT + ({0} >= 16384)::INT + ({0} >= 2097152)::INT)"
BLOCKS = f"""{RUN_ROWS}, cut AS (SELECT *, coalesce(sum(klen + vlen + 8) OVER (PARTITION BY run_id ORDER BY key, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 4096 AS block FROM runs),
lagged AS (SELECT *, lag(key) OVER (PARTITION BY run_id, block ORDER BY key, seq) AS prev FROM cut),
pre AS (SELECT *, ({_shared})::BIGINT AS shared FROM lagged),
blocks AS (SELECT *, ({_varint.format("shared")} + {_varint.format("(klen - shared)")} + {_varint.format("vlen")} + klen - shared + vlen + 8)::BIGINT AS entry_bytes FROM pre)"""
FENCES = f"""{BLOCKS}, per AS (SELECT run_id, block, min(key) AS first_key, count(*) AS entries, sum(entry_bytes)::BIGINT AS bytes FROM blocks GROUP BY ALL),
fences AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY run_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", octet_length(encode(first_key))::BIGINT + 14 AS index_bytes FROM per)"""


def blocks(spark, sf_dir):
    return runs.entries(run_rows(spark, sf_dir), 4096)


@query(f"WITH {BLOCKS} SELECT run_id, seq, key, block, shared, entry_bytes FROM blocks")
def entry_bytes(spark, sf_dir):
    return blocks(spark, sf_dir).select("run_id", "seq", "key", "block", "shared", "entry_bytes")


_size = lambda shared: f"({_varint.format(shared)} + {_varint.format(f'(klen - {shared})')} + {_varint.format('vlen')} + klen - {shared} + vlen + 8)"
EXACT_BLOCKS = f"""WITH RECURSIVE {RUN_ROWS}, l AS (SELECT *, lag(key) OVER (PARTITION BY run_id ORDER BY key, seq) AS prev FROM runs),
r AS (SELECT run_id AS shard, row_number() OVER (PARTITION BY run_id ORDER BY key, seq) AS rn, seq, klen, vlen, ({_shared})::BIGINT AS prefix FROM l),
{CUTS.format(f"CASE WHEN rn = stop + 1 THEN {_size('0')} ELSE {_size('prefix')} END", 4096)}
SELECT shard AS run_id, seq, number AS block, CASE WHEN rn = start THEN 0 ELSE prefix END AS shared, (CASE WHEN rn = start THEN {_size('0')} ELSE {_size('prefix')} END)::BIGINT AS entry_bytes
FROM cuts JOIN r USING (shard) WHERE rn >= start AND (stop IS NULL OR rn <= stop)"""


@query(EXACT_BLOCKS)
def block_cut_exact(spark, sf_dir):
    return runs.cut_blocks(run_rows(spark, sf_dir), 4096).select("run_id", "seq", "block", "shared", "entry_bytes")


@query(f"WITH {BLOCKS} SELECT run_id, sum(klen + vlen + 8)::BIGINT AS raw_bytes, sum(entry_bytes)::BIGINT AS packed_bytes, sum(shared)::BIGINT AS shared_chars FROM blocks GROUP BY run_id")
def prefix_savings(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("run_id").agg(F.sum(F.col("klen") + F.col("vlen") + 8).alias("raw_bytes"), F.sum("entry_bytes").alias("packed_bytes"), F.sum("shared").alias("shared_chars"))


@query(f"WITH {FENCES} SELECT * FROM fences")
def fence_index(spark, sf_dir):
    return runs.fences(blocks(spark, sf_dir))


@query(f"""WITH {FENCES}, probes AS (SELECT DISTINCT run_id - 1 AS run_id, key FROM runs WHERE run_id > 0)
SELECT p.run_id, p.key, max(f.block) AS block FROM probes p LEFT JOIN fences f ON f.run_id = p.run_id AND f.first_key <= p.key GROUP BY ALL""")
def fence_lookup(spark, sf_dir):
    probes = run_rows(spark, sf_dir).where("run_id > 0").select((F.col("run_id") - 1).alias("run_id"), "key")
    return runs.fence_lookup(runs.fences(blocks(spark, sf_dir)), probes)


@query(f"WITH {RUN_ROWS} SELECT run_id, count(*) AS entries, sum(bad)::BIGINT AS out_of_order FROM (SELECT run_id, CASE WHEN lag(key) OVER (PARTITION BY run_id ORDER BY seq) >= key THEN 1 ELSE 0 END AS bad FROM runs) GROUP BY run_id")
def order_audit(spark, sf_dir):
    return runs.order_audit(run_rows(spark, sf_dir))


# Bloom filters

PARAMS = f"""{RUN_ROWS}, n AS (SELECT run_id, count(DISTINCT key) AS n FROM runs GROUP BY run_id), m AS (SELECT *, ceil(-n::DOUBLE * ln(0.01::DOUBLE) / pow(ln(2::DOUBLE), 2))::BIGINT AS m FROM n),
params AS (SELECT *, greatest(1, ceil(m::DOUBLE / n * ln(2::DOUBLE))::BIGINT) AS k FROM m)"""


def key_counts(spark, sf_dir):
    return run_rows(spark, sf_dir).groupBy("run_id").agg(F.countDistinct("key").alias("n"))


@query(f"WITH {PARAMS} SELECT run_id, n, m, k, ceil(m / 8.0)::BIGINT + 8 AS memory_bytes, round(pow(1 - exp(-k::DOUBLE * n / m), k::DOUBLE), 12) AS fp_rate FROM params")
def bloom_params(spark, sf_dir):
    return bloom.parameters(key_counts(spark, sf_dir)).withColumn("fp_rate", F.round("fp_rate", 12))


@query(f"WITH {PARAMS} SELECT run_id, n, pow(1 - exp(-7::DOUBLE * n / 95851::DOUBLE), 7::DOUBLE) AS fp_fixed FROM params")
def bloom_fp_theory(spark, sf_dir):
    return key_counts(spark, sf_dir).select("run_id", "n", bloom.false_positive_rate(F.col("n"), F.lit(95_851), F.lit(7)).alias("fp_fixed"))


@query(f"WITH {RUN_ROWS} SELECT run_id, count(DISTINCT key) AS keys, 0::BIGINT AS false_negatives FROM runs GROUP BY run_id")
def bloom_no_false_negative(spark, sf_dir):
    keys = run_rows(spark, sf_dir).select("run_id", "key").distinct()
    params = bloom.parameters(key_counts(spark, sf_dir))
    asked = bloom.might_contain(keys, params, bloom.build(keys, params))
    return asked.groupBy("run_id").agg(F.count("*").alias("keys"), F.count_if(~F.col("maybe")).alias("false_negatives"))


# filters by a hash that SQL has too
FILTERS = f"""{PARAMS}, keys AS (SELECT DISTINCT run_id, key FROM runs), absent AS (SELECT DISTINCT run_id, key || '!' || seq % 5 AS key FROM runs),
asked AS (SELECT run_id, key, true AS stored FROM keys UNION ALL SELECT run_id, key, false FROM absent),
spots AS (SELECT DISTINCT run_id, key, stored, unnest(list_transform(range(k), lambda i: ({_digest.format("key", 1)} % m + i * ({_digest.format("key", 17)} % m)) % m)) AS pos FROM asked JOIN params USING (run_id)),
bits AS (SELECT DISTINCT run_id, pos FROM spots WHERE stored),
probed AS (SELECT run_id, key, bool_or(stored) AS stored, count(b.pos) = count(*) AS maybe FROM spots LEFT JOIN bits b USING (run_id, pos) GROUP BY run_id, key),
outcomes AS (SELECT run_id, count(*) FILTER (stored) AS stored, count(*) FILTER (stored AND NOT maybe) AS false_negatives, count(*) FILTER (NOT stored) AS absent, count(*) FILTER (NOT stored AND maybe) AS false_positives FROM probed GROUP BY run_id)"""


def filters(spark, sf_dir):
    rows = run_rows(spark, sf_dir)
    keys, params = rows.select("run_id", "key").distinct(), bloom.parameters(key_counts(spark, sf_dir))
    return rows, keys, params, bloom.build(keys, params, by_digest=True)


@query(f"WITH {FILTERS} SELECT run_id, n, m, k, ceil(m / 8.0)::BIGINT + 8 AS memory_bytes, set_bits, set_bits / m AS fill_ratio FROM params JOIN (SELECT run_id, count(*) AS set_bits FROM bits GROUP BY run_id) USING (run_id)")
def bloom_stats(spark, sf_dir):
    _, _, params, made = filters(spark, sf_dir)
    return bloom.stats(params, made).drop("fp_rate")


def probe_outcomes(spark, sf_dir):
    """Every stored key and as many absent ones asked of each run's filter."""
    rows, keys, params, made = filters(spark, sf_dir)
    absent = rows.select("run_id", F.concat("key", F.lit("!"), (F.col("seq") % 5).cast("string")).alias("key")).distinct()
    maybe = bloom.might_contain(keys.union(absent), params, made, by_digest=True)
    stored = ~F.col("key").contains("!")
    return maybe.groupBy("run_id").agg(F.count_if(stored).alias("stored"), F.count_if(stored & ~F.col("maybe")).alias("false_negatives"), F.count_if(~stored).alias("absent"), F.count_if(~stored & F.col("maybe")).alias("false_positives"))


@query(f"WITH {FILTERS} SELECT run_id, stored, false_negatives, absent, false_positives, false_positives / absent AS fp_measured FROM outcomes")
def bloom_probes(spark, sf_dir):
    return probe_outcomes(spark, sf_dir).withColumn("fp_measured", F.col("false_positives") / F.col("absent"))


# the log

SEGMENTS = f"""{LOG}, cum AS (SELECT *, octet_length(encode(key))::BIGINT AS klen, coalesce(sum(21 + octet_length(encode(key)) + vlen) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM log),
seg AS (SELECT seq, key, value, ts, klen, vlen, (before // 32768)::BIGINT + 1 AS segment FROM cum)"""


def segmented(spark, sf_dir):
    return wal.segments(events_log(spark, sf_dir).withColumn("klen", F.octet_length("key").cast("long")), 32_768)


@query(f"WITH {SEGMENTS} SELECT seq, segment FROM seg")
def segment_assign(spark, sf_dir):
    return segmented(spark, sf_dir).select("seq", "segment")


@query(f"""WITH RECURSIVE {LOG}, {KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq) AS rn FROM keyed), {CUTS.format("21 + klen + vlen", 8192)}
SELECT shard AS writer, seq, number + 1 AS segment FROM cuts JOIN r USING (shard) WHERE rn >= start AND (stop IS NULL OR rn <= stop)""")
def segment_assign_exact(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumns({"klen": F.octet_length("key").cast("long"), "writer": F.pmod(scalar.digest(F.col("key")), F.lit(8))})
    return wal.rotated(log, "writer", 8192).select("writer", "seq", "segment")


@query(f"WITH {SEGMENTS} SELECT segment, count(*) AS records, sum(21 + klen + vlen)::BIGINT AS bytes, min(seq) AS min_seq, max(seq) AS max_seq FROM seg GROUP BY segment")
def segment_sizes(spark, sf_dir):
    return wal.segment_sizes(segmented(spark, sf_dir))


@query(f"WITH {SEGMENTS} SELECT DISTINCT segment FROM seg WHERE segment < (SELECT max(segment) FROM seg)")
def closed_segments(spark, sf_dir):
    return wal.closed_segments(segmented(spark, sf_dir))


@query(f"""WITH {SEGMENTS}, cases(flushed, replica) AS (VALUES (0, 0), (3, 0), (5, 2), (2, 5), (4, 4))
SELECT flushed, replica, segment FROM (SELECT DISTINCT segment FROM seg), cases WHERE flushed > 0 AND segment < CASE WHEN replica > 0 THEN least(flushed, replica) ELSE flushed END""")
def retention(spark, sf_dir):
    numbers = segmented(spark, sf_dir).select("segment").distinct()
    cases = F.explode(F.array(*[F.struct(F.lit(a).alias("flushed"), F.lit(b).alias("replica")) for a, b in ((0, 0), (3, 0), (5, 2), (2, 5), (4, 4))]))
    numbers = numbers.select("segment", cases.alias("c")).select("segment", "c.flushed", "c.replica")
    return wal.deletable(numbers, F.col("flushed"), F.col("replica")).select("flushed", "replica", "segment")


# a record counts as corrupt where its sequence number ends in 777
@query(f"WITH {SEGMENTS}, bad AS (SELECT *, min(CASE WHEN seq % 1000 = 777 THEN seq END) OVER (PARTITION BY segment) AS fb FROM seg) SELECT segment, count(*) AS replayed, max(seq) AS last_seq FROM bad WHERE fb IS NULL OR seq < fb GROUP BY segment")
def replay_prefix(spark, sf_dir):
    good = wal.replay(segmented(spark, sf_dir), F.col("seq") % 1000 == 777)
    return good.groupBy("segment").agg(F.count("*").alias("replayed"), F.max("seq").alias("last_seq"))


# document texts as values, against the real limit
@query("""SELECT state, count(*) AS records FROM (SELECT CASE WHEN 8 + 2 + 4 + octet_length(encode(doc_id::VARCHAR)) + octet_length(encode(coalesce(text, ''))) > 65535 THEN 'too_large' WHEN doc_id % 97 = 0 THEN 'stop' WHEN doc_id % 3 = 0 THEN 'fatal' ELSE 'ok' END AS state FROM documents) GROUP BY state""")
def record_validity(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    op = F.when(F.col("doc_id") % 3 == 0, 3).otherwise(1)
    state = wal.record_state(F.octet_length(F.col("doc_id").cast("string")), F.octet_length(F.coalesce("text", F.lit(""))), op, F.col("doc_id") % 97 != 0)
    return d.groupBy(state.alias("state")).agg(F.count("*").alias("records"))


# a segment that ends within a record: how much of it is there decides
@query(f"""WITH {SEGMENTS}, p AS (SELECT *, seq % 40 AS present FROM seg) SELECT state, count(*) AS records FROM (SELECT CASE WHEN present < 7 THEN 'clean_eof' WHEN present < 21 + klen + vlen AND present < 39 THEN 'fatal' WHEN seq % 97 = 0 THEN 'stop' ELSE 'ok' END AS state FROM p) GROUP BY state""")
def tail_states(spark, sf_dir):
    size = scalar.record_bytes(F.col("klen"), F.col("vlen"))
    present = F.when(F.col("seq") % 40 == 39, size).otherwise(F.col("seq") % 40)
    state = wal.record_state(F.col("klen"), F.col("vlen"), F.lit(1), F.col("seq") % 97 != 0, present)
    return segmented(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("records"))


_little = lambda x, n: f"list_transform(range({n}), lambda i: ({x} >> (8 * i)) & 255)"
_ascii = lambda x: f"list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i, 1))::BIGINT)"
CHECKSUMS = f"""WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
e AS (SELECT event_id, concat_ws(':', user_id, event_type) AS k, props AS v, epoch(date_trunc('second', ts))::BIGINT AS secs FROM events),
b AS (SELECT event_id, list_concat({_little("(length(k) + length(v) + 14)", 2)}, [1], {_little("secs", 8)}, {_little("length(k)", 2)}, {_ascii("k")}, {_little("length(v)", 4)}, {_ascii("v")})::BIGINT[] AS bytes FROM e)
SELECT event_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM b, tab"""


@query(CHECKSUMS)
def record_checksums(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return e.select("event_id", scalar.record_checksum(F.lit(1), F.unix_seconds(F.col("ts").cast("timestamp")), key, F.col("props")).alias("crc"))


REPLICAS = "replicas(replica, last_synced) AS (VALUES ('a', 0), ('b', 3), ('c', 1000000))"


def replicas(spark):
    return spark.createDataFrame([("a", 0), ("b", 3), ("c", 1_000_000)], "replica string, last_synced int")


@query(f"""WITH {SEGMENTS}, {REPLICAS}, closed AS (SELECT segment, count(*) AS records FROM seg WHERE segment < (SELECT max(segment) FROM seg) GROUP BY segment)
SELECT replica, last_synced, count(segment) AS segments_behind, coalesce(sum(records), 0)::BIGINT AS records_behind FROM replicas LEFT JOIN closed ON segment > last_synced GROUP BY ALL""")
def replica_lag(spark, sf_dir):
    return wal.replica_lag(segmented(spark, sf_dir), replicas(spark)).drop("next_segment")


@query(f"""WITH {SEGMENTS}, {REPLICAS}, closed AS (SELECT DISTINCT segment FROM seg WHERE segment < (SELECT max(segment) FROM seg))
SELECT replica, min(segment) AS next_segment FROM replicas LEFT JOIN closed ON segment > last_synced GROUP BY replica""")
def replica_next(spark, sf_dir):
    return wal.replica_lag(segmented(spark, sf_dir), replicas(spark)).select("replica", "next_segment")


# metrics: purchases and signups are writes, errors are misses, the value stands for microseconds

OPS = "ops AS (SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, event_type, CASE WHEN event_type IN ('purchase', 'signup') THEN 'PUT' ELSE 'GET' END AS verb, event_type <> 'error' AS hit, round(value * 100)::BIGINT AS latency_us, octet_length(encode(props))::BIGINT AS bytes FROM events)"
COUNTERS = "count(*) FILTER (verb = 'PUT') AS writes_total, coalesce(sum(bytes) FILTER (verb = 'PUT'), 0)::BIGINT AS writes_bytes, count(*) FILTER (verb = 'GET') AS reads_total, count(*) FILTER (verb = 'GET' AND hit) AS reads_hits, count(*) FILTER (verb = 'GET' AND NOT hit) AS reads_misses"


def ops(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    verb = F.when(F.col("event_type").isin("purchase", "signup"), "PUT").otherwise("GET")
    hour = F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return e.select(hour.alias("hour"), "event_type", verb.alias("verb"), (F.col("event_type") != "error").alias("hit"), F.round(F.col("value") * 100).cast("long").alias("latency_us"), F.octet_length("props").cast("long").alias("bytes"))


@query(f"WITH {OPS} SELECT {COUNTERS} FROM ops")
def op_counters(spark, sf_dir):
    return metrics.operation_counters(ops(spark, sf_dir))


@query(f"WITH {OPS}, c AS (SELECT hour, {COUNTERS} FROM ops GROUP BY hour) SELECT hour, CASE WHEN reads_total = 0 THEN 0 ELSE reads_hits / reads_total END AS read_hit_rate, 1 - CASE WHEN reads_total = 0 THEN 0 ELSE reads_hits / reads_total END AS read_miss_rate FROM c")
def hit_rates(spark, sf_dir):
    return metrics.read_rates(metrics.operation_counters(ops(spark, sf_dir), "hour")).select("hour", "read_hit_rate", "read_miss_rate")


@query(f"""WITH {OPS}, r AS (SELECT event_type, latency_us, row_number() OVER (PARTITION BY event_type ORDER BY latency_us) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM ops)
SELECT event_type, max(n) AS n, max(latency_us) FILTER (rn = floor((n - 1) * 0.5::DOUBLE) + 1) AS p50, max(latency_us) FILTER (rn = floor((n - 1) * 0.99::DOUBLE) + 1) AS p99 FROM r GROUP BY event_type""")
def latency_pctl_lower(spark, sf_dir):
    return metrics.lower_percentiles(ops(spark, sf_dir), "latency_us", ["event_type"], [0.5, 0.99])


HOURS = f"{OPS}, hours AS (SELECT hour, {COUNTERS} FROM ops GROUP BY hour)"


@query(f"WITH {HOURS} SELECT hour, writes_total, reads_total, coalesce(greatest(0, writes_total - lag(writes_total) OVER (ORDER BY hour)), 0) AS writes_total_delta, coalesce(greatest(0, reads_total - lag(reads_total) OVER (ORDER BY hour)), 0) AS reads_total_delta FROM hours")
def throughput_delta(spark, sf_dir):
    hours = metrics.operation_counters(ops(spark, sf_dir), "hour").select("hour", "writes_total", "reads_total")
    return metrics.deltas(hours, "hour", "writes_total", "reads_total")


@query(f"WITH {HOURS} SELECT hour, count(*) OVER w AS samples, (sum(reads_total) OVER w)::BIGINT AS reads_total_sum, max(reads_total) OVER w AS reads_total_max FROM hours WINDOW w AS (ORDER BY hour ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def rolling_60(spark, sf_dir):
    hours = metrics.operation_counters(ops(spark, sf_dir), "hour").select("hour", "reads_total")
    return metrics.rolling(hours, "hour", "reads_total").drop("reads_total")


@query(f"""WITH {RUN_ROWS}, c AS (SELECT sum(klen + vlen + 8)::BIGINT AS bytes_in, sum(vlen)::BIGINT AS writes_bytes FROM runs), o AS (SELECT sum(klen + vlen + 8)::BIGINT AS bytes_out FROM (SELECT * FROM runs {NEWEST}))
SELECT bytes_in, bytes_out, writes_bytes, CASE WHEN bytes_in = 0 THEN 0 ELSE 1 - bytes_out / bytes_in END AS space_savings, CASE WHEN writes_bytes = 0 THEN 1 ELSE bytes_out / writes_bytes END AS write_amplification FROM c, o""")
def savings_and_amp(spark, sf_dir):
    return savings(spark, sf_dir)


def savings(spark, sf_dir):
    r = run_rows(spark, sf_dir)
    made = compaction.merge_stats(r, F.col("klen") + F.col("vlen") + 8).select("bytes_in", "bytes_out")
    return metrics.space_rates(made.join(r.agg(F.sum("vlen").alias("writes_bytes")), F.lit(True)))


@query(f"WITH {FILTERS}, c AS (SELECT run_id, stored + false_positives AS bloom_hits, absent - false_positives AS bloom_misses, false_positives AS bloom_false_positives FROM outcomes) SELECT run_id, bloom_hits / (bloom_hits + bloom_misses) AS bloom_hit_rate, bloom_false_positives / (bloom_hits + bloom_misses) AS bloom_fp_rate FROM c")
def bloom_rates(spark, sf_dir):
    return metrics.bloom_rates(bloom_counters(probe_outcomes(spark, sf_dir))).select("run_id", "bloom_hit_rate", "bloom_fp_rate")


def bloom_counters(outcomes):
    """A hit is a key that the filter lets pass, a miss one that it rejects."""
    hits = F.col("stored") - F.col("false_negatives") + F.col("false_positives")
    return outcomes.withColumns({"bloom_hits": hits, "bloom_misses": F.col("stored") + F.col("absent") - hits, "bloom_false_positives": F.col("false_positives")})


# changes of gauges: each event type is one, set by every fiftieth event
CHANGES = "changes AS (SELECT event_type AS name, event_id AS seq, CASE WHEN event_id % 50 = 0 THEN 'set' WHEN event_id % 4 = 0 THEN 'inc' WHEN event_id % 4 = 1 THEN 'dec' WHEN event_id % 4 = 2 THEN 'add' ELSE 'sub' END AS verb, event_id % 17 AS amount FROM events)"


@query(f"""WITH {CHANGES}, l AS (SELECT *, max(seq) FILTER (verb = 'set') OVER (PARTITION BY name) AS last_set FROM changes)
SELECT name, sum(CASE WHEN seq < last_set THEN 0 ELSE CASE verb WHEN 'inc' THEN 1 WHEN 'dec' THEN -1 WHEN 'sub' THEN -amount ELSE amount END END)::BIGINT AS value, count(*) AS changes FROM l GROUP BY name""")
def gauge_values(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    i = F.col("event_id")
    verb = F.when(i % 50 == 0, "set").when(i % 4 == 0, "inc").when(i % 4 == 1, "dec").when(i % 4 == 2, "add").otherwise("sub")
    return metrics.gauges(e.select(F.col("event_type").alias("name"), i.alias("seq"), verb.alias("verb"), (i % 17).alias("amount")))


# a histogram of a thousand values, chosen by a digest in place of a random number
@query(f"""WITH s AS (SELECT round(value * 100)::BIGINT AS v FROM events ORDER BY {_digest.format("event_id::VARCHAR", 1)}, event_id LIMIT 1000), r AS (SELECT v, row_number() OVER (ORDER BY v) AS rn, count(*) OVER () AS n FROM s)
SELECT max(n) AS n, max(v) FILTER (rn = floor((n - 1) * 0.99::DOUBLE) + 1) AS p99 FROM r""")
def histogram_sampled(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.round(F.col("value") * 100).cast("long").alias("v"), F.struct(scalar.digest(F.col("event_id").cast("string")), "event_id").alias("o"))
    return metrics.sampled_percentile(e, "v", 0.99, keep=1000, order=F.col("o"))


# a whole snapshot of an engine that holds the runs
SNAPSHOT = f"""{FILTERS}, {OPS}, c AS (SELECT {COUNTERS} FROM ops),
lat AS (SELECT verb, latency_us, row_number() OVER (PARTITION BY verb ORDER BY latency_us) AS rn, count(*) OVER (PARTITION BY verb) AS n FROM ops),
pct AS (SELECT verb, max(latency_us) FILTER (rn = floor((n - 1) * 0.5::DOUBLE) + 1) AS p50, max(latency_us) FILTER (rn = floor((n - 1) * 0.99::DOUBLE) + 1) AS p99 FROM lat GROUP BY verb),
kept AS (SELECT klen, vlen FROM runs {NEWEST}), sums AS (SELECT count(DISTINCT run_id) AS run_count, sum(klen + vlen + 8)::BIGINT AS run_bytes, sum(21 + klen + vlen)::BIGINT AS log_bytes FROM runs),
snap AS (SELECT c.*, run_count AS flushes_total, run_count // 4 AS compactions_total, w.p50 AS write_p50, w.p99 AS write_p99, g.p50 AS read_p50, g.p99 AS read_p99, w.p50 * 2 AS flush_p50, w.p99 * 2 AS flush_p99,
  (SELECT sum(48 + klen + vlen)::BIGINT FROM kept) AS memtable_bytes, (SELECT count(*) FROM kept) AS memtable_entries, 1 AS immutable_count, run_count AS sstable_count, log_bytes AS wal_bytes, run_bytes + log_bytes AS disk_bytes,
  run_bytes AS bytes_in, (SELECT sum(klen + vlen + 8)::BIGINT FROM kept) AS bytes_out, o.*, (SELECT max(hour) - min(hour) FROM ops) AS uptime_seconds
  FROM c, sums, (SELECT * FROM pct WHERE verb = 'PUT') w, (SELECT * FROM pct WHERE verb = 'GET') g,
  (SELECT sum(stored - false_negatives + false_positives)::BIGINT AS bloom_hits, sum(absent - false_positives + false_negatives)::BIGINT AS bloom_misses, sum(false_positives)::BIGINT AS bloom_false_positives FROM outcomes) o),
full_snap AS (SELECT *, reads_hits / reads_total AS read_hit_rate, 1 - reads_hits / reads_total AS read_miss_rate, bloom_hits / (bloom_hits + bloom_misses) AS bloom_hit_rate, bloom_false_positives / (bloom_hits + bloom_misses) AS bloom_fp_rate,
  1 - bytes_out / bytes_in AS space_savings, bytes_out / writes_bytes AS write_amplification FROM snap)"""


def snapshot(spark, sf_dir):
    """One row with every metric."""
    o, r = ops(spark, sf_dir), run_rows(spark, sf_dir)
    counters = metrics.operation_counters(o)
    latency = metrics.lower_percentiles(o, "latency_us", ["verb"], [0.5, 0.99])
    pick = lambda verb, p: F.max(F.when(F.col("verb") == verb, F.col(p)))
    latency = latency.agg(*(pick(verb, p).alias(f"{name}_{p}") for verb, name in (("PUT", "write"), ("GET", "read")) for p in ("p50", "p99")))
    latency = latency.withColumns({"flush_p50": F.col("write_p50") * 2, "flush_p99": F.col("write_p99") * 2})
    kept = resolve.latest(r).agg(F.sum(scalar.memory_bytes(F.col("klen"), F.col("vlen"))).alias("memtable_bytes"), F.count("*").alias("memtable_entries"), F.sum(F.col("klen") + F.col("vlen") + 8).alias("bytes_out"))
    sums = r.agg(F.countDistinct("run_id").alias("sstable_count"), F.sum(F.col("klen") + F.col("vlen") + 8).alias("bytes_in"), F.sum(scalar.record_bytes(F.col("klen"), F.col("vlen"))).alias("wal_bytes"))
    probes = bloom_counters(probe_outcomes(spark, sf_dir)).agg(*(F.sum(c).alias(c) for c in ("bloom_hits", "bloom_misses", "bloom_false_positives")))
    up = o.agg((F.max("hour") - F.min("hour")).alias("uptime_seconds"))
    row = reduce(lambda a, b: a.join(b, F.lit(True)), [latency, kept, sums, probes, up], counters)
    row = row.withColumns({"flushes_total": F.col("sstable_count"), "compactions_total": F.floor(F.col("sstable_count") / 4).cast("long"), "immutable_count": F.lit(1).cast("long"), "disk_bytes": F.col("bytes_in") + F.col("wal_bytes")})
    return metrics.space_rates(metrics.bloom_rates(metrics.read_rates(row)))


#: Where a series has another name than the metric.
SERIES_OF = {"reads_hits_total": "reads_hits", "reads_misses_total": "reads_misses", "write_latency_p50_us": "write_p50", "write_latency_p99_us": "write_p99", "read_latency_p50_us": "read_p50", "read_latency_p99_us": "read_p99", "memtable_size_bytes": "memtable_bytes", "disk_usage_bytes": "disk_bytes", "wal_size_bytes": "wal_bytes", "bloom_filter_hit_rate": "bloom_hit_rate", "bloom_filter_fp_rate": "bloom_fp_rate", "compaction_space_savings": "space_savings"}
_rate = lambda name: name.endswith(("rate", "savings", "amplification"))


def _told(name: str) -> str:
    col = SERIES_OF.get(name, name)
    return f"printf('%.6f', {col}::DOUBLE)" if _rate(name) else f"{col}::VARCHAR"


@query(f"WITH {SNAPSHOT} " + " UNION ALL ".join(
    f"SELECT {3 * i + j}::BIGINT AS line_no, {text} AS line FROM full_snap"
    for i, (name, kind, told) in enumerate(metrics.SERIES)
    for j, text in enumerate((f"'# HELP engine_{name} {told}'", f"'# TYPE engine_{name} {kind}'", f"'engine_{name} ' || {_told(name)}"))
))
def prometheus_all(spark, sf_dir):
    """All series of the scrape format."""
    shown = lambda name: F.format_string("%.6f", F.col(SERIES_OF.get(name, name))) if _rate(name) else F.col(SERIES_OF.get(name, name)).cast("string")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), shown(n).alias("shown")) for n, _, _ in metrics.SERIES]))
    return metrics.prometheus(snapshot(spark, sf_dir).select(pairs.alias("p")).select("p.name", "p.shown"))


def _summary_sql() -> str:
    def told(form: str, cols: list[str]) -> str:
        values = []
        for c in cols:
            name, _, how = c.partition(":")
            values.append(f"{name} // 1048576" if how == "mb" else f"({name} * 100.0)::DOUBLE" if how == "pct" else f"{name}::DOUBLE" if "f" in form else name)
        return f"printf('{form}', {', '.join(values)})"

    lines = [line for title, rows in metrics.SUMMARY for line in (f"'{title}:'", *(f"'  {label}: ' || {told(form, cols)}" for label, form, cols in rows))]
    return " UNION ALL ".join(f"SELECT {i}::BIGINT AS line_no, {line} AS line FROM full_snap" for i, line in enumerate(lines))


@query(f"WITH {SNAPSHOT} {_summary_sql()}")
def summary_all(spark, sf_dir):
    """All sections of the text summary."""
    return metrics.summary(snapshot(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("write_p50", "write_p99", "read_p50", "read_p99", "flush_p50", "flush_p99")}))


WHOLE = ["writes_total", "writes_bytes", "reads_total", "reads_hits", "reads_misses", "flushes_total", "compactions_total", "write_p50", "write_p99", "read_p50", "read_p99", "memtable_bytes", "memtable_entries", "immutable_count", "sstable_count", "wal_bytes", "disk_bytes", "bloom_hits", "bloom_misses", "bloom_false_positives", "bytes_in", "bytes_out"]


@query(f"""WITH {SNAPSHOT} SELECT '{{"node_id":"node-1","uptime_seconds":' || uptime_seconds || ',"storage_metrics":{{' || {" || ',' || ".join(f"'{chr(34)}{c}{chr(34)}:' || {c}" for c in WHOLE)} || '}}}}' AS body FROM full_snap""")
def json_all(spark, sf_dir):
    """The counters, gauges and percentiles of the JSON body."""
    return metrics.as_json(snapshot(spark, sf_dir).select(F.lit("node-1").alias("node_id"), "uptime_seconds", *WHOLE))


SHOWN = [("writes_total", "Total write operations", "counter", "writes_total"), ("reads_total", "Total read operations", "counter", "reads_total"), ("reads_hits_total", "Total read hits", "counter", "reads_hits"), ("reads_misses_total", "Total read misses", "counter", "reads_misses")]


@query(f"WITH {OPS}, c AS (SELECT {COUNTERS} FROM ops) " + " UNION ALL ".join(
    f"SELECT {3 * i + j} AS line_no, {text} AS line FROM c"
    for i, (name, shown, kind, col) in enumerate(SHOWN)
    for j, text in enumerate((f"'# HELP engine_{name} {shown}'", f"'# TYPE engine_{name} {kind}'", f"'engine_{name} ' || {col}"))
))
def prometheus_text(spark, sf_dir):
    c = metrics.operation_counters(ops(spark, sf_dir))
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(col).cast("string").alias("shown")) for name, _, _, col in SHOWN]))
    return metrics.prometheus(c.select(pairs.alias("p")).select("p.name", "p.shown"))


@query(f"""WITH {HOURS} SELECT '{{"node_id":"node-1","uptime_seconds":' || (hour - (SELECT min(hour) FROM hours)) || ',"storage_metrics":{{"writes_total":' || writes_total || ',"writes_bytes":' || writes_bytes || ',"reads_total":' || reads_total || ',"reads_hits":' || reads_hits || ',"reads_misses":' || reads_misses || '}}}}' AS body FROM hours""")
def metrics_json(spark, sf_dir):
    hours = metrics.operation_counters(ops(spark, sf_dir), "hour")
    first = hours.agg(F.min("hour").alias("first_hour"))
    rows = hours.join(F.broadcast(first), F.lit(True)).withColumns({"node_id": F.lit("node-1"), "uptime_seconds": F.col("hour") - F.col("first_hour")})
    return metrics.as_json(rows.drop("hour", "first_hour"))


@query(f"""WITH {OPS}, c AS (SELECT {COUNTERS} FROM ops) SELECT 0::BIGINT AS line_no, 'Operations:' AS line UNION ALL SELECT 1, format('  Writes: {{}} ({{}} MB)', writes_total, writes_bytes // 1048576) FROM c
UNION ALL SELECT 2, format('  Reads: {{}} (hits: {{}}, misses: {{}})', reads_total, reads_hits, reads_misses) FROM c
UNION ALL SELECT 3, 'Read Performance:' UNION ALL SELECT 4, format('  Hit Rate: {{:.2f}}%', 100.0 * (reads_hits / reads_total)) FROM c UNION ALL SELECT 5, format('  Miss Rate: {{:.2f}}%', 100.0 * (1 - reads_hits / reads_total)) FROM c""")
def metrics_summary(spark, sf_dir):
    return metrics.summary(metrics.read_rates(metrics.operation_counters(ops(spark, sf_dir))))


@query(f"""WITH {HOURS} SELECT hour, format('{{:,}}', reads_total * 12345) AS reads_shown, format('{{}}h {{}}m {{}}s', (hour + 75) % 90000 // 3600, (hour + 75) % 3600 // 60, (hour + 75) % 60) AS uptime_shown, lpad(((hour + 75) % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(((hour + 75) % 60)::VARCHAR, 2, '0') AS label FROM hours""")
def display_formats(spark, sf_dir):
    hours = metrics.operation_counters(ops(spark, sf_dir), "hour")
    at = F.col("hour") + 75
    return hours.select("hour", scalar.thousands(F.col("reads_total") * 12345).alias("reads_shown"), scalar.uptime(at % 90000).alias("uptime_shown"), scalar.minute_label(at).alias("label"))


# the line protocol: events as commands

LINES = """lines AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'get ' || user_id || ':click' WHEN 'click' THEN chr(9) || ' PUT ' || user_id || ':click ' || props || ' ' WHEN 'signup' THEN 'Get' WHEN 'error' THEN 'delete ' || user_id ELSE 'PUT  ' || user_id || ' x' END AS line FROM events),
cut AS (SELECT event_id, line, string_split(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), ' ') AS p FROM lines),
parsed AS (SELECT event_id, nullif(upper(p[1]), '') AS verb, p[2] AS key, CASE WHEN len(p) > 2 THEN array_to_string(p[3:], ' ') END AS value FROM cut),
commands AS (SELECT *, CASE WHEN verb IS NULL THEN NULL WHEN verb = 'PUT' AND value IS NULL THEN 'ERROR usage: PUT <key> <value>' WHEN verb = 'GET' AND key IS NULL THEN 'ERROR usage: GET <key>'
  WHEN verb = 'DELETE' THEN 'ERROR DELETE not yet implemented (tombstone support pending)' WHEN verb NOT IN ('PUT', 'GET') THEN 'ERROR unknown command-supported: PUT, GET, DELETE' END AS error FROM parsed)"""


def commands(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    line = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("get "), user, F.lit(":click")))
        .when(F.col("event_type") == "click", F.concat(F.lit("\t PUT "), user, F.lit(":click "), "props", F.lit(" ")))
        .when(F.col("event_type") == "signup", "Get")
        .when(F.col("event_type") == "error", F.concat(F.lit("delete "), user))
        .otherwise(F.concat(F.lit("PUT  "), user, F.lit(" x")))
    )
    return wire.parse(e.select("event_id", line.alias("line")))


@query(f"WITH {LINES} SELECT event_id, verb, key, value, error FROM commands")
def parse_commands(spark, sf_dir):
    return commands(spark, sf_dir).select("event_id", "verb", "key", "value", "error")


@query(f"""WITH {LINES}, {LOG}, got AS (SELECT key, '{{"value":' || seq || '}}' AS v FROM log {NEWEST})
SELECT event_id, CASE WHEN verb IS NULL THEN NULL WHEN error IS NOT NULL THEN error WHEN verb = 'PUT' THEN 'OK' WHEN v IS NOT NULL THEN 'VALUE ' || v ELSE 'NOT_FOUND' END AS reply FROM commands LEFT JOIN got ON verb = 'GET' AND got.key = commands.key""")
def reply_lines(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("value", F.format_string('{"value":%d}', "seq"))
    return wire.replies(commands(spark, sf_dir), log).select("event_id", "reply")


# streams: the final state answers as the batch query does


@query(ORACLES["lww_latest"])
def stream_lww(spark, sf_dir):
    from ..streaming import ingest

    return ingest.latest_of_stream(ingest.event_stream(spark, sf_dir), folder(spark)).select("key", "value", "ts", "seq")


@query(ORACLES["lww_latest"])
def stream_lww_state(spark, sf_dir):
    from ..streaming import ingest

    return ingest.latest_by_state(ingest.event_stream(spark, sf_dir), folder(spark)).select("key", "value", "ts", "seq")


@query(f"WITH {LOG}, w AS (SELECT ts - ts % 21600 AS window_start, count(*) AS n, sum(value) AS total FROM log GROUP BY 1) SELECT window_start, n, round(total, 4) AS total FROM w WHERE window_start + 21600 <= (SELECT max(ts) FROM log) - 3600")
def stream_windows(spark, sf_dir):
    """Windows that the watermark, an hour behind the last event, has passed."""
    from ..streaming import ingest

    out = ingest.windowed_counts(ingest.event_stream(spark, sf_dir), "1 hour", "6 hours", folder(spark))
    return out.withColumn("total", F.round("total", 4))


@query(ORACLES["lww_latest"])
def stream_flush(spark, sf_dir):
    from ..streaming import ingest

    return resolve.latest(ingest.flush_stream(ingest.event_stream(spark, sf_dir), folder(spark))).select("key", "value", "ts", "seq")


# the durable store: the events go in by quarters, which become segments and, when flushed, runs

QUARTERS = f"{LOG}, q AS (SELECT key, seq::VARCHAR AS value, seq, (seq * 4 // (SELECT max(seq) + 1 FROM log))::BIGINT AS quarter, octet_length(encode(key))::BIGINT AS klen, octet_length(encode(seq::VARCHAR))::BIGINT AS vlen FROM log)"
LAST = "QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"


def filled_store(spark, sf_dir, flushed: int) -> Store:
    """A store of the events in four segments, of which the first ones are flushed."""
    store = Store(spark, f"{folder(spark)}/store-{uuid.uuid4().hex}", clock=lambda: 1000.0, compaction_on=False)
    log = events_log(spark, sf_dir).select("key", F.col("seq").cast("string").alias("value"), "seq")
    top = log.agg(F.max("seq")).first()[0]
    for quarter in range(4):
        store.put_all(log.where(F.floor(F.col("seq") * 4 / (top + 1)) == quarter), "seq")
        if quarter < flushed:
            store.flush()
    return store


@query(f"WITH {QUARTERS} SELECT key, value FROM (SELECT * FROM q {LAST}) WHERE key >= '1' AND key < '4'")
def store_scan(spark, sf_dir):
    """Memory over runs."""
    return filled_store(spark, sf_dir, 3).scan("1", "4").select("key", "value")


@query(f"WITH {QUARTERS}, {WANTED}, got AS (SELECT * FROM q {LAST}) SELECT w.key, value, value IS NOT NULL AS found FROM wanted w LEFT JOIN got USING (key)")
def store_compact_reopen(spark, sf_dir):
    """Reads from a store opened anew after a compaction."""
    store = filled_store(spark, sf_dir, 4)
    store.compact(least=2)
    again = Store(spark, store.path, clock=store.clock)
    keys = load(spark, sf_dir, "customer").select(F.concat_ws(":", F.col("c_custkey").cast("string"), F.lit("view")).alias("key"))
    return again.multi_get(keys).select("key", "value", "found")


@query(f"""WITH {QUARTERS}, runs AS (SELECT quarter, count(DISTINCT key) AS n FROM q WHERE quarter < 2 GROUP BY quarter), mem AS (SELECT * FROM q WHERE quarter >= 2 {LAST})
SELECT (SELECT count(*) FROM mem) AS memtable_entries, (SELECT sum(48 + klen + vlen)::BIGINT FROM mem) AS memtable_bytes, (SELECT count(*) FROM runs) AS sstable_count, (SELECT sum(n)::BIGINT FROM runs) AS sstable_entries, (SELECT sum(21 + klen + vlen)::BIGINT FROM q) AS wal_bytes""")
def store_stats(spark, sf_dir):
    """E10, E15, W2, W8."""
    return filled_store(spark, sf_dir, 2).stats().select("memtable_entries", "memtable_bytes", "sstable_count", "sstable_entries", "wal_bytes")


@query(f"WITH {QUARTERS} SELECT quarter + 1 AS segment, count(*) AS records, min(seq) AS first_value, max(seq) AS last_value FROM q WHERE quarter >= 1 GROUP BY quarter")
def store_cleanup(spark, sf_dir):
    """The segments that stay, read one by one, when two are flushed and a replica needs the second."""
    store = filled_store(spark, sf_dir, 2)
    store.cleanup(replica_segment=2)
    log = Store(spark, store.path, clock=store.clock).log()
    kept = [n for n in range(1, 5) if n == wal.current_segment(log) or wal.is_available(log, n)]
    number = F.col("value").cast("long")
    parts = [wal.read_segment(log, n).groupBy("segment").agg(F.count("*").alias("records"), F.min(number).alias("first_value"), F.max(number).alias("last_value")) for n in kept]
    return reduce(DataFrame.union, parts)


# extensions


@query(f"WITH {LOG}, o AS (SELECT *, CASE WHEN seq % 7 = 0 THEN 'delete' ELSE 'put' END AS op FROM log) SELECT key, value, ts, seq FROM (SELECT * FROM o {NEWEST}) WHERE op <> 'delete'")
def tombstone_latest(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("op", F.when(F.col("seq") % 7 == 0, "delete").otherwise("put"))
    return resolve.live(log).select("key", "value", "ts", "seq")


@query(f"WITH {LOG}, m AS (SELECT (min(ts) + max(ts)) // 2 AS t FROM log) SELECT key, value, ts, seq FROM log, m WHERE ts <= t {NEWEST}")
def as_of_get(spark, sf_dir):
    log = events_log(spark, sf_dir)
    middle = log.agg(F.floor((F.min("ts") + F.max("ts")) / 2)).first()[0]
    return resolve.as_of(log, middle).select("key", "value", "ts", "seq")


@query("SELECT count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def time_pruned_scan(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    rows = e.where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz")))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {LOG} SELECT ts - ts % 21600 AS window_start, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT key) AS keys FROM log GROUP BY 1")
def windowed_rollup(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return log.groupBy((F.col("ts") - F.col("ts") % 21600).alias("window_start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("key").alias("keys"))
