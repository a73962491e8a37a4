import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.functions import scalar
from tidemark.operators import bloom, buckets, compaction, metrics, runs, wal


def one(df, col):
    return df.select(col).first()[0]


# buckets


def test_cumulative_over_shards(spark):
    rnd = random.Random(1)
    sizes = [rnd.randint(1, 90) for _ in range(500)]
    df = spark.createDataFrame([(i * 3, s) for i, s in enumerate(sizes)], "seq long, size long")
    got = {r.seq: r.bucket for r in buckets.cumulative(df, F.col("size"), 256, shard=64).collect()}
    total = 0
    for i, s in enumerate(sizes):
        assert got[i * 3] == total // 256
        total += s


def test_resetting_runs_charge_overwrites_the_difference(spark):
    rnd = random.Random(2)
    rows = [(i, f"k{rnd.randrange(30)}", rnd.choice([0, 5, 40])) for i in range(600)]
    df = spark.createDataFrame([(i, k, len(k), v) for i, k, v in rows], "seq long, key string, klen long, vlen long")
    table, used, want = {}, 0, []
    for _, k, v in rows:
        used += v - table[k] if table.get(k) else len(k) + v + 48
        table[k] = v
        if used >= 500:
            want.append((len(want), len(table), used, min(table), max(table), True))
            table, used = {}, 0
    if table:
        want.append((len(want), len(table), used, min(table), max(table), False))
    got = sorted((r.run, r.entries, r.bytes, r.min_key, r.max_key, r.closed) for r in buckets.resetting(df, 500, shards=1).collect())
    assert got == want
    assert buckets.resetting(df.limit(0), 500).collect() == []


# runs


def run_rows(spark, keys):
    return spark.createDataFrame([(0, k, i, i, len(k), 10) for i, k in enumerate(keys)], "run_id long, key string, ts long, seq long, klen long, vlen long")


def test_prefixes_restart_in_each_block(spark):
    keys = [f"sensor_{i:03d}" for i in range(20)]
    got = {r.key: (r.block, r.shared, r.entry_bytes) for r in runs.entries(run_rows(spark, keys), 28 * 8).collect()}
    for i, k in enumerate(keys):
        shared = 0 if i % 8 == 0 else 9 if i % 10 else 8
        assert got[k] == (i // 8, shared, 3 + 10 - shared + 10 + 8)


def test_fences(spark):
    index = runs.fences(runs.entries(run_rows(spark, ["b", "d", "f", "h"]), 38))
    assert [(r.block, r.first_key, r.entries) for r in index.orderBy("block").collect()] == [(0, "b", 2), (1, "f", 2)]
    probes = spark.createDataFrame([(0, k) for k in "abcdefgz"] + [(7, "a")], "run_id long, key string")
    got = {(r.run_id, r.key): r.block for r in runs.fence_lookup(index, probes).collect()}
    assert got == {(0, "a"): None, (0, "b"): 0, (0, "c"): 0, (0, "d"): 0, (0, "e"): 0, (0, "f"): 1, (0, "g"): 1, (0, "z"): 1, (7, "a"): None}


def test_probes_of_one_run_are_dealt_over_lanes(spark):
    rnd = random.Random(4)
    keys = sorted({f"k{rnd.randrange(10**6):06d}" for _ in range(300)})
    index = runs.fences(runs.entries(run_rows(spark, keys), 100))
    firsts = {r.block: r.first_key for r in index.collect()}
    asked = [f"k{rnd.randrange(10**6):06d}" for _ in range(500)] + keys
    probes = spark.createDataFrame([(0, k) for k in asked], "run_id long, key string")
    for lanes in (1, 8):
        got = {r.key: r.block for r in runs.fence_lookup(index, probes, lanes).collect()}
        assert got == {k: max((b for b, f in firsts.items() if f <= k), default=None) for k in asked}
    plan = runs.fence_lookup(index, probes)._jdf.queryExecution().optimizedPlan().toString()
    assert any("Window" in x and "lane" in x for x in plan.splitlines())


def test_order_audit(spark):
    assert one(runs.order_audit(run_rows(spark, ["a", "c", "b", "b", "d"])), "out_of_order") == 2


def test_expressions(spark):
    df = spark.createDataFrame([("sensor_1", "sensor_2"), ("", "a"), ("ab", "ab"), ("ab", "abc"), (None, "x"), ("x", "y")], "a string, b string")
    assert [r[0] for r in df.select(scalar.shared_prefix(F.col("a"), F.col("b"))).collect()] == [7, 0, 2, 2, 0, 0]
    sizes = {0: 1, 127: 1, 128: 2, 16383: 2, 16384: 3, 2097151: 3, 2097152: 4, 2**35: 6}
    df = spark.createDataFrame([(x,) for x in sizes], "x long")
    assert {r.x: r.n for r in df.select("x", scalar.varint_bytes(F.col("x")).alias("n")).collect()} == sizes
    row = spark.range(1).select(scalar.uptime(F.lit(3725)), scalar.uptime(F.lit(3725), padded=True), scalar.thousands(F.lit(1234567)), scalar.minute_label(F.lit(3725)), scalar.trimmed(F.lit("\t a b \r\n")), scalar.lossy_text(F.lit(b"a\xffb")), scalar.thousands(F.lit(None).cast("long"))).first()
    assert tuple(row) == ("1h 2m 5s", "1h 02m 05s", "1,234,567", "02:05", "a b", "a�b", "-")


def test_record_checksum(spark):
    key, value = b"k\xc3\xa9y", b'{"a": 1}'
    payload = (len(key) + len(value) + 14).to_bytes(2, "little") + b"\x01" + (1_700_000_000).to_bytes(8, "little") + len(key).to_bytes(2, "little") + key + len(value).to_bytes(4, "little") + value
    got = spark.range(1).select(scalar.record_checksum(F.lit(1), F.lit(1_700_000_000), F.lit(key), F.lit(value))).first()[0]
    assert got == zlib.crc32(payload)


# compaction


def test_merge_of_two_runs(spark):
    rows = [(1, "key1", "old", 100, 1), (1, "key3", "v3", 100, 2), (2, "key1", "new", 200, 3), (2, "key2", "v2", 200, 4)]
    df = spark.createDataFrame(rows, "run_id long, key string, value string, ts long, seq long")
    assert {r.key: r.value for r in compaction.merge(df).collect()} == {"key1": "new", "key2": "v2", "key3": "v3"}
    s = compaction.merge_stats(df, F.lit(10)).first()
    assert (s.inputs, s.entries_merged, s.duplicates_removed, s.bytes_in, s.bytes_out, s.savings) == (2, 3, 1, 40, 30, 0.25)
    empty = compaction.merge_stats(df.limit(0), F.lit(10)).first()
    assert (empty.inputs, empty.entries_merged, empty.savings) == (0, 0, 0.0)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=0, max_size=25), st.integers(2, 5))
def test_tier_pick_by_plain_rule(spark, sizes, least):
    df = spark.createDataFrame([(0, i, b) for i, b in enumerate(sizes)], "grp int, run_id long, bytes long")
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    best = []
    for n, i in enumerate(order):
        group = [j for j in order[n:] if sizes[j] <= 1.5 * sizes[i]]
        if len(group) >= least and len(group) > len(best):
            best = group
    got = compaction.tier_pick(df, least).first()
    assert (got.members if got else []) == sorted(best)


# Bloom filters


def test_bloom_parameters_and_answers(spark):
    keys = spark.createDataFrame([(0, f"sensor_001_temp_{i}") for i in range(1000)], "run_id long, key string")
    params = bloom.parameters(spark.createDataFrame([(0, 1000)], "run_id long, n long"))
    p = params.first()
    assert (p.m, p.k, p.memory_bytes) == (9586, 7, 1207)
    fixed = bloom.parameters(spark.createDataFrame([(0, 10_000)], "run_id long, n long")).first()
    assert (fixed.m, fixed.k, fixed.memory_bytes) == (95851, 7, 11990)
    bits = bloom.build(keys, params).cache()
    assert bloom.might_contain(keys, params, bits).where("NOT maybe").count() == 0
    absent = spark.createDataFrame([(0, f"sensor_002_temp_{i}") for i in range(1000)], "run_id long, key string")
    assert bloom.might_contain(absent, params, bits).where("maybe").count() < 50
    assert 0.4 < bloom.stats(params, bits).first().fill_ratio < 0.6


def test_bitmaps_over_many_parts_answer_as_sets(spark):
    keys = spark.createDataFrame([(r, f"k{i}") for r, n in ((0, 9000), (1, 1)) for i in range(n)], "run_id long, key string")
    params = bloom.parameters(keys.groupBy("run_id").agg(F.count("*").alias("n")))
    filters = bloom.build(keys, params)
    assert filters.where("run_id = 0").count() == 3
    spots = lambda x: {r.key: (r.run_id, set(r.at)) for r in x.join(params, "run_id").select("run_id", "key", bloom.positions(F.col("key"), F.col("m"), F.col("k")).alias("at")).collect()}
    held = set().union(*(at for _, at in spots(keys.where("run_id = 0")).values()))
    asked = spark.createDataFrame([(0, f"x{i}") for i in range(2000)], "run_id long, key string")
    got = {r.key: r.maybe for r in bloom.might_contain(asked, params, filters).collect()}
    assert got == {k: at <= held for k, (_, at) in spots(asked).items()}
    assert 0 < sum(got.values()) < 60
    assert {r.run_id: r.set_bits for r in bloom.stats(params, filters).collect()}[0] == len(held)


# the log


def test_segments_replay_and_tail(spark):
    df = spark.createDataFrame([(i, f"key_{i}", 5, 1000, 0) for i in range(100)], "seq long, key string, klen long, vlen long, x int")
    cut = wal.segments(df, 20_000).cache()
    sizes = {r.segment: (r.records, r.bytes) for r in wal.segment_sizes(cut).collect()}
    assert sum(r for r, _ in sizes.values()) == 100 and sizes[1] == (20, 20 * 1026) and sorted(sizes) == [1, 2, 3, 4, 5, 6]
    assert [r.segment for r in wal.closed_segments(cut).collect()] == [1, 2, 3, 4, 5]
    assert wal.current_segment(cut) == 6 and wal.is_available(cut, 5) and not wal.is_available(cut, 6) and not wal.is_available(cut, 99)
    assert [r.seq for r in wal.read_segment(cut, 2).collect()] == list(range(20, 20 + sizes[2][0]))
    with pytest.raises(errors.NotFound):
        wal.read_segment(cut, 99)
    replayed = wal.replay(cut, F.col("seq") == 25)
    assert sorted(r.seq for r in replayed.collect()) == [i for i in range(100) if cut_of(sizes, i) != 2 or i < 25]
    lag = {r.replica: (r.segments_behind, r.next_segment) for r in wal.replica_lag(cut, spark.createDataFrame([("a", 0), ("b", 4), ("c", 9)], "replica string, last_synced long")).collect()}
    assert lag == {"a": (5, 1), "b": (1, 5), "c": (0, None)}


def cut_of(sizes, i):
    for s in sorted(sizes):
        if i < sizes[s][0]:
            return s
        i -= sizes[s][0]


@pytest.mark.parametrize(("flushed", "replica", "left"), [(0, 0, []), (3, 0, [1, 2]), (5, 2, [1]), (2, 5, [1])])
def test_retention_keeps_what_replicas_need(spark, flushed, replica, left):
    numbers = spark.createDataFrame([(i,) for i in range(1, 7)], "segment long")
    assert sorted(r.segment for r in wal.deletable(numbers, F.lit(flushed), F.lit(replica)).collect()) == left


def test_record_states(spark):
    rows = [(65_535, 0, 1, True), (10, 65_511, 1, True), (10, 65_512, 1, True), (1, 1, 2, True), (1, 1, 3, True), (1, 1, 1, False), (65_536, 0, 1, True)]
    df = spark.createDataFrame(rows, "k long, v long, op int, good boolean")
    assert [r[0] for r in df.select(wal.record_state(*map(F.col, ("k", "v", "op", "good")))).collect()] == ["too_large", "ok", "too_large", "ok", "fatal", "stop", "too_large"]


def test_sync_steps():
    assert wal.sync_step(0, [1, 2], 3) == (1, True, 0, 0)
    assert wal.sync_step(2, [1, 2], 0) == (2, False, 0, 0)
    assert wal.sync_step(0, [1], 2, ok=False) == (0, False, 3, 3)


# metrics


def test_counters_and_rates(spark):
    rows = [("PUT", False, 7)] * 100 + [("GET", True, 0)] * 50 + [("GET", False, 0)] * 20
    c = metrics.read_rates(metrics.operation_counters(spark.createDataFrame(rows, "verb string, hit boolean, bytes long"))).first()
    assert (c.writes_total, c.writes_bytes, c.reads_total, c.reads_hits, c.reads_misses) == (100, 700, 70, 50, 20)
    none = metrics.read_rates(metrics.operation_counters(spark.createDataFrame([], "verb string, hit boolean, bytes long"))).first()
    assert (none.writes_bytes, none.read_hit_rate, none.read_miss_rate) == (0, 0.0, 1.0)
    b = metrics.bloom_rates(spark.createDataFrame([(75, 25, 5), (0, 0, 0)], "bloom_hits long, bloom_misses long, bloom_false_positives long")).collect()
    assert [(r.bloom_hit_rate, r.bloom_fp_rate) for r in b] == [(0.75, 0.05), (0.0, 0.0)]
    s = metrics.space_rates(spark.createDataFrame([(1000, 300, 600), (0, 0, 0), (10, 20, 5)], "bytes_in long, bytes_out long, writes_bytes long")).collect()
    assert [(round(r.space_savings, 9), r.write_amplification) for r in s] == [(0.7, 0.5), (0.0, 1.0), (-1.0, 4.0)]


@pytest.mark.parametrize("values", [[], [4], list(range(1, 11)), [5, 5, 5, 1, 9], list(range(1000))])
def test_lower_rank_percentiles(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v long")
    got = metrics.lower_percentiles(df, "v", ["g"], [0.5, 0.99]).first()
    if values:
        s = sorted(values)
        assert (got.n, got.p50, got.p99) == (len(s), s[int((len(s) - 1) * 0.5)], s[int((len(s) - 1) * 0.99)])
        assert metrics.sampled_percentile(df, "v", 0.5, keep=10**6).first().p50 == got.p50
    else:
        assert got is None


def test_percentiles_of_skewed_groups(spark):
    rnd = random.Random(7)
    rows = [("even", rnd.random()) for _ in range(700)] + [("tied", 1.5)] * 500 + [(None, float(i % 7)) for i in range(90)]
    rows += [("hot", 0.0)] * 600 + [("hot", rnd.random() ** 9) for _ in range(300)] + [("odd", None), ("odd", 3.0), ("odd", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    ps = [0.0, 0.25, 0.5, 0.99, 1.0]
    for cuts in (2, 32):
        got = {r.g: r for r in metrics.lower_percentiles(df, "v", ["g"], ps, cuts).collect()}
        assert set(got) == {"even", "tied", None, "hot", "odd"}
        for g, r in got.items():
            s = sorted((v for x, v in rows if x == g and v is not None), key=lambda v: (v != v, v))
            assert r.n == len(s)
            assert [str(r[f"p{round(p * 100)}"]) for p in ps] == [str(s[int((len(s) - 1) * p)]) for p in ps]


def test_percentiles_sort_within_buckets_only(spark):
    plan = metrics.lower_percentiles(spark.createDataFrame([("a", 1)], "g string, v long"), "v", ["g"], [0.5])._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window" in x and "_v" in x]
    assert windows and all("_bucket" in x for x in windows)


def test_deltas_and_history(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 9, 3, 3])], "t long, v long")
    assert [r.v_delta for r in metrics.deltas(df, "t", "v").orderBy("t").collect()] == [0, 4, 0, 0]
    assert [(r.samples, r.v_sum, r.v_max) for r in metrics.rolling(df, "t", "v", 2).orderBy("t").collect()] == [(1, 5, 5), (2, 14, 9), (2, 12, 9), (2, 6, 3)]


def test_texts(spark):
    lines = [r.line for r in metrics.prometheus(spark.createDataFrame([("uptime_seconds", "9"), ("writes_total", "3")], "name string, shown string"), "x").collect()]
    assert lines == ["# HELP x_writes_total Total write operations", "# TYPE x_writes_total counter", "x_writes_total 3", "# HELP x_uptime_seconds Server uptime in seconds", "# TYPE x_uptime_seconds gauge", "x_uptime_seconds 9"]
    body = one(metrics.as_json(spark.createDataFrame([("n", 5, 2)], "node_id string, uptime_seconds long, writes_total long")), "body")
    assert body == '{"node_id":"n","uptime_seconds":5,"storage_metrics":{"writes_total":2}}'


def test_error_messages():
    assert str(errors.Corruption("bad block")) == "Corrupted data: bad block" and str(errors.KeyNotFound()) == "Key not found"
    assert all(issubclass(k, errors.StorageError) for k in vars(errors).values() if isinstance(k, type) and issubclass(k, Exception))
