import pytest
from pyspark.sql import functions as F

from tidemark.operators import lookup, resolve


def log(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, ts long, seq long")


def pairs(df):
    return {r.key: r.value for r in df.collect()}


def test_greatest_time_wins_then_sequence(spark):
    df = log(spark, [("a", "new", 5, 1), ("a", "clock went back", 3, 2), ("b", "x", 1, 3), ("b", "y", 1, 4)])
    assert pairs(resolve.latest(df)) == {"a": "new", "b": "y"}
    assert pairs(resolve.latest(df, "log")) == {"a": "clock went back", "b": "y"}
    assert pairs(resolve.latest_value(df)) == pairs(resolve.latest(df))
    with pytest.raises(ValueError):
        resolve.latest(df, "up")


def test_one_hot_key(spark):
    df = log(spark, [("test", f"version{i}", 1, i) for i in range(10)])
    assert pairs(resolve.latest(df)) == {"test": "version9"}


def test_rank_limit_before_the_shuffle(spark):
    plan = resolve.latest(log(spark, [("a", "1", 1, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_deletes_and_as_of(spark):
    df = log(spark, [("a", "1", 1, 1), ("a", "", 2, 2), ("b", "", 1, 3), ("b", "2", 2, 4)]).withColumn("op", F.when(F.col("seq").isin(2, 3), "delete").otherwise("put"))
    assert pairs(resolve.live(df)) == {"b": "2"}
    assert pairs(resolve.live(df, compat_deletes=True)) == {"a": "", "b": "2"}
    assert pairs(resolve.as_of(df, 1).where("op = 'put'")) == {"a": "1"}
    assert resolve.version_counts(df).where("versions = 2 AND first_ts = 1 AND last_ts = 2").count() == 2


def test_hits_misses_and_empty_values(spark):
    df = log(spark, [("key1", "value1", 1, 1), ("empty", "", 1, 2), ("", "empty key", 1, 3)])
    assert pairs(lookup.point_get(df, "key1")) == {"key1": "value1"}
    assert lookup.point_get(df, "absent").count() == 0
    got = lookup.multi_get(df, spark.createDataFrame([("key1",), ("key1",), ("empty",), ("",), ("no",)], "key string")).collect()
    assert {(r.key, r.value, r.found) for r in got} == {("key1", "value1", True), ("empty", "", True), ("", "empty key", True), ("no", None, False)} and len(got) == 4


def test_ranges(spark):
    df = log(spark, [(f"k{i}", f"v{i}", i, i) for i in (3, 1, 5, 2, 4)])
    assert [r.key for r in lookup.scan(df, "k2", "k5").collect()] == ["k2", "k3", "k4"]
    assert [r.key for r in lookup.scan(df, "k2", "k5", inclusive=True).collect()] == ["k2", "k3", "k4", "k5"]
    assert lookup.scan(df, "k2", "k2").count() == 0
    with pytest.raises(ValueError):
        lookup.scan(df, "k5", "k2")


def test_binary_keys_in_byte_order(spark):
    rows = [(bytes(k), b"\0\1", 1, i) for i, k in enumerate([[0xFF, 0xFE], [0x7F], [0x80], [0x61, 0], [0x61]])]
    df = spark.createDataFrame(rows, "key binary, value binary, ts long, seq long")
    assert [bytes(r.key) for r in lookup.scan(df, bytes([0x61]), bytes([0xFF])).collect()] == [b"a", b"a\0", b"\x7f", b"\x80"]


def test_stored_keys_reach_the_scan(spark, tmp_path):
    log(spark, [("a", "1", 1, 1)]).write.parquet(f"{tmp_path}/t")
    plan = lookup.scan(spark.read.parquet(f"{tmp_path}/t"), "a", "c")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,a)" in plan and "LessThan(key,c)" in plan


def test_first_source_wins_a_get_and_the_clock_a_scan(spark):
    memory, old = log(spark, [("a", "memory", 1, 9)]), log(spark, [("a", "run", 2, 3), ("b", "run", 2, 4)])
    sources = lookup.ranked([memory, old])
    assert pairs(lookup.tiered_get(sources, spark.createDataFrame([("a",), ("b",), ("c",)], "key string"))) == {"a": "memory", "b": "run"}
    assert pairs(lookup.tiered_scan(sources, "a", "z")) == {"a": "run", "b": "run"}
