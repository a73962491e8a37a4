"""Bloom filters sized for what they hold, as column expressions and tables of set bits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import digest


def bits(n: Column, p: float = 0.01) -> Column:
    return F.ceil(-n.cast("double") * math.log(p) / math.log(2.0) ** 2).cast("long")


def hashes(m: Column, n: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(m.cast("double") / n.cast("double") * math.log(2.0)).cast("long"))


def false_positive_rate(n: Column, m: Column, k: Column) -> Column:
    """(1 - e^(-k n / m))^k"""
    return F.pow(1 - F.exp(-k.cast("double") * n.cast("double") / m.cast("double")), k.cast("double"))


def parameters(counts: DataFrame, p: float = 0.01) -> DataFrame:
    """Adds m, k, bytes and the expected rate to rows with n, the number of keys."""
    out = counts.withColumn("m", bits(F.col("n"), p))
    out = out.withColumn("k", hashes(F.col("m"), F.col("n")))
    return out.withColumn("memory_bytes", F.ceil(F.col("m") / 8).cast("long") + 8).withColumn("fp_rate", false_positive_rate(F.col("n"), F.col("m"), F.col("k")))


def positions(key: Column, m: Column, k: Column, by_digest: bool = False) -> Column:
    """k bit positions by double hashing; both hashes are reduced before they are multiplied. ``by_digest`` takes hashes that other engines have too."""
    h1, h2 = (digest(key, 0), digest(key, 1)) if by_digest else (F.xxhash64(key), F.xxhash64(key, F.lit(1)))
    h1, h2 = F.pmod(h1, m), F.pmod(h2, m)
    return F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.pmod(h1 + i * h2, m))


#: Bits of one bitmap.
PART = 32_768


def _spread(keys: DataFrame, params: DataFrame, by_digest: bool) -> DataFrame:
    """(run_id, key, part, bit) of each distinct position of each key: which bitmap of the filter, and which bit of it."""
    at = F.array_distinct(positions(F.col("key"), F.col("m"), F.col("k"), by_digest))
    spread = keys.join(params.select("run_id", "m", "k"), "run_id").select("run_id", "key", F.explode(at).alias("pos"))
    return spread.select("run_id", "key", F.floor(F.col("pos") / PART).alias("part"), (F.col("pos") % PART).alias("bit"))


def build(keys: DataFrame, params: DataFrame, by_digest: bool = False) -> DataFrame:
    """Each run's filter as rows (run_id, part, bits), bitmaps of ``PART`` bits. Tasks set bits before the shuffle, which moves a bitmap per task and part."""
    return _spread(keys, params, by_digest).groupBy("run_id", "part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def might_contain(probes: DataFrame, params: DataFrame, filters: DataFrame, by_digest: bool = False) -> DataFrame:
    """Adds ``maybe`` to distinct probes (run_id, key): whether all their bits are set.

    A part's probes meet its bitmap; keys per part are few, as a filter grows with its run."""
    wanted = _spread(probes.select("run_id", "key").distinct(), params, by_digest)
    of_bit = F.conv(F.hex(F.substr(F.col("bits"), F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(of_bit, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    return wanted.join(filters, ["run_id", "part"], "left").groupBy("run_id", "key").agg(F.bool_and(is_set).alias("maybe"))


def stats(params: DataFrame, filters: DataFrame) -> DataFrame:
    """m, k, memory, set bits and fill ratio of each run's filter."""
    bits_set = filters.groupBy("run_id").agg(F.sum(F.bitmap_count("bits")).alias("set_bits"))
    out = params.join(bits_set, "run_id", "left").withColumn("set_bits", F.coalesce("set_bits", F.lit(0)))
    return out.withColumn("fill_ratio", F.col("set_bits") / F.col("m"))
