"""The tables of the engine and how the driver's tables stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One row per operation; seq orders versions that share a second.
OPLOG = "seq long, segment long, op string, key string, value string, ts long"
MANIFEST = "run_id long, path string, bytes long, entries long, min_key string, max_key string, min_ts long, max_ts long, max_seq long"

#: Limits of one record.
MAX_KEY, MAX_RECORD = 65_535, 65_535
RECORD_OVERHEAD = 8 + 2 + 4  # time, key length, value length
RECORD_HEADER = 4 + 2 + 1  # checksum, length, op


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an operation log: one key per user and event type, the event id as sequence number."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"),
        "value",
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
        F.octet_length("props").cast("long").alias("vlen"),
    )
