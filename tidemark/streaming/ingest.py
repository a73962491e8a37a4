"""Streams of operations: latest values as they arrive, keyed state, and runs written per micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import latest, latest_value
from ..session import ship

LOG = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of operations (seq, key, value, ts)."""
    e = spark.readStream.schema(LOG).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 64).parquet(sf_dir)
    return e.select(F.col("event_id").alias("seq"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))


def _finished(out: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str) -> None:
    query = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def latest_of_stream(stream: DataFrame, folder: str) -> DataFrame:
    """The latest value of each key once the stream's input is read: a stateful aggregation in update mode.

    A batch writes the keys that it changed, and a batch that is tried again overwrites its own part; the newest of a key's entries is the answer."""
    at, newest = f"{folder}/latest-{uuid.uuid4().hex}", latest_value(stream)
    _finished(newest, f"{at}/state", lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), "update")
    return latest(stream.sparkSession.read.schema(newest.schema).parquet(f"{at}/out").select(newest.columns))


def _keep_newest(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Keyed state: the newest version so far; a row is returned whenever it changes."""
    best = state.get if state.exists else None
    before = best
    for pdf in batches:
        top = pdf.sort_values(["ts", "seq"]).iloc[-1]
        row = (int(top.ts), int(top.seq), float(top.value))
        best = row if best is None or row[:2] > best[:2] else best
    if best is not None and best != before:
        state.update(best)
        yield pd.DataFrame({"key": [key[0]], "value": [best[2]], "ts": [best[0]], "seq": [best[1]]})


def latest_by_state(stream: DataFrame, folder: str) -> DataFrame:
    """The same with explicit state per key; updates are appended to a changelog, whose last entries are the answer."""
    ship(stream.sparkSession)
    at = f"{folder}/state-{uuid.uuid4().hex}"
    out = stream.groupBy("key").applyInPandasWithState(_keep_newest, "key string, value double, ts long, seq long", "ts long, seq long, value double", "update", "NoTimeout")
    _finished(out, f"{at}/state", lambda df, n: df.write.mode("append").parquet(f"{at}/out"), "update")
    return latest(stream.sparkSession.read.parquet(f"{at}/out"))


def flush_stream(stream: DataFrame, folder: str) -> DataFrame:
    """Each micro-batch, resolved and sorted by key, becomes a run named by its number; returns all runs' rows."""
    at = f"{folder}/runs-{uuid.uuid4().hex}"

    def write(df: DataFrame, n: int) -> None:
        # a batch that is tried again overwrites its own run
        latest(df).sortWithinPartitions("key").write.mode("overwrite").parquet(f"{at}/out/run_id={n}")

    _finished(stream, f"{at}/state", write, "append")
    return stream.sparkSession.read.parquet(f"{at}/out")


def windowed_counts(stream: DataFrame, late: str, size: str, folder: str) -> DataFrame:
    """Counts and sums per time window (an extension); a window is given out once the watermark has passed its end."""
    at = f"{folder}/windows-{uuid.uuid4().hex}"
    timed = stream.withColumn("at", F.timestamp_seconds("ts"))
    out = timed.withWatermark("at", late).groupBy(F.window("at", size)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = out.select(F.unix_seconds("window.start").alias("window_start"), "n", "total")
    # a batch that is tried again overwrites its own part
    _finished(out, f"{at}/state", lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), "append")
    return stream.sparkSession.read.schema("window_start long, n long, total double").parquet(f"{at}/out").select("window_start", "n", "total")
