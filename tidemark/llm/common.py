"""What the training-data operators share: whole-table reads, stored intermediate tables, hash splits."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset and the master is local (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has ended, not when the driver happens to collect its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def removed(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete stored tables, or folders of them, that nothing reads any more."""
    for t in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._stored_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(key: str | Column, m: int) -> Column:
    """crc32(key as text) mod m; null for a null key."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(col.cast("string")) % F.lit(m)


def held_out(key: str, m: int, r: int = 2) -> Column:
    """True where the remainder is r; false for a null key."""
    return F.coalesce(crc_mod(key, m) == F.lit(r), F.lit(False))


def values(column: pa.Array) -> Iterator:
    """A column's values one at a time, so that a batch of long texts is not copied whole."""
    return (x.as_py() for x in column)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts without copies, so that what is made from them stays small."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)
