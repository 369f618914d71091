"""Intermediate tables in the folder that the driver and the executors share.

A written table cuts the lineage and survives lost executors, which cached blocks and shuffle files do not.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Deletes a plan's shuffle files when it ends, not when the driver's heap is collected. Only for plans that write a table, as they run once.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where that is unset (tests on one machine) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="sheaf-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds the Arrow batches of the session by bytes, as texts can be long: a batch is held by Spark and by Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def save(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as a Parquet table of its own and returns the table as read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sheaf-{name}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._sheaf_path = path
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver's heap is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Deletes saved tables that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df._sheaf_path)
        _left[:] = [x for x in _left if x[1] != df._sheaf_path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for spark, path in _left:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
