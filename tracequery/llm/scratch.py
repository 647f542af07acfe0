"""Written tables that cut lineage, in the folder all executors share.

The folder is ``spark.checkpoint.dir``.  Only where that setting is absent and
the session runs in one local process is a temporary folder used.

A result that reads such tables needs them until it is stored, so the operators
and queries don't delete them: whoever stores results calls ``clear`` then.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: list[str] = []


def folder(spark: SparkSession) -> str:
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tracequery-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


def _collect_in_jvm(spark: SparkSession) -> None:
    """Where the driver's JVM can be reached; a session by Spark Connect has none."""
    jvm = getattr(getattr(spark, "_sc", None), "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def cut(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Writes a frame to the shared folder once and returns the written table; ``by``: columns with a folder for each value."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").partitionBy(*by or []).parquet(path)
    # Spark removes the shuffle files of finished jobs once the driver's JVM has collected their plans.
    gc.collect()
    _collect_in_jvm(spark)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, total_bytes: int, each: int) -> int:
    """How many partitions keep each within ``each`` bytes, the session's shuffle partitions at least."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, -(-int(total_bytes) // each), 1)


def clear(spark: SparkSession) -> None:
    """Deletes the tables written so far; call it once the results that read them are stored."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
