"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import math
import shutil
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings every operator relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Older types of timestamps have no bounds that a scan could use.
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    shared_dir(spark)
    ship_package(spark)
    return spark


# Stored bytes for each partition that a shuffle starts with.
_PARTITION_BYTES = 4 << 20


def partition_by_size(spark: SparkSession, folder: str) -> int:
    """Let shuffles start with a partition for every 4 MB stored in the folder; adaptive execution merges small ones.

    With a fixed number, what one task sorts and aggregates would grow with the tables. The
    number is never lowered; it has no effect where merging of partitions is switched off.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    stored = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    present = [int(spark.conf.get(c, None) or 0) for c in (name, "spark.sql.shuffle.partitions")]
    wanted = max(*present, math.ceil(stored / _PARTITION_BYTES))
    spark.conf.set(name, str(wanted))
    return wanted


def release(spark: SparkSession, every: float = 10) -> None:
    """Have Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It notices them when the driver collects garbage, which may not happen while a job of several steps
    runs: the files of all its steps would add up. To be called where a step has stored its result; short
    steps, of less than ``every`` seconds since the last call that did it, wait for the next call.
    """
    sc, now = spark.sparkContext, time.monotonic()
    if now - getattr(sc, "_released", -math.inf) < every:
        return
    gc.collect(0)
    for pause in (0.3, 0):  # what the first round lets go of refers to what the second does
        spark._jvm.System.gc()
        time.sleep(pause)
    sc._released = time.monotonic()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parent
    if getattr(sc, f"_has_{package.name}", False):
        return
    target = Path(tempfile.mkdtemp(prefix="run-")) / package.name
    sc.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
    setattr(sc, f"_has_{package.name}", True)


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, used for checkpoints and staging.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a fresh folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current is None:
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return named or current


def staging_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
