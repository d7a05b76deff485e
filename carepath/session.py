"""Session helpers: a tuned local session for tests/bench and the checkpoint folder rule.

On a cluster the session comes from the platform; only ``checkpoint_dir`` is consulted there, and it reads
``spark.checkpoint.dir`` from the session. A folder of our own is set only when that setting is absent
(local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "carepath") -> SparkSession:
    """A local session for tests and the bench: UI off, AQE on, UTC, Arrow on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CAREPATH_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(master: str) -> bool:
    """True where one JVM runs everything (``local``, ``local[8]``, ``local[*]``), not for ``local-cluster``."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the session. A local master may go without: it gets a private one.

    Any other master must name a folder that driver and executors share; a machine-local one would lose data."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect client: the server owns the folder (spark.checkpoint.dir)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="carepath-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shuffle_partitions(spark: SparkSession, default: int = 200) -> int:
    """The session's shuffle partition count (platforms may set a non-numeric value such as 'auto')."""
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except (TypeError, ValueError):
        return default


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (lineage cut, survives executor loss) into the session's checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs send Arrow batches of ``rows`` rows at most to Python, or the session's own limit if lower."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(name, "10000"))
    spark.conf.set(name, rows if own <= 0 else min(own, rows))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def counting_session(spark: SparkSession) -> SparkSession:
    """A session of the same application, with the same settings, for jobs whose counters are read (``observe``). Spark
    4.1 keeps the reader of an ``Observation`` in the session that ran it, and closures that capture that session (those
    of some ML transformers) can no longer be sent to tasks; the caller's own session stays clear of it."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of a file system that Spark reaches (the driver may not)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
