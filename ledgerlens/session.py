"""Spark session defaults shared by tests, bench and the driver entry."""
from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (the data is timestamp_ntz),
# AQE for runtime re-planning (coalescing, skew-join splitting, broadcast
# conversion from *measured* sizes), and no UI server.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    # checkpoint files go once nothing refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                app: str = "ledgerlens") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEM", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3) folder and
    is honoured as is. Only when nothing is configured (local tests) do we
    create a scratch folder of our own; on a cluster that is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}


_SCRATCH: set[str] = set()


def scratch_path(spark: SparkSession, kind: str, name: str) -> str:
    """A new path ``<kind>/<name>-<random>`` in the shared folder, for a table
    that this application alone uses; removed when the driver ends."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}"
    if base not in _SCRATCH:
        _SCRATCH.add(base)
        atexit.register(_remove_scratch, spark, base)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def _remove_scratch(spark: SparkSession, base: str) -> None:
    from .sources import fs
    if spark.sparkContext._jsc is not None:
        fs.delete(spark, base)


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings the operators' semantics rely on (the data is
    wall-clock ``timestamp_ntz``; every conversion is defined in UTC), applied
    to a session created elsewhere."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def cut_lineage(df):
    """Reliable checkpoint into ``spark.checkpoint.dir`` without computing
    the input twice: RDD checkpointing re-runs the lineage to write the files
    unless the data is persisted, so persist, checkpoint, then release."""
    from pyspark import StorageLevel
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        out = df.checkpoint(eager=True)
    finally:
        df.unpersist()
    return out


# while a table is stored: its shuffle files go at the end, and it keeps a file
# per shuffle partition (merged, it would have one per core)
_STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def stored(df, name: str):
    """``cut_lineage`` for wide tables that are read many times: a Parquet
    table in the shared folder, read back. There is no persisted copy beside
    it, its columns are packed and read one by one, and the shuffle files of
    its job go once it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, "tables", name)
    with _set(spark, _STORING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _set(spark: SparkSession, conf: dict):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def file_by_file(spark: SparkSession):
    """Inside, a scan of a ``stored`` table has a task per file, not one per
    core: training holds the rows of a task."""
    return _set(spark, {"spark.sql.files.minPartitionNum": spark.conf.get("spark.sql.shuffle.partitions")})
