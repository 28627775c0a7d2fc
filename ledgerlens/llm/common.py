"""Helpers shared by the operators: table reads, intermediate tables in the
shared folder, stable row ids, and Arrow batch plumbing."""
from __future__ import annotations

import atexit
import ctypes
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir

_CLEANED: set[str] = set()
_SHIPPED: set[str] = set()
ARROW_BYTES = 8 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may have neither the
    driver's working folder nor its module path; once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    # texts vary a thousandfold in length: bound Arrow batches by bytes
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-code-"), "ledgerlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "ledgerlens")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """This application's folder under the shared checkpoint folder; removed
    when the driver's Python ends."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-work"
    if base not in _CLEANED:
        _CLEANED.add(base)
        atexit.register(_remove_at_exit, spark, base)
    return base


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, path)


class Stage:
    """A DataFrame written as Parquet to the shared folder and read back: its
    lineage is cut and lost executors cost nothing. ``drop()`` removes the
    files once no later job reads them."""

    def __init__(self, spark: SparkSession, df: DataFrame, tag: str):
        self.spark, self.path = spark, f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        # shuffle files of the job are not needed once its table is written
        conf, old = spark.conf, spark.conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(self.path)
        finally:
            conf.set(_CLEANUP, old)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def staged(df: DataFrame, tag: str) -> DataFrame:
    return Stage(df.sparkSession, df, tag).df


def row_ids(df: DataFrame, id_col: str, payload: list[str]) -> DataFrame:
    """``rid`` (bigint, unique, ordered as ``id_col`` with nulls first) beside
    ``id_col`` and ``payload``. Unique non-null ids are used as they are. If
    ids repeat or are null, the rows are sorted by (id, payload) and numbered
    by range partition, so every row stays its own row; equal rows are
    interchangeable."""
    cols = df.select(id_col, *payload)
    clash = (cols.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
             .filter((F.col("n") > 1) | F.col(id_col).isNull()).limit(1).count())
    if not clash:
        return cols.withColumn("rid", F.col(id_col).cast("bigint"))
    order = [F.col(c).asc_nulls_first() for c in [id_col, *payload]]
    return staged(cols.orderBy(*order).withColumn("rid", F.monotonically_increasing_id()), "rows")


def local_file(spark: SparkSession, path: str) -> str:
    """A data file named by ``path`` on every machine (a parameter file such
    as a tokenizer vocabulary); fails early on the driver when absent."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def with_ids(found: DataFrame, id_col: str, names: dict[str, str]) -> DataFrame:
    """Columns that hold row ids, as the ids of those rows. Where row ids are
    the ids themselves (the usual case) nothing is joined."""
    plain = not found.filter(~F.col(id_col).eqNullSafe(F.col("rid"))).limit(1).count()
    if plain:
        return found.withColumnsRenamed(names)
    ids = staged(found.select(F.col("rid").alias("_rid"), F.col(id_col).alias("_id")), "ids")
    for rid, name in names.items():
        found = found.join(ids, found[rid] == ids["_rid"]).drop("_rid", rid).withColumnRenamed("_id", name)
    return found


def drop_or_keep(df: DataFrame, ids: DataFrame, key: str, how: str, bound: int = 500_000) -> DataFrame:
    """Join ``df`` with the written table ``ids`` on ``key`` (inner, left_semi
    or left_anti). While ``ids`` has at most ``bound`` rows it is broadcast
    and ``df`` stays where it is; beyond, both are shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= bound else ids, key, how)


# -- Arrow batches ------------------------------------------------------------

def strings(column: pa.Array) -> list[str]:
    """Python strings of a column, null as the empty string."""
    return ["" if x is None else x for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array and the offsets of the texts
    (n + 1); null counts as empty. No copy is made."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(off):
        off = np.zeros(1, np.int64)
    return raw[off[0]: off[-1]], off - off[0]


def small_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of ``text`` or
    one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(off, off[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    release_memory()


def release_memory() -> None:
    """Give freed memory back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def by_group(batches: Iterator[pa.RecordBatch], key: str, limit: int, text: str | None = None,
             byte_limit: int = 0) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``: groups gather
    until ``limit`` rows (or ``byte_limit`` bytes of ``text``) are there; a
    group is never cut."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += int(np.diff(utf8(batch.column(text))[1][[0, -1]])[0]) if text else 0
        if rows < limit and (not text or size < byte_limit):
            continue
        keys = np.concatenate([b.column(key).to_numpy() for b in held])
        same = np.flatnonzero(keys != keys[-1])
        if not len(same):
            continue
        cut = int(same[-1]) + 1
        table = pa.Table.from_batches(held)
        yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows, size = len(keys) - cut, 0
    if held:
        yield pa.Table.from_batches(held)
