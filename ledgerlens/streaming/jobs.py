"""Structured Streaming operators (S1–S6) and the feature writes of a stream.

Sources are file streams over a table's own path (a file or a folder of part
files); every job runs with ``trigger(availableNow)`` under a folder ``root``
with its checkpoint and its output, so a job started again on the same folder
goes on where it stopped. Output is idempotent: each micro-batch overwrites
its own ``batch=<id>`` folder, so a retried batch replaces what it wrote.
Keyed results are emitted in update mode and read back as the latest row per
key.

Jobs that keep state by time (S1, S2, S4) read a stream that ``route`` has put
in order: a row that comes more than ``LATENESS`` behind the newest row of
earlier micro-batches goes to a side table of late rows; the others of a
micro-batch are written slice by slice, oldest first. A file stream reads the
oldest files first, so the stateful job sees time move on and drops its state
behind the watermark, however long the backlog and in whatever order its files
come, and no row is ever too late for it. The late rows are merged by a batch
step. What comes late after all (``Run.dropped``) is an error (``whole``).
"""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time as T
from ..operators import featurestore as FS
from ..operators import tagging as TG
from ..session import scratch_path
from ..sources import fs
from ..sources.adapters import txn_from_events

LATENESS = "10 days"  # watermark delay of the jobs that keep state by time, and width of a slice


@dataclass
class Run:
    """A finished run: the job's folder, its output, and how many rows came
    too late for the watermark in this run."""
    root: str
    path: str
    dropped: int = 0


def whole(run: Run) -> Run:
    """The run, if no row came too late for its watermark."""
    if run.dropped:
        raise RuntimeError(f"{run.dropped} rows came too late for the watermark: {run.root}")
    return run


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, "streams", name)


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    base = sf_dir.rstrip("/")
    # a glob that matches this one path: a plain path must be a folder
    return (spark.readStream.schema(spark.read.parquet(f"{base}/{name}.parquet").schema)
                 .option("maxFilesPerTrigger", files_per_batch).parquet(f"{base}/[{name[0]}]{name[1:]}.parquet"))


def stream_txn(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000) -> DataFrame:
    return txn_from_events(stream_table(spark, sf_dir, "events", files_per_batch))


def _finish(query, root: str) -> Run:
    query.awaitTermination()
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
    return Run(root, root + "/data", late)


def run_batches(df: DataFrame, name: str, mode: str = "append", fn=None, root: str | None = None) -> Run:
    """Run a stream to the end of its input; micro-batch ``id`` (through
    ``fn(batch, id, path)`` if given) is written to ``batch=id``."""
    root = root or _scratch(df.sparkSession, name)

    def sink(batch: DataFrame, epoch: int):
        out = fn(batch, epoch, root + "/data") if fn else batch
        out.write.mode("overwrite").parquet(f"{root}/data/batch={epoch}")

    return _finish(df.writeStream.outputMode(mode).option("checkpointLocation", root + "/_checkpoint")
                   .foreachBatch(sink).trigger(availableNow=True).start(), root)


def read_sink(spark: SparkSession, run: Run, keys: list[str] | None = None) -> DataFrame:
    """The output of a run; with ``keys`` the row of the latest batch per key."""
    rows = spark.read.parquet(run.path)
    if not keys:
        return rows.drop("batch", "place")
    cols = [c for c in rows.columns if c != "batch"]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("_row"))
    return latest.select("_row.*")


# --- time order ----------------------------------------------------------------
def _width(lateness: str) -> dt.timedelta:
    n, unit = lateness.split()
    return dt.timedelta(**{unit if unit.endswith("s") else unit + "s": int(n)})


def route(t: DataFrame, root: str | None = None, lateness: str = LATENESS) -> str:
    """Read the stream to its end into ``root/ontime`` (time slices, oldest
    written first) and ``root/late``; ``root/seen`` holds the newest time of
    each micro-batch. A retried micro-batch overwrites its own folders. Rows
    without a time count as the oldest slice of their micro-batch."""
    spark, root = t.sparkSession, root or _scratch(t.sparkSession, "routed")
    width, at = _width(lateness), F.col("timestamp")
    seen = "newest timestamp_ntz"
    if not fs.names(spark, f"{root}/seen"):
        spark.createDataFrame([], seen).write.parquet(f"{root}/seen/epoch=-1")
        t.sparkSession.createDataFrame([], t.schema).write.parquet(f"{root}/late/epoch=-1")

    def sink(batch: DataFrame, epoch: int):
        s = batch.sparkSession
        before = s.read.schema(f"{seen}, epoch int").parquet(f"{root}/seen").where(F.col("epoch") < epoch).agg(F.max("newest")).first()[0]
        is_late = at < T.ntz_literal((before - width).isoformat()) if before is not None else F.lit(False)
        is_late = F.coalesce(is_late, F.lit(False))
        number = F.floor(T.epoch_seconds("timestamp") / width.total_seconds()).cast("bigint")
        batch = batch.withColumn("_slice", number).persist()
        try:
            newest = batch.agg(F.max("timestamp").alias("newest"))
            batch.where(is_late).drop("_slice").write.mode("overwrite").parquet(f"{root}/late/epoch={epoch}")
            on_time = batch.where(~is_late)
            # one number per slice of time, not per row
            found = [r[0] for r in on_time.select("_slice").distinct().orderBy("_slice").collect()]
            slices = [x for x in found if x is not None] or found
            for i, x in enumerate(slices):
                mine = F.col("_slice") == x if x is not None else F.lit(True)
                mine = mine | F.col("_slice").isNull() if i == 0 else mine
                on_time.where(mine).drop("_slice").write.mode("overwrite").parquet(f"{root}/ontime/{epoch:09d}-{i:06d}")
            newest.write.mode("overwrite").parquet(f"{root}/seen/epoch={epoch}")
        finally:
            batch.unpersist()

    t.writeStream.option("checkpointLocation", root + "/_route").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    return root


def on_time(spark: SparkSession, root: str, schema) -> DataFrame:
    """The routed rows as a stream in time order, about a slice a micro-batch."""
    folders = [f"{root}/ontime/{x}" for x in fs.names(spark, f"{root}/ontime")]
    if not folders:
        spark.createDataFrame([], schema).write.parquet(f"{root}/ontime/none")
    most = max([sum(f.endswith(".parquet") for f in fs.names(spark, x)) for x in folders], default=1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(most, 1)).parquet(f"{root}/ontime/*")


def late(spark: SparkSession, root: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{root}/late/{x}" for x in fs.names(spark, f"{root}/late")])


# --- S1 ----------------------------------------------------------------------
def _sample_id():
    return F.concat_ws("_", F.col("user_id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def training_samples(t: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Confirmed labels -> de-duplicated samples keyed ``user_timestamp``;
    state is bounded by ``lateness``, and later rows are counted as dropped."""
    # watermarks need TIMESTAMP (LTZ); the session zone is UTC, so the wall clock is unchanged
    return (t.withColumn("sample_id", _sample_id()).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
             .withWatermark("timestamp", lateness)
             .dropDuplicatesWithinWatermark(["sample_id"])
             .select("sample_id", "user_id", "merchant_name", "amount", "timestamp",
                     F.col("category").alias("label")))


def with_late_samples(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The samples of a run and those of the late rows that it does not have;
    of late rows with one sample id the first by transaction id counts."""
    cols = ["user_id", "merchant_name", "amount", F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("category").alias("label")]
    first = rows.groupBy(_sample_id().alias("sample_id")).agg(F.min_by(F.struct(*cols), "transaction_id").alias("_s"))
    fresh = first.join(found.select("sample_id"), "sample_id", "left_anti")
    return found.unionByName(fresh.select("sample_id", "_s.*"))


# --- S2 ----------------------------------------------------------------------
TRIGGER = "trigger_no bigint, threshold bigint, samples bigint, place double"


def _crossed(s: SparkSession, path: str, n: int, place: float, every: int) -> DataFrame:
    """Trigger rows of ``n`` samples that stand at ``place`` in the order of
    batches, and a row with their number."""
    before = s.read.parquet(path).where(F.col("place") < place).agg(F.sum("samples")).first()[0] or 0
    crossed = s.range(before // every + 1, (before + n) // every + 1).select(
        F.col("id").alias("trigger_no"), (F.col("id") * every).alias("threshold"), F.lit(None).cast("bigint").alias("samples"),
        F.lit(place).alias("place"))
    return crossed.unionByName(s.createDataFrame([(None, None, n, place)], TRIGGER))


def retrain_triggers(samples: DataFrame, every: int = 100, root: str | None = None) -> Run:
    """One trigger row per multiple of ``every`` that the number of samples
    crosses. Each batch stores its own sample count (a row without trigger),
    so the total before a batch is the sum of the earlier batches' counts and
    a retried batch comes to the same triggers. ``root/ids`` keeps the sample
    ids for the late rows' merge."""
    spark = samples.sparkSession
    root = root or _scratch(spark, "retrain")
    spark.createDataFrame([(None, None, 0, -1.0)], TRIGGER).write.mode("overwrite").parquet(f"{root}/data/batch=-1")

    def fn(batch: DataFrame, epoch: int, path: str) -> DataFrame:
        s, ids = batch.sparkSession, f"{root}/ids/batch={epoch}"
        batch.select("sample_id").write.mode("overwrite").parquet(ids)
        return _crossed(s, path, s.read.parquet(ids).count(), float(epoch), every)

    return run_batches(samples, "retrain", "append", fn, root)


def late_triggers(run: Run, rows: DataFrame, every: int = 100) -> Run:
    """Count the samples of the late ``rows`` that no batch has yet, after the
    last batch so far; a repeated call replaces its own rows."""
    s = rows.sparkSession
    batches = [int(n.removeprefix("batch=")) for n in fs.names(s, run.path) if n.startswith("batch=")]
    last = max(batches)
    mine, known = f"after={last}", f"{run.root}/ids"
    counted = [f"{known}/{x}" for x in fs.names(s, known) if x != mine]
    fresh = rows.select(_sample_id().alias("sample_id")).distinct()
    if counted:
        fresh = fresh.join(s.read.schema("sample_id string").parquet(*counted), "sample_id", "left_anti")
    fresh.write.mode("overwrite").parquet(f"{known}/{mine}")
    n = s.read.schema("sample_id string").parquet(f"{known}/{mine}").count()
    # negative ids: batches of the stream are counted from 0, -1 is the start
    _crossed(s, run.path, n, last + 0.5, every).write.mode("overwrite").parquet(f"{run.path}/batch={-3 - last}")
    return run


# --- S3 ----------------------------------------------------------------------
def last_txn_features(t: DataFrame) -> DataFrame:
    return t.groupBy("user_id").agg(
        F.max_by(F.struct("amount", F.hour("timestamp").alias("hour"), "merchant_name", "timestamp"),
                 F.struct("timestamp", "transaction_id")).alias("_l"),
        F.count(F.lit(1)).alias("n_seen"))


# --- S4 ----------------------------------------------------------------------
def velocity(t: DataFrame, length: str = "1 day", slide: str = "6 hours", lateness: str = LATENESS) -> DataFrame:
    """Update mode emits the windows that changed; closed ones leave the state."""
    return _per_window(t.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", lateness), length, slide)


def _per_window(t: DataFrame, length: str, slide: str) -> DataFrame:
    return t.groupBy("user_id", F.window("timestamp", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("transactions"))


def with_late_counts(counts: DataFrame, rows: DataFrame, length: str = "1 day", slide: str = "6 hours") -> DataFrame:
    """The windows of a run plus what the late rows add to them."""
    more = _per_window(rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")), length, slide)
    return (counts.select("user_id", "w", "transactions").unionByName(more)
            .groupBy("user_id", "w").agg(F.sum("transactions").alias("transactions")))


# --- A7 / S3: feature writes ---------------------------------------------------
def stream_features(t: DataFrame, path: str, root: str | None = None) -> Run:
    """Every micro-batch adds its rows' features to the stored table at
    ``path`` under its own epoch; a repeated one replaces what it wrote."""
    root = root or _scratch(t.sparkSession, "features")

    def sink(batch: DataFrame, epoch: int):
        FS.store(FS.feature_log(batch), path, epoch)

    t.writeStream.option("checkpointLocation", root + "/_checkpoint").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    return Run(root, path)


# --- S5 ----------------------------------------------------------------------
def match_dimension(names: DataFrame, catalog: DataFrame, path: str | None = None) -> DataFrame:
    """The fuzzy matches of the known merchant names (column ``m``) that the
    catalog lacks, stored for the stream's join. A name that appears later is
    tagged by the rules until the dimension is built anew."""
    cat = TG.tagger_catalog(catalog)
    path = path or _scratch(names.sparkSession, "matches")
    TG.fuzzy_match(names.join(cat.select(F.col("c").alias("m")), "m", "left_anti"), cat).write.mode("overwrite").parquet(path)
    return names.sparkSession.read.parquet(path)


def tag_stream(t: DataFrame, catalog: DataFrame, matches: DataFrame, root: str | None = None) -> Run:
    """Online tagging as one stateless plan: stream-static joins with the
    catalog and its match dimension, appended to a file sink."""
    root = root or _scratch(t.sparkSession, "tagging")
    tagged = TG.tag_with(t, TG.tagger_catalog(catalog), matches)
    return _finish(tagged.writeStream.outputMode("append").format("parquet").option("path", root + "/data")
                   .option("checkpointLocation", root + "/_checkpoint").trigger(availableNow=True).start(), root)


# --- S6 ----------------------------------------------------------------------
def label_votes(votes: DataFrame) -> DataFrame:
    from ..functions import text as X
    v = votes.withColumn("signature", X.label_signature("merchant_name", "vpa_handle", "geohash5"))
    return v.groupBy("signature").agg(
        F.count(F.lit(1)).alias("votes"),
        F.max_by(F.struct("category_name", "confidence"), F.struct("ts", "transaction_id")).alias("_last"))
