"""Versioned feature store as tables.

``feature_values(feature_set, version, entity_id, features map<string,double>,
stored_at timestamp_ntz, ttl_seconds int)`` is a log; a key's current value is
its newest row, live while ``stored_at + ttl > as_of``. Latest-by-key is a
``max_by`` aggregate (partial aggregation: a hot entity never lands whole on
one task).

The stored table has a folder per (feature_set, version, bucket, epoch). The
bucket is a hash of the entity, so a point lookup and a compaction touch the
folders of its bucket alone; the epoch names the micro-batch that wrote the
rows, so a repeated micro-batch replaces exactly what it wrote before.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as T
from ..session import cut_lineage
from ..sources import fs

KEY = ["feature_set", "version", "entity_id"]
# fixed values: default TTL and the feature registry of the sets we write
DEFAULT_TTL = 3600
FOLDERS = ["feature_set", "version", "bucket", "epoch"]
BUCKETS = 8
BATCH_EPOCH = -1  # writes that no stream made
REGISTRY = {
    "user_txn": ["amount", "hour", "rating", "weekday"],
    "merchant_txn": ["amount", "hour", "weekday"],
}


def asof_lit(as_of: str) -> Column:
    return T.ntz_literal(as_of)


def feature_log(t: DataFrame, ttl_user: int = 86400, ttl_merchant: int = DEFAULT_TTL) -> DataFrame:
    """The writes a scoring job makes: per transaction, the user's and the
    merchant's last-transaction features (S3's batch form)."""
    feats = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("amount").alias("k"), F.col("amount").alias("v")),
        F.struct(F.lit("hour").alias("k"), F.hour("timestamp").cast("double").alias("v")),
        F.struct(F.lit("rating").alias("k"), F.col("rating").alias("v")),
        F.struct(F.lit("weekday").alias("k"), F.weekday("timestamp").cast("double").alias("v"))),
        lambda e: e["v"].isNotNull()))
    user = t.select(F.lit("user_txn").alias("feature_set"), F.lit("v1").alias("version"),
                    F.col("user_id").alias("entity_id"), feats.alias("features"),
                    F.col("timestamp").alias("stored_at"), F.lit(ttl_user).alias("ttl_seconds"), "transaction_id")
    merch = t.select(F.lit("merchant_txn").alias("feature_set"), F.lit("v1").alias("version"),
                     F.col("merchant_name").alias("entity_id"),
                     F.map_filter(feats, lambda k, v: k != "rating").alias("features"),
                     F.col("timestamp").alias("stored_at"), F.lit(ttl_merchant).alias("ttl_seconds"), "transaction_id")
    return user.unionByName(merch)


def _bucket(entity: Column) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(BUCKETS)).cast("int")


def store(log: DataFrame, path: str, epoch: int | None = None) -> str:
    """Add feature writes to the stored table. Without ``epoch`` they are
    appended; with it they replace the writes of the same epoch, so a repeated
    micro-batch changes nothing."""
    rows = log.withColumn("bucket", _bucket(F.col("entity_id"))).withColumn("epoch", F.lit(BATCH_EPOCH if epoch is None else epoch))
    if epoch is None:
        rows.write.mode("append").partitionBy(*FOLDERS).parquet(path)
    else:
        _replace(rows, path)
    return path


def _replace(rows: DataFrame, path: str) -> None:
    """Overwrite the folders that ``rows`` has rows for, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(path)


def stored(spark, path: str, feature_set: str | None = None, version: str | None = None, entity_id: str | None = None) -> DataFrame:
    """The stored table, or one set / version / entity of it (its folders
    alone are read)."""
    d = spark.read.parquet(path)
    for col, value in (("feature_set", feature_set), ("version", version), ("entity_id", entity_id)):
        if value is not None:
            d = d.where(F.col(col) == value)
    if entity_id is not None:
        d = d.where(F.col("bucket") == _bucket(F.lit(entity_id)))
    return d.drop("bucket", "epoch")


def compact(spark, path: str, tombstones: DataFrame | None = None, as_of: str | None = None,
            history: bool = True) -> list[tuple]:
    """Delete from the stored table the keys in ``tombstones`` and, with
    ``as_of``, those expired by then; without ``history`` also every write
    that a newer one of its key replaced. Only folders that hold such rows are
    read again and rewritten; folders left without rows are removed. Returns
    the (set, version, bucket, epoch) of the folders touched.

    A folder is replaced as a whole, and compacting twice gives what once
    gives, so a run that was lost half-way is simply started again."""
    d = spark.read.parquet(path)
    newest = d.groupBy(*KEY, "bucket").agg(F.max(F.struct("stored_at", "transaction_id", "ttl_seconds")).alias("_l"))
    newest = newest.select(*KEY, "bucket", "_l.*")
    gone = newest.where(expires_at() <= asof_lit(as_of)) if as_of is not None else newest.limit(0)
    gone = gone.select(*KEY, "bucket")
    if tombstones is not None:
        dead = tombstones.select(*KEY).distinct().withColumn("bucket", _bucket(F.col("entity_id")))
        gone = gone.unionByName(dead).distinct()
    gone = cut_lineage(gone)
    doomed = d.join(gone, [*KEY, "bucket"], "left_semi")
    last = newest.select(*KEY, F.col("stored_at").alias("_at"), F.col("transaction_id").alias("_id"))
    old = (F.col("stored_at") != F.col("_at")) | ~F.col("transaction_id").eqNullSafe(F.col("_id"))
    if not history:
        doomed = doomed.select(*FOLDERS).unionByName(d.join(last, KEY).where(old).select(*FOLDERS))
    # one row per folder that changes: no more than the table has folders
    touched = sorted(tuple(r) for r in doomed.select(*FOLDERS).distinct().collect())
    if not touched:
        return []
    inside = F.lit(False)
    for name in sorted({(s, v, b) for s, v, b, _ in touched}):
        epochs = [e for *k, e in touched if tuple(k) == name]
        inside = inside | ((F.col("feature_set") == name[0]) & (F.col("version") == name[1]) & (F.col("bucket") == name[2])
                           & F.col("epoch").isin(epochs))
    kept = d.where(inside).join(gone, [*KEY, "bucket"], "left_anti")
    if not history:
        kept = kept.join(last, KEY).where(~old).drop("_at", "_id")
    kept = cut_lineage(kept)  # read in full before a folder is replaced
    left = {tuple(r) for r in kept.select(*FOLDERS).distinct().collect()}
    if left:
        _replace(kept, path)
    for folder in touched:
        if folder not in left:
            fs.delete(spark, "/".join([path, *[f"{c}={v}" for c, v in zip(FOLDERS, folder)]]))
    return touched


def get(spark, path: str, feature_set: str, version: str, entity_id: str, as_of: str) -> DataFrame:
    """the live features of one entity (no row if there are none)."""
    return live(latest(stored(spark, path, feature_set, version, entity_id)), as_of)


def access_counts(accesses: DataFrame) -> DataFrame:
    """Counters per set from the access log (feature_set, kind, hit):
    stores, gets, batch gets, invalidations, and the hit rate of the single
    gets (null when there are none)."""
    def n(kind, hit=None):
        c = F.col("kind") == kind
        return F.count_if(c if hit is None else c & F.col("hit"))
    return accesses.groupBy("feature_set").agg(
        n("store").alias("stores"), n("get").alias("gets"), n("batch_get").alias("batch_gets"), n("invalidate").alias("invalidations"),
        F.when(n("get") > 0, n("get", True) / n("get")).alias("hit_rate"))


def latest(log: DataFrame) -> DataFrame:
    """Newest write per key (ties broken by transaction_id)."""
    g = log.groupBy(*KEY).agg(F.max_by(F.struct("features", "stored_at", "ttl_seconds"),
                                        F.struct("stored_at", "transaction_id")).alias("_l"))
    return g.select(*KEY, "_l.features", "_l.stored_at", "_l.ttl_seconds")


def expires_at(stored_at="stored_at", ttl="ttl_seconds") -> Column:
    return F.col(stored_at) + F.make_interval(secs=F.col(ttl).cast("decimal(18,6)"))


def live(lat: DataFrame, as_of: str) -> DataFrame:
    return lat.where(expires_at() > asof_lit(as_of))


def freshness(lat: DataFrame, as_of: str) -> DataFrame:
    a = asof_lit(as_of)
    age = (T.epoch_micros(a) - T.epoch_micros("stored_at")) / F.lit(1e6)
    return lat.select(*KEY, T.ts_text("stored_at").alias("stored_at"), age.alias("age_seconds"),
                      (F.col("ttl_seconds") - age).alias("remaining_ttl"),
                      T.ts_text(expires_at()).alias("expires_at"),
                      (expires_at() > a).cast("int").alias("is_fresh"))


def batch_get(lat: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    """requested (feature_set, version, entity_id) that are live;
    missing keys are omitted (semi join)."""
    return live(lat, as_of).join(requests, KEY, "left_semi")


def missing_features(lat: DataFrame, registry: dict | None = None) -> DataFrame:
    reg = registry or REGISTRY
    spark = lat.sparkSession
    r = spark.createDataFrame([(k, v) for k, v in reg.items()], "feature_set STRING, expected ARRAY<STRING>")
    # registry rows are a fixed handful (proven tiny): broadcast
    d = lat.join(F.broadcast(r), "feature_set", "left")
    miss = F.array_sort(F.array_except(F.coalesce("expected", F.array().cast("array<string>")), F.map_keys("features")))
    return d.select(*KEY, F.array_join(miss, ",").alias("missing_features"), F.size(miss).cast("long").alias("n_missing"))


def asof_join(probes: DataFrame, log: DataFrame, probe_key: str, feature_set: str, version: str = "v1",
              bucket_seconds: int = 86400) -> DataFrame:
    """for each probe row (key, ``timestamp``) the newest write of the
    key strictly before it, kept only if not expired at the probe time.

    Exact and skew-safe: union probes and writes, split by (key, time
    bucket); inside a bucket ``last(ignorenulls)`` finds the write, the newest
    write of earlier buckets comes from a per-(key, bucket) summary."""
    w = (log.where((F.col("feature_set") == feature_set) & (F.col("version") == version))
            .select(F.col("entity_id").alias("_k"), F.col("stored_at").alias("_ts"),
                    F.struct("stored_at", "ttl_seconds", "features").alias("_w"), F.lit(1).alias("_isw"),
                    F.col("transaction_id").alias("_tb")))
    p = probes.select(F.col(probe_key).alias("_k"), F.col("timestamp").alias("_ts"),
                      F.lit(None).cast(w.schema["_w"].dataType).alias("_w"), F.lit(0).alias("_isw"),
                      F.col("transaction_id").alias("_tb"), F.col("transaction_id").alias("_pid"))
    u = w.withColumn("_pid", F.lit(None).cast("string")).unionByName(p)
    u = u.withColumn("_b", F.floor(T.epoch_seconds("_ts") / F.lit(float(bucket_seconds))).cast("long"))
    # writes at the same instant as a probe are not "before" it: probes first
    win = Window.partitionBy("_k", "_b").orderBy("_ts", "_isw", "_tb").rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("_in", F.last("_w", ignorenulls=True).over(win))
    per_b = u.groupBy("_k", "_b").agg(
        F.max_by("_w", F.when(F.col("_isw") == 1, F.struct("_ts", "_tb"))).alias("_bl"))
    wb = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_b = per_b.select("_k", "_b", F.last("_bl", ignorenulls=True).over(wb).alias("_carry"))
    pr = u.where(F.col("_isw") == 0).join(per_b, ["_k", "_b"], "left")
    got = F.coalesce("_in", "_carry")
    ok = got.isNotNull() & ((got["stored_at"] + F.make_interval(secs=got["ttl_seconds"].cast("decimal(18,6)"))) > F.col("_ts"))
    return pr.select(F.col("_pid").alias("transaction_id"), F.col("_k").alias(probe_key),
                     F.when(ok, got["features"]).alias("features"),
                     F.when(ok, got["stored_at"]).alias("feature_stored_at"))
