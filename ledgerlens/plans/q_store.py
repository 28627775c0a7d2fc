"""Feature-store tables on the writes a scoring stream makes over ``events``.

All keys read one stored table: the stream writes it once per application and
source table, and again when a source file changes."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as T
from ..operators import featurestore as FS
from ..operators.ingest import scratch_path
from ..sources import fs
from ..sources.adapters import txn
from ..sources.tables import table
from ..streaming import jobs as J
from .common import finish, rounded
from .oracle_base import TXN, with_
from .registry import register

AS_OF = "2024-01-31T00:00:00"
LARGE = 100  # amount of a failed payment that invalidates the user's features
_AS = f"TIMESTAMP '{AS_OF.replace('T', ' ')}'"
_TXT = "strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"

LOG = """log AS (
  SELECT 'user_txn' AS feature_set, 'v1' AS version, user_id AS entity_id, amount AS f_amount, CAST(hour("timestamp") AS DOUBLE) AS f_hour,
         rating AS f_rating, CAST(isodow("timestamp") - 1 AS DOUBLE) AS f_weekday, "timestamp" AS stored_at, 86400 AS ttl_seconds, transaction_id FROM txn
  UNION ALL
  SELECT 'merchant_txn', 'v1', merchant_name, amount, CAST(hour("timestamp") AS DOUBLE), NULL, CAST(isodow("timestamp") - 1 AS DOUBLE),
         "timestamp", 3600, transaction_id FROM txn)"""
LATEST = """lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_set, version, entity_id
   ORDER BY stored_at DESC, transaction_id DESC) AS rn FROM log) WHERE rn = 1)"""
_EXP = "(stored_at + to_seconds(ttl_seconds))"


_STORES: dict[tuple, str] = {}


def _store(spark, sf):
    """Path of the stored table of ``events`` as its files are now."""
    key = (spark.sparkContext.applicationId, sf, fs.stamp(spark, f"{sf.rstrip('/')}/events.parquet"))
    if key not in _STORES:
        _STORES[key] = J.stream_features(J.stream_txn(spark, sf), scratch_path(spark, "feature_store")).path
    return _STORES[key]


def _log(spark, sf, feature_set=None):
    return FS.stored(spark, _store(spark, sf), feature_set)


def _flat(df):
    return df.select(*FS.KEY, F.col("features")["amount"].alias("f_amount"), F.col("features")["hour"].alias("f_hour"),
                     F.col("features")["rating"].alias("f_rating"), F.col("features")["weekday"].alias("f_weekday"),
                     *[c for c in df.columns if c not in FS.KEY + ["features"]])


@register("fs_store_latest", rounded(with_(TXN, LOG, LATEST) + f"""
SELECT feature_set, version, entity_id, f_amount, f_hour, f_rating, f_weekday, {_TXT.format(x='stored_at')} AS stored_at, ttl_seconds
FROM lat WHERE {_EXP} > {_AS}""", ["f_amount", "f_hour", "f_rating", "f_weekday"]))
def q_fs_store_latest(spark, sf):
    lv = FS.live(FS.latest(_log(spark, sf)), AS_OF)
    return finish(_flat(lv).withColumn("stored_at", T.ts_text("stored_at")))


@register("fs_freshness", rounded(with_(TXN, LOG, LATEST) + f"""
SELECT feature_set, version, entity_id, {_TXT.format(x='stored_at')} AS stored_at,
  (epoch_us({_AS}) - epoch_us(stored_at)) / 1e6 AS age_seconds,
  ttl_seconds - (epoch_us({_AS}) - epoch_us(stored_at)) / 1e6 AS remaining_ttl,
  {_TXT.format(x=_EXP)} AS expires_at, CAST({_EXP} > {_AS} AS INTEGER) AS is_fresh
FROM lat""", ["age_seconds", "remaining_ttl"]))
def q_fs_freshness(spark, sf):
    return finish(FS.freshness(FS.latest(_log(spark, sf)), AS_OF))


@register("fs_expired", with_(TXN, LOG, LATEST) + f"""
SELECT feature_set, version, count(*) AS expired FROM lat WHERE {_EXP} <= {_AS} GROUP BY ALL""")
def q_fs_expired(spark, sf):
    lat = FS.latest(_log(spark, sf))
    return finish(lat.where(FS.expires_at() <= FS.asof_lit(AS_OF)).groupBy("feature_set", "version")
                  .agg(F.count(F.lit(1)).alias("expired")))


@register("fs_inventory", with_(TXN, LOG, LATEST) + f"""
SELECT feature_set, count(*) AS live_keys FROM lat WHERE {_EXP} > {_AS} GROUP BY ALL""")
def q_fs_inventory(spark, sf):
    lv = FS.live(FS.latest(_log(spark, sf)), AS_OF)
    return finish(lv.groupBy("feature_set").agg(F.count(F.lit(1)).alias("live_keys")))


REQ = """req AS (SELECT 'user_txn' AS feature_set, 'v1' AS version, CAST(c_custkey AS VARCHAR) AS entity_id FROM customer)"""


def _requests(spark, sf):
    return table(spark, sf, "customer").select(F.lit("user_txn").alias("feature_set"), F.lit("v1").alias("version"),
                                               F.col("c_custkey").cast("string").alias("entity_id"))


@register("fs_batch_get", rounded(with_(TXN, LOG, LATEST, REQ) + f"""
SELECT feature_set, version, entity_id, f_amount, f_hour, f_rating, f_weekday FROM lat
WHERE {_EXP} > {_AS} AND (feature_set, version, entity_id) IN (SELECT (feature_set, version, entity_id) FROM req)""",
    ["f_amount", "f_hour", "f_rating", "f_weekday"]))
def q_fs_batch_get(spark, sf):
    """every customer is a requested key; live hits only."""
    got = FS.batch_get(FS.latest(_log(spark, sf)), _requests(spark, sf), AS_OF)
    return finish(_flat(got).drop("stored_at", "ttl_seconds"))


@register("fs_stats", rounded(with_(TXN, LOG, LATEST, REQ) + f"""
SELECT r.feature_set, r.version, count(*) AS requested, count(l.entity_id) AS hits, count(l.entity_id) / count(*) AS hit_rate
FROM req r LEFT JOIN (SELECT * FROM lat WHERE {_EXP} > {_AS}) l USING (feature_set, version, entity_id) GROUP BY ALL""",
    ["hit_rate"]))
def q_fs_stats(spark, sf):
    """G16 over the batch-get access log: requested, hits, hit rate per set."""
    lv = FS.live(FS.latest(_log(spark, sf)), AS_OF).select(*FS.KEY, F.lit(1).alias("_hit"))
    r = _requests(spark, sf).join(lv, FS.KEY, "left")
    return finish(r.groupBy("feature_set", "version").agg(
        F.count(F.lit(1)).alias("requested"), F.count("_hit").alias("hits"),
        (F.count("_hit") / F.count(F.lit(1))).alias("hit_rate")))


_TOMB = f"""tomb AS (SELECT DISTINCT 'user_txn' AS feature_set, 'v1' AS version, user_id AS entity_id
  FROM txn WHERE category = 'error' AND amount > {LARGE})"""


@register("fs_invalidate", with_(TXN, LOG, LATEST, _TOMB) + """
SELECT feature_set, version, entity_id FROM lat
WHERE (feature_set, version, entity_id) NOT IN (SELECT (feature_set, version, entity_id) FROM tomb)""")
def q_fs_invalidate(spark, sf):
    """Keys of the stored table read back after users with a large failed
    payment were deleted from it."""
    path = FS.store(FS.feature_log(txn(spark, sf)), scratch_path(spark, "feature_store"))
    FS.compact(spark, path, _tombstones(spark, sf))
    return finish(FS.latest(FS.stored(spark, path)).select(*FS.KEY))


def _tombstones(spark, sf):
    t = txn(spark, sf)
    return t.where((F.col("category") == "error") & (F.col("amount") > LARGE)).select(
        F.lit("user_txn").alias("feature_set"), F.lit("v1").alias("version"), F.col("user_id").alias("entity_id"))


@register("fs_compaction", with_(TXN, LOG, LATEST, _TOMB) + f"""
SELECT feature_set, version, entity_id, {_TXT.format(x='stored_at')} AS stored_at, transaction_id FROM lat
WHERE {_EXP} > {_AS} AND (feature_set, version, entity_id) NOT IN (SELECT (feature_set, version, entity_id) FROM tomb)""")
def q_fs_compaction(spark, sf):
    """The rows of the stored table after a full compaction: no deleted
    or expired key, one write per key."""
    path = FS.store(FS.feature_log(txn(spark, sf)), scratch_path(spark, "feature_store"))
    FS.compact(spark, path, _tombstones(spark, sf), AS_OF, history=False)
    return finish(FS.stored(spark, path).select(*FS.KEY, T.ts_text("stored_at").alias("stored_at"), "transaction_id"))


@register("fs_missing_features", with_(TXN, LOG, LATEST) + """
SELECT feature_set, version, entity_id,
  array_to_string(list_sort(list_filter(CASE feature_set WHEN 'user_txn' THEN ['amount', 'hour', 'rating', 'weekday']
     WHEN 'merchant_txn' THEN ['amount', 'hour', 'weekday'] ELSE [] END,
     lambda x: NOT ((x = 'amount' AND f_amount IS NOT NULL) OR (x = 'hour' AND f_hour IS NOT NULL)
                    OR (x = 'rating' AND f_rating IS NOT NULL) OR (x = 'weekday' AND f_weekday IS NOT NULL)))), ',') AS missing_features,
  CAST(len(list_filter(CASE feature_set WHEN 'user_txn' THEN ['amount', 'hour', 'rating', 'weekday']
     WHEN 'merchant_txn' THEN ['amount', 'hour', 'weekday'] ELSE [] END,
     lambda x: NOT ((x = 'amount' AND f_amount IS NOT NULL) OR (x = 'hour' AND f_hour IS NOT NULL)
                    OR (x = 'rating' AND f_rating IS NOT NULL) OR (x = 'weekday' AND f_weekday IS NOT NULL)))) AS BIGINT) AS n_missing
FROM lat""")
def q_fs_missing_features(spark, sf):
    return finish(FS.missing_features(FS.latest(_log(spark, sf))))


@register("fs_asof_join", rounded(with_(TXN, LOG) + f"""
SELECT p.transaction_id, p.user_id,
  CASE WHEN l.stored_at + to_seconds(l.ttl_seconds) > p."timestamp" THEN l.f_amount END AS f_amount,
  CASE WHEN l.stored_at + to_seconds(l.ttl_seconds) > p."timestamp" THEN l.f_hour END AS f_hour,
  CASE WHEN l.stored_at + to_seconds(l.ttl_seconds) > p."timestamp" THEN {_TXT.format(x='l.stored_at')} END AS feature_stored_at
FROM txn p ASOF LEFT JOIN (SELECT * FROM log WHERE feature_set = 'user_txn') l
  ON p.user_id = l.entity_id AND p."timestamp" > l.stored_at""", ["f_amount", "f_hour"]))
def q_fs_asof_join(spark, sf):
    t = txn(spark, sf)
    j = FS.asof_join(t.select("transaction_id", "user_id", "timestamp"), _log(spark, sf, "user_txn"), "user_id", "user_txn")
    return finish(j.select("transaction_id", "user_id", F.col("features")["amount"].alias("f_amount"),
                           F.col("features")["hour"].alias("f_hour"),
                           T.ts_text("feature_stored_at").alias("feature_stored_at")))


ACCESS = """acc AS (SELECT feature_set, 'store' AS kind, FALSE AS hit FROM log
  UNION ALL SELECT r.feature_set, 'get', l.entity_id IS NOT NULL FROM req r LEFT JOIN (SELECT * FROM lat WHERE {live}) l USING (feature_set, version, entity_id)
  UNION ALL SELECT 'merchant_txn', 'batch_get', FALSE FROM supplier
  UNION ALL SELECT 'user_txn', 'invalidate', FALSE FROM txn WHERE category = 'error' AND amount > {large})"""


@register("fs_access_counts", rounded(with_(TXN, LOG, LATEST, REQ, ACCESS.format(live=f"{_EXP} > {_AS}", large=LARGE)) + """
SELECT feature_set, count(*) FILTER (kind = 'store') AS stores, count(*) FILTER (kind = 'get') AS gets,
  count(*) FILTER (kind = 'batch_get') AS batch_gets, count(*) FILTER (kind = 'invalidate') AS invalidations,
  CASE WHEN count(*) FILTER (kind = 'get') > 0 THEN count(*) FILTER (kind = 'get' AND hit) / count(*) FILTER (kind = 'get') END AS hit_rate
FROM acc GROUP BY feature_set""", ["hit_rate"]))
def q_fs_access_counts(spark, sf):
    """A store per write, a get per customer, a batch get per supplier,
    an invalidation per large failed payment."""
    log, t = _log(spark, sf), txn(spark, sf)
    lv = FS.live(FS.latest(log), AS_OF).select(*FS.KEY, F.lit(True).alias("hit"))
    gets = _requests(spark, sf).join(lv, FS.KEY, "left").select("feature_set", F.lit("get").alias("kind"), F.coalesce("hit", F.lit(False)).alias("hit"))

    def other(rows, name, kind):
        return rows.select(F.lit(name).alias("feature_set") if name else F.col("feature_set"), F.lit(kind).alias("kind"), F.lit(False).alias("hit"))

    acc = (other(log, None, "store").unionByName(gets).unionByName(other(table(spark, sf, "supplier"), "merchant_txn", "batch_get"))
           .unionByName(other(t.where((F.col("category") == "error") & (F.col("amount") > LARGE)), "user_txn", "invalidate")))
    return finish(FS.access_counts(acc))
