"""Stored records (A1, A5, O5), the training gate (B8) and the SQL functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqlfn
from ..functions import time as T
from ..operators import advice as AD
from ..operators import ingest as IN
from ..operators import labelstore as LS
from ..operators import tagging as TG
from ..operators.ingest import scratch_path
from ..sources import catalog_csv
from ..sources.adapters import catalog, txn
from ..sources.snapshots import Snapshots
from ..sources.tables import table
from . import sqlx as S
from .common import finish, rounded
from .oracle_base import CATALOG, TXN, with_
from .q_advice import REQ
from .q_tagging import CDIM, LABELS, VOTES, _CID
from .registry import register

HALF = "2024-01-16 00:00:00"


# --- A5 ----------------------------------------------------------------------
@register("label_store", rounded(with_(TXN, VOTES, LABELS) + """
SELECT signature, category_name, confidence, votes, CAST(1 AS BIGINT) AS rejected_lines FROM lbl""", ["confidence"]))
def q_label_store(spark, sf):
    """The JSON label store after two rewrites, the votes of either half of
    the month, with a line cut off in between."""
    votes = TG.community_votes(txn(spark, sf))
    store = Snapshots(spark, scratch_path(spark, "label_store"))
    LS.add_votes(store, votes.where(F.col("ts") < T.ntz_literal(HALF)))
    cut = LS.entries(store).agg(F.min(F.to_json(F.struct(*LS.FIELDS))).alias("line"))
    _, path = store.current()
    cut.select(F.substring(F.coalesce("line", F.lit("{]")), 1, 20).alias("value")).write.mode("append").text(f"{path}/entries")
    LS.add_votes(store, votes.where(F.col("ts") >= T.ntz_literal(HALF)))
    return finish(LS.entries(store).withColumn("rejected_lines", LS.rejected(store).agg(F.count(F.lit(1))).scalar()))


# --- O5 ----------------------------------------------------------------------
REVISED, REVISED_CONFIDENCE = "2024-01-08", 0.9
_ASKED = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL ((conv_id * 7 + turn) % 30) DAY + INTERVAL (turn % 1440) MINUTE"


def _interactions(spark, sf):
    req = AD.requests(table(spark, sf, "conversations"))
    asked = (T.ntz_literal("2024-01-01 00:00:00")
             + F.make_dt_interval(F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(30)).cast("int"), F.lit(0),
                                  F.pmod("turn", F.lit(1440)).cast("int")))
    return AD.interactions(req.withColumn("asked_at", asked.cast("timestamp_ntz")))


@register("advice_log", rounded(with_(REQ) + f""", lg AS (SELECT *, {_ASKED} AS asked_at,
  CASE WHEN context_type = 'goal_setting' THEN {S.q(AD.FALLBACK['goal_setting'][0])} ELSE {S.q(AD.FALLBACK['spending_review'][0])} END AS advice FROM req)
SELECT concat('advice_', user_id, '_', strftime(asked_at, '%Y%m%d')) AS feature_key, user_id, strftime(asked_at, '%Y-%m-%d') AS day, count(*) AS n_requests,
  arg_max(query, (asked_at, conv_id, turn)) AS query, arg_max(context_type, (asked_at, conv_id, turn)) AS context_type,
  arg_max(advice, (asked_at, conv_id, turn)) AS advice_given,
  CASE WHEN strftime(asked_at, '%Y-%m-%d') = '{REVISED}' THEN {REVISED_CONFIDENCE} ELSE 0.6 END AS confidence_score
FROM lg GROUP BY ALL""", ["confidence_score"]))
def q_advice_log(spark, sf):
    """The log of a month, of which every third day is replayed and one day
    comes once more with a revised confidence; latest per user and day."""
    log = _interactions(spark, sf)
    path = AD.write_log(log, scratch_path(spark, "advice_log"))
    AD.write_log(log.where(F.dayofmonth("day") % 3 == 0), path)
    AD.write_log(log.where(F.col("day") == F.lit(REVISED).cast("date")).withColumn("confidence_score", F.lit(REVISED_CONFIDENCE)), path)
    return finish(AD.latest_interactions(AD.read_log(spark, path)))


# --- A1 ----------------------------------------------------------------------
def _catalog_files(spark, sf):
    """The catalog as CSV files, among them lines with one field (suppliers
    with a negative balance and an even key) or four (odd)."""
    path = catalog_csv.write_csv(catalog(spark, sf), scratch_path(spark, "catalog_csv"))
    bad = table(spark, sf, "supplier").where(F.col("s_acctbal") < 0)
    even = F.col("s_suppkey") % 2 == 0
    for rows in (bad.where(even).select(F.col("s_name").alias("Merchant Name")),
                 bad.where(~even).select(F.col("s_name").alias("Merchant Name"), F.lit("Other").alias("Category"),
                                         F.lit("x").alias("Subcategory"), F.col("s_suppkey").alias("Extra"))):
        rows.write.mode("append").option("header", True).csv(path)
    return path


@register("catalog_dim", rounded(with_(CATALOG, CDIM) + f"""
SELECT normalized_name, canonical_category, {_CID('canonical_category')} AS canonical_id FROM cdim""", ["canonical_id"]))
def q_catalog_dim(spark, sf):
    rows, _ = catalog_csv.read_csv(spark, _catalog_files(spark, sf))
    return finish(TG.catalog_dim(rows))


@register("catalog_rejects", """SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE concat(s_name, ',Other,x,', s_suppkey) END AS line
FROM supplier WHERE s_acctbal < 0""")
def q_catalog_rejects(spark, sf):
    """The lines of the catalog files with too few or too many fields."""
    _, rejected = catalog_csv.read_csv(spark, _catalog_files(spark, sf))
    return finish(rejected.select("line"))


# --- B8 ----------------------------------------------------------------------
@register("training_rows", rounded(with_(TXN) + """
SELECT transaction_id, user_id, amount, category AS label FROM txn
WHERE amount > 0 AND (SELECT count(*) FROM txn WHERE amount > 0) >= 100""", ["amount"]))
def q_training_rows(spark, sf):
    """Rows with a positive amount, if there are at least 100 of them."""
    t = IN.training_rows(txn(spark, sf), 100)
    return finish(t.select("transaction_id", "user_id", "amount", F.col("category").alias("label")))


# --- U -----------------------------------------------------------------------
@register("sql_functions", with_(TXN) + f"""
SELECT transaction_id, {S.norm('merchant_name')} AS merchant_token, {S.handle('vpa')} AS vpa_handle,
  {S.signature('merchant_name', S.handle('vpa'), "''")} AS signature FROM txn""")
def q_sql_functions(spark, sf):
    """C1, C2 and C15 through the session's SQL functions."""
    sqlfn.register(spark)
    return finish(spark.sql("SELECT transaction_id, normalize_name(merchant_name) AS merchant_token, vpa_handle(vpa) AS vpa_handle, "
                            "label_signature(merchant_name, vpa_handle(vpa), '') AS signature FROM {t}", t=txn(spark, sf)))
