"""Ingest, validation, CSV round trip, splits."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as T
from ..operators import ingest as IN
from ..operators import matrices as MX
from ..sources.adapters import pay, txn
from .common import finish, rounded
from .oracle_base import PAY, TXN, with_
from .q_matrices import PARITY_SQL, _parity
from .registry import register

AS_OF = "2024-02-01T00:00:00"
_TS = '"timestamp"'
_TXT = "strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"
RECENT_FROM = "2024-01-24"


# records as clients send them: some without a timestamp; and, for the
# validation, some with an unreadable amount or timestamp or without merchant
NO_TS, BAD_AMOUNT, BAD_TS, NO_MERCHANT = 90, 50, 70, 30
_ID = "CAST(transaction_id AS BIGINT)"


def _records(spark, sf):
    t = txn(spark, sf)
    gone = F.col("transaction_id").cast("bigint") % NO_TS == 0
    return IN.ingest_json(IN.json_batches(t.withColumn("timestamp", F.when(~gone, F.col("timestamp")))), AS_OF)


def _faulty(spark, sf):
    n = F.col("transaction_id").cast("bigint")
    return (_records(spark, sf).withColumn("amount", F.when(n % BAD_AMOUNT == 0, "n/a").otherwise(F.col("amount")))
            .withColumn("timestamp", F.when(n % BAD_TS == 0, "yesterday").otherwise(F.col("timestamp")))
            .withColumn("merchant_name", F.when(n % NO_MERCHANT != 0, F.col("merchant_name"))))


@register("json_batch_ingest", rounded(with_(TXN) + f"""
SELECT CAST(floor(CAST(transaction_id AS BIGINT) / 100) AS BIGINT) AS batch_id, transaction_id, user_id, merchant_name,
  CAST(amount AS VARCHAR) AS amount, CASE WHEN {_ID} % {NO_TS} = 0 THEN '{AS_OF}' ELSE strftime({_TS}, '%Y-%m-%dT%H:%M:%S.%f') END AS "timestamp" FROM txn""", []))
def q_json_batch_ingest(spark, sf):
    return finish(_records(spark, sf).select("batch_id", "transaction_id", "user_id", "merchant_name", "amount",
                                             "timestamp"))


@register("validate_transactions", rounded(with_(TXN) + f"""
SELECT transaction_id, user_id, CASE WHEN {_ID} % {NO_MERCHANT} = 0 THEN 'Unknown' ELSE coalesce(merchant_name, 'Unknown') END AS merchant_name,
  amount, CASE WHEN {_ID} % {NO_TS} = 0 THEN '{AS_OF.replace('T', ' ')}.000000' ELSE {_TXT.format(x=_TS)} END AS ts FROM txn
WHERE amount IS NOT NULL AND {_TS} IS NOT NULL AND {_ID} % {BAD_AMOUNT} <> 0 AND {_ID} % {BAD_TS} <> 0""", ["amount"]))
def q_validate_transactions(spark, sf):
    v = IN.validate(_faulty(spark, sf))
    return finish(v.select("transaction_id", "user_id", coalesce_unknown(), "amount", T.ts_text("timestamp").alias("ts")))


def coalesce_unknown():
    return F.coalesce("merchant_name", F.lit("Unknown")).alias("merchant_name")


@register("csv_roundtrip", rounded(with_(PAY) + f"""
SELECT transaction_id, user_id, merchant_name, amount, {_TXT.format(x=_TS)} AS ts, category, vpa, source FROM pay""", ["amount"]))
def q_csv_roundtrip(spark, sf):
    """A4 then A2: write the table as CSV, read it back with the schema."""
    p = pay(spark, sf).select("transaction_id", "user_id", "merchant_name", "amount", "timestamp", "category", "vpa", "source")
    path = IN.write_csv(p, IN.scratch_path(spark, "pay_csv"))
    back = IN.read_csv(spark, path)
    return finish(back.select("transaction_id", "user_id", "merchant_name", "amount", T.ts_text("timestamp").alias("ts"),
                              "category", "vpa", "source"))


@register("load_transactions", rounded(with_(TXN) + f"""
SELECT transaction_id, user_id, merchant_name, amount, {_TXT.format(x=_TS)} AS ts, category AS label,
  CAST(row_number() OVER (ORDER BY {_TS}, transaction_id) AS BIGINT) AS load_order FROM txn""", ["amount"]))
def q_load_transactions(spark, sf):
    """A2 + I7: labelled CSV scan (schema on read, required columns) and a
    global sort by timestamp (range-partitioned ``orderBy``); the position
    comes from the distributed prefix count, not a one-partition window."""
    from ..operators.ranking import with_global_position
    t = txn(spark, sf).select("transaction_id", "user_id", "merchant_name", "amount", "timestamp", "category", "vpa", "source")
    path = IN.write_csv(t, IN.scratch_path(spark, "txn_csv"))
    back = IN.read_csv(spark, path).orderBy("timestamp", "transaction_id")
    key = F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("|"), F.col("transaction_id"))
    pos = with_global_position(back.withColumn("_k", key), "_k", out="_p")
    return finish(pos.select("transaction_id", "user_id", "merchant_name", "amount", T.ts_text("timestamp").alias("ts"),
                             F.col("category").alias("label"), (F.col("_p") + 1).cast("long").alias("load_order")))


@register("stratified_split", with_(PAY) + """
SELECT transaction_id, category, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT transaction_id, category, row_number() OVER (PARTITION BY category ORDER BY CAST(('0x' || substr(md5(transaction_id), 1, 15)) AS BIGINT), transaction_id) AS rn,
    count(*) OVER (PARTITION BY category) AS n FROM pay)""")
def q_stratified_split(spark, sf):
    t = pay(spark, sf).select("transaction_id", "category")
    return finish(IN.stratified_split(t, "category", "transaction_id").select("transaction_id", "category", "split"))


@register("delta_training_union", rounded(with_(TXN) + f"""
SELECT transaction_id, category AS label, CASE WHEN {_TS} >= TIMESTAMP '{RECENT_FROM}' THEN 2.0 ELSE 1.0 END AS weight FROM txn""",
    ["weight"]))
def q_delta_training_union(spark, sf):
    t = txn(spark, sf).select("transaction_id", F.col("category").alias("label"), "timestamp")
    cut = F.lit(RECENT_FROM).cast("timestamp_ntz")
    u = IN.delta_union(t.where(F.col("timestamp") >= cut), t.where(F.col("timestamp") < cut))
    return finish(u.select("transaction_id", "label", "weight"))


_TYPES = {c: ("bigint" if c in MX.PARITY_CATEGORICAL else "double") for c in MX.PARITY_COLUMNS}


@register("feature_quality_report", f"WITH p AS ({PARITY_SQL}) SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{c}', 1, '{_TYPES[c]}', '{_TYPES[c]}', 1, (SELECT count(*) FILTER (WHERE {c} IS NULL) FROM p))"
    for i, c in enumerate(MX.PARITY_COLUMNS))
    + ") AS v(position, feature, present, actual_type, expected_type, dtype_match, null_count)")
def q_feature_quality_report(spark, sf):
    """B2 on the parity matrix: presence, dtype and null count per column."""
    return finish(MX.quality_report(_parity(spark, sf), MX.PARITY_COLUMNS, _TYPES))
