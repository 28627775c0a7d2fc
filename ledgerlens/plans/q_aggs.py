"""Aggregates (G), ordered windows (H) and top-k (I)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as T
from ..operators import aggregates as A
from ..operators import windows as W
from ..sources.adapters import pay, txn
from .common import finish, rounded
from .oracle_base import PAY, TXN, with_
from .registry import register

_TS = '"timestamp"'
_US = f"epoch_us({_TS})"


# --- H1 / H7 -----------------------------------------------------------------
def _familiarity(spark, sf):
    t = txn(spark, sf).select("transaction_id", "user_id", "merchant_name", "timestamp")
    return W.with_running_count(t, ["user_id", "merchant_name"], "timestamp", "transaction_id",
                                out="user_merchant_familiarity")


@register("user_merchant_familiarity", with_(TXN) + f"""
SELECT transaction_id, user_id, merchant_name,
  row_number() OVER (PARTITION BY user_id, merchant_name ORDER BY {_TS}, transaction_id) AS user_merchant_familiarity
FROM txn""")
def q_user_merchant_familiarity(spark, sf):
    return finish(_familiarity(spark, sf).drop("timestamp"))


@register("payee_seen_before", with_(TXN) + f"""
SELECT transaction_id,
  CAST(row_number() OVER (PARTITION BY user_id, merchant_name ORDER BY {_TS}, transaction_id) > 1 AS INTEGER) AS payee_seen_before,
  CAST(row_number() OVER (PARTITION BY user_id, merchant_name ORDER BY {_TS}, transaction_id) = 1 AS INTEGER) AS merchant_is_new
FROM txn""")
def q_payee_seen_before(spark, sf):
    f = _familiarity(spark, sf)
    return finish(f.select("transaction_id",
                           (F.col("user_merchant_familiarity") > 1).cast("int").alias("payee_seen_before"),
                           (F.col("user_merchant_familiarity") == 1).cast("int").alias("merchant_is_new")))


# --- H3 ----------------------------------------------------------------------
@register("txn_gaps", rounded(with_(TXN) + f"""
SELECT transaction_id, user_id,
  ({_US} - lag({_US}) OVER (PARTITION BY user_id ORDER BY {_TS}, transaction_id)) / 3600000000.0 AS gap_hours
FROM txn""", ["gap_hours"]))
def q_txn_gaps(spark, sf):
    t = txn(spark, sf).select("transaction_id", "user_id", "timestamp")
    g = W.with_prev_ts(t, ["user_id"], "timestamp", "transaction_id")
    return finish(g.select("transaction_id", "user_id",
                           ((T.epoch_micros("timestamp") - T.epoch_micros("prev_ts")) / F.lit(3.6e9)).alias("gap_hours")))


# --- H6 ----------------------------------------------------------------------
def _vel_sql(hours):
    return (f"count(*) OVER (PARTITION BY user_id ORDER BY {_US} "
            f"RANGE BETWEEN {hours * 3600 * 1_000_000 - 1} PRECEDING AND CURRENT ROW)")


@register("txn_velocity", with_(TXN) + f"""
SELECT transaction_id, user_id, {_vel_sql(1)} AS transactions_last_hour,
  {_vel_sql(24)} AS transactions_last_day, {_vel_sql(168)} AS transactions_last_week FROM txn""")
def q_txn_velocity(spark, sf):
    t = txn(spark, sf).select("transaction_id", "user_id", "timestamp")
    one = F.lit(1)
    names = ("transactions_last_hour", "transactions_last_day", "transactions_last_week")
    out = t.join(W.rolling_stats(t, ["user_id"], "timestamp", "transaction_id",
                                 dict(zip(names, ((one, 3600), (one, 24 * 3600), (one, 168 * 3600)))), include_current=True),
                 "transaction_id")
    return finish(out.select("transaction_id", "user_id", *[F.col(c).cast("long").alias(c) for c in names]))


# --- I4 ----------------------------------------------------------------------
@register("recent_transactions", rounded(with_(TXN) + f"""
SELECT user_id, rank, transaction_id, merchant_name, amount, strftime({_TS}, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_TS} DESC, transaction_id DESC) AS rank FROM txn)
WHERE rank <= 5""", ["amount"]))
def q_recent_transactions(spark, sf):
    t = txn(spark, sf).select("user_id", "transaction_id", "merchant_name", "amount", "timestamp")
    top = A.top_k(t, ["user_id"], [F.col("timestamp").desc(), F.col("transaction_id").desc()], 5)
    return finish(top.select("user_id", F.col("rank").cast("long").alias("rank"), "transaction_id", "merchant_name",
                             "amount", T.ts_text("timestamp").alias("ts")))


# --- G4 ----------------------------------------------------------------------
@register("spending_summary", rounded(with_(PAY, """per AS (SELECT user_id, sum(amount) AS total_spending, avg(amount) AS average_transaction,
   count(*) AS transaction_count, quantile_cont(amount, 0.95) AS p95 FROM pay GROUP BY user_id)""",
"""cats AS (SELECT user_id, coalesce(category, 'other') AS c, sum(amount) AS s FROM pay GROUP BY user_id, category)""",
"""top AS (SELECT user_id, string_agg(c, '|' ORDER BY s DESC, c) AS top_categories FROM (
   SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, c) AS rn FROM cats) WHERE rn <= 5 GROUP BY user_id)""") + """
SELECT per.user_id, total_spending, average_transaction, transaction_count,
  (SELECT count(*) FROM pay WHERE pay.user_id = per.user_id AND pay.amount > per.p95) AS unusual_transactions,
  top_categories
FROM per JOIN top USING (user_id)""", ["total_spending", "average_transaction"]))
def q_spending_summary(spark, sf):
    return finish(A.spending_summary(pay(spark, sf)))


# --- G7 / G8 / G9 / G13 / G12 ------------------------------------------------
@register("merchant_peak_hours", with_(TXN, f"""hc AS (SELECT vpa, hour({_TS}) AS hour, count(*) AS n FROM txn
  WHERE {_TS} IS NOT NULL GROUP BY vpa, hour({_TS}))""",
"""mu AS (SELECT vpa, avg(n) AS m, sum(n) AS n_timed FROM hc GROUP BY vpa)""") + """
SELECT vpa, coalesce(string_agg(CASE WHEN n > m THEN CAST(hour AS VARCHAR) END, ',' ORDER BY hour), '') AS peak_hours,
  any_value(n_timed) AS n_timed
FROM hc JOIN mu USING (vpa) GROUP BY vpa""")
def q_merchant_peak_hours(spark, sf):
    return finish(A.peak_hours(txn(spark, sf), "vpa"))


@register("merchant_seasonality", rounded(with_(PAY, f"""mc AS (SELECT vpa, strftime({_TS}, '%B') AS month_name, count(*) AS n
  FROM pay WHERE {_TS} IS NOT NULL GROUP BY ALL)""") + """
SELECT vpa, month_name, n / sum(n) OVER (PARTITION BY vpa) AS share FROM mc""", ["share"]))
def q_merchant_seasonality(spark, sf):
    return finish(A.seasonality(pay(spark, sf), "vpa"))


@register("merchant_growth", rounded(with_(PAY, f"""mv AS (SELECT vpa, strftime({_TS}, '%Y-%m') AS m, sum(amount) AS v FROM pay
  WHERE {_TS} IS NOT NULL AND amount IS NOT NULL AND amount <> 0 GROUP BY ALL)""",
"""per AS (SELECT vpa, count(*) AS months, arg_min(v, m) AS first_v, arg_max(v, m) AS last_v FROM mv GROUP BY vpa)""",
"""n AS (SELECT vpa, count(*) AS n FROM pay GROUP BY vpa)""") + """
SELECT n.vpa, n.n, coalesce(months, 0) AS months,
  CASE WHEN n.n < 4 OR coalesce(months, 0) < 2 THEN 0.5
       ELSE least(1.0, greatest(0.0, 0.5 + (last_v - first_v) / greatest(first_v, 1.0))) END AS growth_trend
FROM n LEFT JOIN per USING (vpa)""", ["growth_trend"]))
def q_merchant_growth(spark, sf):
    return finish(A.growth(pay(spark, sf), "vpa"))


@register("merchant_pricing", rounded(with_(PAY) + """
SELECT vpa, avg(amount) AS average_transaction, quantile_cont(amount, 0.5) AS median_transaction,
  CASE WHEN avg(amount) > 0 THEN stddev_pop(amount) / avg(amount) ELSE 0.0 END AS price_volatility
FROM pay WHERE amount IS NOT NULL AND amount <> 0 GROUP BY vpa""",
    ["average_transaction", "median_transaction", "price_volatility"]))
def q_merchant_pricing(spark, sf):
    return finish(A.pricing(pay(spark, sf), "vpa"))


@register("dataset_summary", rounded(with_(PAY) + """
SELECT coalesce(category, '(null)') AS category, count(*) AS n, avg(amount) AS mean_amount,
  quantile_cont(amount, 0.5) AS median_amount, min(amount) AS min_amount, max(amount) AS max_amount
FROM pay GROUP BY 1
UNION ALL
SELECT '*', count(*), avg(amount), quantile_cont(amount, 0.5), min(amount), max(amount) FROM pay""",
    ["mean_amount", "median_amount", "min_amount", "max_amount"]))
def q_dataset_summary(spark, sf):
    return finish(A.dataset_summary(pay(spark, sf)))


# --- H4 / M2 -----------------------------------------------------------------
def merchant_frequency_df(t, key="vpa"):
    g = W.with_prev_ts(t.where(F.col("timestamp").isNotNull()).select(key, "transaction_id", "timestamp"),
                       [key], "timestamp", "transaction_id")
    per = g.groupBy(key).agg(F.count(F.lit(1)).alias("n_timed"),
                             F.avg(T.whole_days_between("timestamp", "prev_ts")).alias("mean_gap_days"))
    n = t.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    m = F.col("mean_gap_days")
    score = (F.when((F.col("n") < 2) | (F.coalesce("n_timed", F.lit(0)) < 2), 0.0)
              .when(m <= 1, 1.0).when(m <= 7, 0.8).when(m <= 30, 0.6).when(m <= 90, 0.4).otherwise(0.2))
    return n.join(per, key, "left").select(key, "n", "mean_gap_days", score.alias("frequency_score"))


@register("merchant_frequency", rounded(with_(PAY, f"""g AS (SELECT vpa, floor(({_US} - lag({_US}) OVER (PARTITION BY vpa ORDER BY {_TS}, transaction_id)) / 86400000000.0) AS gd
  FROM pay WHERE {_TS} IS NOT NULL)""",
"""per AS (SELECT vpa, count(*) AS n_timed, avg(gd) AS mean_gap_days FROM g GROUP BY vpa)""",
"""n AS (SELECT vpa, count(*) AS n FROM pay GROUP BY vpa)""") + """
SELECT vpa, n, mean_gap_days,
  CASE WHEN n < 2 OR coalesce(n_timed, 0) < 2 THEN 0.0 WHEN mean_gap_days <= 1 THEN 1.0 WHEN mean_gap_days <= 7 THEN 0.8
       WHEN mean_gap_days <= 30 THEN 0.6 WHEN mean_gap_days <= 90 THEN 0.4 ELSE 0.2 END AS frequency_score
FROM n LEFT JOIN per USING (vpa)""", ["mean_gap_days", "frequency_score"]))
def q_merchant_frequency(spark, sf):
    return finish(merchant_frequency_df(pay(spark, sf)))
