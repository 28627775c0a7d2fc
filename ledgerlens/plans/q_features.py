"""Rolling features (G3, G19), percentile rank (H2), cap state."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rolling as R
from ..operators.ranking import with_global_position
from ..sources.adapters import budgets, pay, txn
from . import sqlx as S
from .common import finish, rounded
from .oracle_base import PAY, TXN, with_
from .registry import register

_TS = '"timestamp"'
_US = f"epoch_us({_TS})"


def _win(part, days):
    return f"OVER (PARTITION BY {part} ORDER BY {_US} RANGE BETWEEN {days * 86400 * 1_000_000} PRECEDING AND 1 PRECEDING)"


def _user_roll_sql():
    hint = S.category_hint("merchant_name")
    inner = [f"{hint} AS hint", f"CAST(isodow({_TS}) - 1 >= 5 AS BOOLEAN) AS wk",
             f"(hour({_TS}) BETWEEN 17 AND 21) AS ev"]
    aggs = []
    for d in (7, 30):
        w = _win("user_id", d)
        aggs += [f"count(amount) {w} AS n{d}", f"sum(amount) {w} AS s{d}", f"max(amount) {w} AS mx{d}",
                 f"count(DISTINCT merchant_name) {w} AS u{d}"]
        for name, h in R.RATIO_GROUPS:
            aggs.append(f"sum(CASE WHEN hint = '{h}' THEN amount ELSE 0.0 END) {w} AS {name}{d}")
    w = _win("user_id", 30)
    aggs += [f"sum(CASE WHEN wk THEN amount ELSE 0.0 END) {w} AS wk30", f"sum(CASE WHEN ev THEN amount ELSE 0.0 END) {w} AS ev30"]
    D = R.USER_DEFAULTS
    cols = []
    for d in (7, 30):
        for name, _ in R.RATIO_GROUPS:
            k = f"user_{name}_ratio_{d}d"
            cols.append(f"CASE WHEN s{d} > 0 THEN {name}{d} / s{d} ELSE {D[k]!r} END AS {k}")
        cols += [f"CASE WHEN n{d} > 0 THEN s{d} / n{d} ELSE {D[f'user_avg_transaction_amount_{d}d']!r} END AS user_avg_transaction_amount_{d}d",
                 f"CASE WHEN n{d} > 0 THEN mx{d} ELSE {D[f'user_max_transaction_amount_{d}d']!r} END AS user_max_transaction_amount_{d}d",
                 f"CASE WHEN n{d} > 0 THEN CAST(n{d} AS DOUBLE) ELSE {D[f'user_transaction_frequency_{d}d']!r} END AS user_transaction_frequency_{d}d",
                 f"CASE WHEN n{d} > 0 THEN CAST(u{d} AS DOUBLE) ELSE {D[f'user_unique_merchants_{d}d']!r} END AS user_unique_merchants_{d}d"]
    cols += [f"CASE WHEN s30 > 0 THEN wk30 / s30 ELSE {D['user_weekend_spending_ratio']!r} END AS user_weekend_spending_ratio",
             f"CASE WHEN s30 > 0 THEN ev30 / s30 ELSE {D['user_evening_spending_ratio']!r} END AS user_evening_spending_ratio"]
    return (with_(TXN, f"b AS (SELECT *, {', '.join(inner)} FROM txn)", f"a AS (SELECT *, {', '.join(aggs)} FROM b)")
            + f"SELECT transaction_id, user_id, {', '.join(cols)} FROM a")


USER_ROLL_COLS = list(R.USER_DEFAULTS)


@register("rolling_user_features", rounded(_user_roll_sql(), USER_ROLL_COLS))
def q_rolling_user_features(spark, sf):
    r = R.user_rolling(txn(spark, sf))
    return finish(r.select("transaction_id", "user_id", *USER_ROLL_COLS))


def _merchant_roll_sql():
    M = R.MERCHANT_DEFAULTS
    w7, w30 = _win("merchant_name", 7), _win("merchant_name", 30)
    wc, wh = _win("merchant_name, coalesce(category, 'other')", 30), _win(f"merchant_name, hour({_TS})", 30)
    a = f"""a AS (SELECT transaction_id, merchant_name, count(amount) {w7} AS n7, count(amount) {w30} AS n30, avg(amount) {w30} AS mu30,
   var_pop(amount) {w30} AS var30, stddev_pop(amount) {w30} AS sd30,
   avg(CAST(isodow({_TS}) - 1 >= 5 AS DOUBLE)) {w30} AS wk30, avg(CAST(hour({_TS}) BETWEEN 9 AND 17 AS DOUBLE)) {w30} AS bh30,
   count(amount) {wc} AS nc30, count(amount) {wh} AS nh30,
   row_number() OVER (PARTITION BY merchant_name ORDER BY {_TS}, transaction_id) AS rc FROM txn)"""
    return with_(TXN, a) + f"""SELECT transaction_id, merchant_name, CAST(n7 AS DOUBLE) AS merchant_frequency_7d,
  CAST(n30 AS DOUBLE) AS merchant_frequency_30d, CAST(rc - 1 AS DOUBLE) AS merchant_frequency_all_time,
  CASE WHEN n30 > 0 THEN mu30 ELSE {M['merchant_avg_amount']!r} END AS merchant_avg_amount,
  CASE WHEN n30 > 0 THEN var30 ELSE {M['merchant_amount_variance']!r} END AS merchant_amount_variance,
  CAST(rc = 1 AS INTEGER) AS merchant_is_new,
  CASE WHEN n30 > 0 THEN nc30 / n30 ELSE {M['merchant_category_consistency']!r} END AS merchant_category_consistency,
  CASE WHEN n30 > 0 THEN nh30 / n30 ELSE {M['merchant_time_consistency']!r} END AS merchant_time_consistency,
  CASE WHEN n30 > 0 AND mu30 > 0 THEN 1 / (1 + sd30 / mu30) ELSE {M['merchant_amount_consistency']!r} END AS merchant_amount_consistency,
  CASE WHEN n30 > 0 THEN bh30 ELSE {M['merchant_business_hours_alignment']!r} END AS merchant_business_hours_alignment,
  CASE WHEN n30 > 0 THEN wk30 ELSE {M['merchant_weekend_activity']!r} END AS merchant_weekend_activity
FROM a"""


MERCH_ROLL_DBL = [c for c in R.MERCHANT_DEFAULTS if c != "merchant_is_new"]


@register("rolling_merchant_features", rounded(_merchant_roll_sql(), MERCH_ROLL_DBL))
def q_rolling_merchant_features(spark, sf):
    t = txn(spark, sf).select("transaction_id", "merchant_name", "category", "amount", "timestamp")
    return finish(R.merchant_rolling(t).drop("category", "amount", "timestamp"))


# --- H2 ----------------------------------------------------------------------
@register("amount_percentile", rounded(with_(PAY) + """
SELECT transaction_id, amount, (rank() OVER (ORDER BY amount) - 1 + (count(*) OVER (PARTITION BY amount) + 1) / 2.0)
   / count(*) OVER () AS amount_percentile FROM pay""", ["amount", "amount_percentile"]))
def q_amount_percentile(spark, sf):
    """pandas ``rank(pct=True)`` (average ties): (#smaller + (#equal + 1) / 2)
    / n. Distinct amounts are counted first, then ranked with the exact
    distributed prefix sum (no single-partition window)."""
    t = pay(spark, sf).select("transaction_id", "amount")
    from ..operators.ranking import percentile_table
    pct = percentile_table(t)
    return finish(t.join(pct, "amount"))


# --- G5 / E12 ----------------------------------------------------------------
def cap_states(spark, sf):
    """Month spend per (user, category) against the budget: Over above the
    limit, Near from 80 %, else OK; code 0/1/2."""
    t = txn(spark, sf)
    cat = F.coalesce("category", F.lit("other"))
    m = t.groupBy("user_id", cat.alias("category"), F.date_format("timestamp", "yyyy-MM").alias("month")).agg(
        F.sum("amount").alias("spent"))
    b = budgets(spark, sf, m)  # the same users and categories as in t
    j = m.join(b, ["user_id", "category"], "left")
    state = (F.when(F.col("limit").isNull(), "OK").when(F.col("spent") > F.col("limit"), "Over")
              .when(F.col("spent") >= 0.8 * F.col("limit"), "Near").otherwise("OK"))
    from ..functions.text import cap_state_code
    return j.select("user_id", "category", "month", "spent", F.col("limit").alias("budget_limit"),
                    state.alias("caps_state"), cap_state_code(state).alias("caps_state_int"))


@register("cap_state", rounded(with_(TXN, """budgets AS (SELECT uc.user_id, uc.category, greatest(100.0, abs(c.c_acctbal) / 10) AS "limit" FROM
  (SELECT DISTINCT user_id, coalesce(category, 'other') AS category FROM txn) uc JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = uc.user_id)""",
    f"""m AS (SELECT user_id, coalesce(category, 'other') AS category, strftime({_TS}, '%Y-%m') AS month, sum(amount) AS spent FROM txn GROUP BY ALL)""") + """
SELECT m.user_id, m.category, month, spent, b."limit" AS budget_limit,
  CASE WHEN b."limit" IS NULL THEN 'OK' WHEN spent > b."limit" THEN 'Over' WHEN spent >= 0.8 * b."limit" THEN 'Near' ELSE 'OK' END AS caps_state,
  CASE WHEN b."limit" IS NULL THEN 0 WHEN spent > b."limit" THEN 2 WHEN spent >= 0.8 * b."limit" THEN 1 ELSE 0 END AS caps_state_int
FROM m LEFT JOIN budgets b USING (user_id, category)""", ["spent", "budget_limit"]))
def q_cap_state(spark, sf):
    return finish(cap_states(spark, sf))
