"""Row-level column features: C (strings), D (calendar), E (amounts)."""
from __future__ import annotations

from ..functions import amount as AM
from ..functions import text as X
from ..operators import features as FE
from ..sources.adapters import pay, txn
from . import sqlx as S
from .common import finish, rounded
from .oracle_base import PAY, TXN, with_
from .registry import register


def _src(name):
    return {"txn": (txn, TXN), "pay": (pay, PAY)}[name]


# --- C1 / C7 -----------------------------------------------------------------
@register("normalize_merchant", with_(TXN) + f"""
SELECT transaction_id, merchant_name, {S.norm('merchant_name')} AS merchant_token,
       {S.category_hint('merchant_name')} AS merchant_category_hint FROM txn""")
def q_normalize_merchant(spark, sf):
    return finish(FE.merchant_tokens(txn(spark, sf)))


@register("category_hint", with_(PAY) + f"""
SELECT transaction_id, merchant_name, {S.norm('merchant_name')} AS merchant_token,
       {S.category_hint('memo')} AS merchant_category_hint FROM pay""")
def q_category_hint(spark, sf):
    # part names carry the words ("small ring", …): hint computed on memo
    from pyspark.sql import functions as F
    t = pay(spark, sf)
    return finish(t.select("transaction_id", "merchant_name",
                           X.normalize_name("merchant_name").alias("merchant_token"),
                           X.category_hint("memo").alias("merchant_category_hint")))


# --- C2 / C3 -----------------------------------------------------------------
@register("vpa_features", with_(TXN) + f"""
SELECT transaction_id, vpa, {S.handle('vpa')} AS vpa_handle, length({S.handle('vpa')}) AS vpa_handle_length,
  CAST({S.rlike(S.handle('vpa'), X.VPA_BANK_PATTERN)} AS INTEGER) AS vpa_is_bank,
  CAST({S.rlike(S.handle('vpa'), X.VPA_WALLET_PATTERN)} AS INTEGER) AS vpa_is_wallet FROM txn""")
def q_vpa_features(spark, sf):
    return finish(FE.vpa_features(txn(spark, sf)))


# --- C4 ----------------------------------------------------------------------
_tok = S.norm("merchant_name")


@register("merchant_name_shape", with_(TXN) + f"""
SELECT transaction_id, length({_tok}) AS merchant_name_length,
  CAST(regexp_matches({_tok}, '\\d') AS INTEGER) AS merchant_has_numbers,
  {S.word_count(_tok)} AS merchant_word_count,
  CAST({S.rlike(_tok, X.LEGAL_SUFFIX_PATTERN)} AS INTEGER) AS merchant_has_ltd,
  CAST({S.rlike(_tok, X.CITY_PATTERN)} AS INTEGER) AS merchant_has_location,
  length(merchant_name) AS raw_name_length,
  coalesce(CAST(regexp_matches(merchant_name, '\\d') AS INTEGER), 0) AS raw_has_number,
  {S.word_count('merchant_name')} AS raw_word_count,
  CAST(upper(merchant_name) = merchant_name AND lower(merchant_name) <> merchant_name AS INTEGER) AS raw_is_uppercase
FROM txn""")
def q_merchant_name_shape(spark, sf):
    return finish(FE.merchant_name_shape(txn(spark, sf)))


# --- C5 / C6 -----------------------------------------------------------------
_m = "lower(coalesce(memo, ''))"


@register("memo_flags", with_(PAY) + f"""
SELECT transaction_id,
  CAST({S.whole_word(_m, 'loan')} OR {S.whole_word(_m, 'lend')} OR {S.whole_word(_m, 'borrow')} AS INTEGER) AS memo_has_loan,
  CAST({S.whole_word(_m, 'repay')} OR {S.whole_word(_m, 'return')} AS INTEGER) AS memo_has_repay,
  CAST({S.whole_word(_m, 'gift')} AS INTEGER) AS memo_has_gift,
  CAST({S.whole_word(_m, 'tip')} AS INTEGER) AS memo_has_tip,
  coalesce(CAST(lower(direction) = 'send' AS INTEGER), 0) AS direction_send,
  coalesce(CAST(lower(direction) = 'receive' AS INTEGER), 0) AS direction_receive
FROM pay""")
def q_memo_flags(spark, sf):
    return finish(FE.memo_flags(pay(spark, sf)))


@register("memo_topics", with_(PAY) + "SELECT transaction_id, " + ", ".join(
    f"CAST({S.rlike(_m, p)} AS INTEGER) AS {n}" for n, p in X.MEMO_TOPIC_PATTERNS) + f", length({_m}) AS memo_length FROM pay")
def q_memo_topics(spark, sf):
    return finish(FE.memo_topics(pay(spark, sf)))


# --- D -----------------------------------------------------------------------
_ts = '"timestamp"'
_h, _dow, _dom, _mon = f"hour({_ts})", f"(isodow({_ts}) - 1)", f"day({_ts})", f"month({_ts})"
TEMPORAL_DOUBLES = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos"]


@register("temporal_features", rounded(with_(TXN) + f"""
SELECT transaction_id, {_h} AS hour, {_dow} AS day_of_week, {_dom} AS day_of_month, {_mon} AS month,
  quarter({_ts}) AS quarter, weekofyear({_ts}) AS week_of_year,
  CAST({_dow} >= 5 AS INTEGER) AS is_weekend, CAST({_dom} > 25 AS INTEGER) AS is_month_end,
  CAST({_dom} <= 5 AS INTEGER) AS is_month_start,
  {S.cyc('sin', _h, 24)} AS hour_sin, {S.cyc('cos', _h, 24)} AS hour_cos,
  {S.cyc('sin', _dow, 7)} AS day_of_week_sin, {S.cyc('cos', _dow, 7)} AS day_of_week_cos,
  {S.cyc('sin', _mon, 12)} AS month_sin, {S.cyc('cos', _mon, 12)} AS month_cos,
  CAST({_h} >= 9 AND {_h} <= 17 AS INTEGER) AS is_business_hours,
  CAST({_h} >= 22 OR {_h} <= 6 AS INTEGER) AS is_night,
  CAST({_dom} >= 28 AS INTEGER) AS is_month_end_28,
  {S.rc_bin(_h, [0, 6, 12, 18, 24])} AS hour_bin,
  {_dom} AS days_since_month_start,
  CAST({_dom} <= 7 OR {_dom} >= 25 AS INTEGER) AS is_salary_week,
  CAST({_h} >= 22 OR {_h} <= 5 AS INTEGER) AS high_risk_time
FROM txn""", TEMPORAL_DOUBLES))
def q_temporal_features(spark, sf):
    return finish(FE.temporal_features(txn(spark, sf)))


# --- E -----------------------------------------------------------------------
def _amount_sql(src_cte, src):
    a = "amount"
    return rounded(with_(src_cte) + f"""
SELECT transaction_id, amount, ln(1 + greatest(amount, 0.0)) AS log_amount,
  CAST(amount % 10 = 0 AS INTEGER) AS amount_rounded_to_10,
  CAST(amount % 50 = 0 AS INTEGER) AS amount_rounded_to_50,
  CAST(amount % 100 = 0 AS INTEGER) AS amount_rounded_to_100,
  CAST(amount % 500 = 0 AS INTEGER) AS amount_rounded_to_500,
  CAST(amount % 50 = 0 OR amount % 100 = 0 AS INTEGER) AS is_round_amount_parity,
  CAST(amount < 50 AS INTEGER) AS is_micro_transaction,
  CAST(amount > 5000 AS INTEGER) AS is_large_transaction,
  CAST(amount < 100 AS INTEGER) AS is_small_amount,
  {S.rc_bin(a, AM.ADVANCED_AMOUNT_EDGES)} AS amount_bin,
  {S.rc_bin(a, AM.ANALYTIC_AMOUNT_EDGES)} AS amount_bin_analytic,
  {S.dec_places(a)} AS amount_decimal_places
FROM {src}""", ["amount", "log_amount"])


@register("amount_features", _amount_sql(PAY, "pay"))
def q_amount_features(spark, sf):
    return finish(FE.amount_features(pay(spark, sf)))


@register("amount_zscore", rounded(with_(PAY) + """
SELECT transaction_id, amount,
  (amount - (SELECT avg(amount) FROM pay)) / (SELECT stddev_samp(amount) FROM pay) AS amount_zscore
FROM pay""", ["amount", "amount_zscore"]))
def q_amount_zscore(spark, sf):
    return finish(FE.amount_zscore(pay(spark, sf)))


# --- C15 ---------------------------------------------------------------------
@register("label_signature", with_(TXN) + f"""
SELECT transaction_id, merchant_name, vpa, {S.signature('merchant_name', S.handle('vpa'))} AS signature FROM txn""")
def q_label_signature(spark, sf):
    return finish(FE.label_signatures(txn(spark, sf)))
