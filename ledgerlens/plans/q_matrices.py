"""Model-input matrices and ingest/validation (A2–A4, B1, B2, B5–B7/B9, J1,
K2, K14)."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import matrices as MX
from ..operators import tagging as TG
from ..operators.ranking import percentile_table
from ..sources.adapters import catalog, pay, txn
from ..sources.tables import table
from . import sqlx as S
from .common import finish, rounded
from .oracle_base import CATALOG, PAY, TXN, with_
from .q_features import _user_roll_sql, cap_states
from .q_tagging import CDIM, LABELS, VOTES, _CID
from .registry import register

_TS = '"timestamp"'
_US = f"epoch_us({_TS})"
_LA = "ln(1 + greatest(amount, 0.0))"
_TWO_PI = repr(2 * math.pi)
CAPS = """caps AS (SELECT m.user_id, m.category, m.month,
   CASE WHEN b."limit" IS NULL THEN 0 WHEN spent > b."limit" THEN 2 WHEN spent >= 0.8 * b."limit" THEN 1 ELSE 0 END AS caps_state_int
  FROM (SELECT user_id, coalesce(category, 'other') AS category, strftime("timestamp", '%Y-%m') AS month, sum(amount) AS spent FROM txn GROUP BY ALL) m
  LEFT JOIN (SELECT uc.user_id, uc.category, greatest(100.0, abs(c.c_acctbal) / 10) AS "limit" FROM
    (SELECT DISTINCT user_id, coalesce(category, 'other') AS category FROM txn) uc JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = uc.user_id) b
  USING (user_id, category))"""
_ML = "lower(coalesce(memo, ''))"
_PARITY_EXPR = {
    "log_amount": f"({_LA} - st.mu) / CASE WHEN st.sd > 0 THEN st.sd ELSE 1.0 END",
    "hour_sin": f"sin({_TWO_PI} * coalesce(hour({_TS}), 0) / 24.0)", "hour_cos": f"cos({_TWO_PI} * coalesce(hour({_TS}), 0) / 24.0)",
    "day_of_week_sin": f"sin({_TWO_PI} * coalesce(isodow({_TS}) - 1, 0) / 7.0)",
    "day_of_week_cos": f"cos({_TWO_PI} * coalesce(isodow({_TS}) - 1, 0) / 7.0)",
    "vpa_handle_id": "coalesce(vv.code, (SELECT code FROM vv WHERE value = '<UNK>'))",
    "merchant_id": "coalesce(vm.code, (SELECT code FROM vm WHERE value = '<UNK>'))",
    "caps_state_int": "coalesce(caps.caps_state_int, 0)",
    "is_round_amount": "CAST(amount % 50 = 0 OR amount % 100 = 0 AS INTEGER)",
    "user_food_ratio_30d": "ru.user_food_ratio_30d", "user_transport_ratio_30d": "ru.user_transport_ratio_30d",
    "user_shopping_ratio_30d": "ru.user_shopping_ratio_30d", "user_avg_transaction_amount": "ru.user_avg_transaction_amount_30d",
    "user_transaction_frequency_score": repr(MX.USER_FREQUENCY_SCORE),
    "payee_seen_before": "seen", "merchant_known": "known", "catalog_category_id": "ccid", "catalog_confidence": "cconf",
    "novelty_score": "CAST(cconf <= 0 AND seen <= 0 AS DOUBLE)",
    **{c: f"CAST(ccid = {float(i)!r} AS DOUBLE)" for i, c in enumerate(TG.ONEHOT, start=1)},
    "memo_has_loan": f"CAST({S.whole_word(_ML, 'loan')} OR {S.whole_word(_ML, 'lend')} OR {S.whole_word(_ML, 'borrow')} AS INTEGER)",
    "memo_has_repay": f"CAST({S.whole_word(_ML, 'repay')} OR {S.whole_word(_ML, 'return')} AS INTEGER)",
    "memo_has_gift": f"CAST({S.whole_word(_ML, 'gift')} AS INTEGER)", "memo_has_tip": f"CAST({S.whole_word(_ML, 'tip')} AS INTEGER)",
    "direction_send": "coalesce(CAST(lower(direction) = 'send' AS INTEGER), 0)",
    "direction_receive": "coalesce(CAST(lower(direction) = 'receive' AS INTEGER), 0)",
}
_PSEL = ", ".join(
    f"coalesce(CAST({_PARITY_EXPR[c]} AS {'BIGINT' if c in MX.PARITY_CATEGORICAL else 'DOUBLE'}), 0) AS {c}"
    for c in MX.PARITY_COLUMNS)
PARITY_SQL = rounded(with_(TXN, VOTES, LABELS, CATALOG, CDIM, CAPS, f"ru AS ({_user_roll_sql()})",
    f"""base AS (SELECT t.*, {S.norm('merchant_name')} AS tok, {S.handle('vpa')} AS hnd,
   row_number() OVER (PARTITION BY user_id, merchant_name ORDER BY {_TS}, transaction_id) AS fam,
   strftime({_TS}, '%Y-%m') AS month, coalesce(category, 'other') AS cat FROM txn t)""",
    f"""pr AS (SELECT base.*, {_CID('cdim.canonical_category')} AS cid FROM base LEFT JOIN cdim ON cdim.normalized_name = base.tok)""",
    f"""pl AS (SELECT pr.*, l.category_name AS lc, l.confidence AS lconf FROM pr LEFT JOIN (SELECT * FROM lbl WHERE confidence >= 0.8) l
   ON l.signature = {S.signature('tok', 'hnd')})""",
    f"""px AS (SELECT pl.*, CASE WHEN lc IS NOT NULL THEN coalesce(CASE lc {' '.join(f'WHEN {S.q(k)} THEN {v!r}' for k, v in X.CANONICAL_IDS.items())} END, cid) ELSE cid END AS ccid,
   CASE WHEN lc IS NOT NULL THEN greatest(0.95, lconf) WHEN cid > 0 THEN 0.95 ELSE 0.0 END AS cconf,
   CASE WHEN lc IS NOT NULL OR cid > 0 THEN 1 ELSE 0 END AS known,
   CASE WHEN fam > 1 OR lc IS NOT NULL OR cid > 0 THEN 1 ELSE 0 END AS seen FROM pl)""",
    """vv AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT hnd AS value FROM base UNION SELECT '<UNK>'))""",
    """vm AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT tok AS value FROM base UNION SELECT '<UNK>'))""",
    f"""st AS (SELECT avg({_LA}) AS mu, stddev_pop({_LA}) AS sd FROM txn)""") + f"""
SELECT px.transaction_id, {_PSEL}
FROM px JOIN ru USING (transaction_id) LEFT JOIN caps ON caps.user_id = px.user_id AND caps.category = px.cat AND caps.month = px.month
  LEFT JOIN vv ON vv.value = px.hnd LEFT JOIN vm ON vm.value = px.tok CROSS JOIN st""",
    [c for c in MX.PARITY_COLUMNS if c not in MX.PARITY_CATEGORICAL])


def _parity(spark, sf, fit_ids=None):
    t = txn(spark, sf)
    labels = TG.community_labels(TG.community_votes(t))
    return MX.parity(t, TG.catalog_dim(catalog(spark, sf)), labels, cap_states(spark, sf), fit_ids)


@register("parity_features", PARITY_SQL)
def q_parity_features(spark, sf):
    return finish(_parity(spark, sf))


# --- B9 / B7 -----------------------------------------------------------------
ANALYTIC_COLS = [
    "amount", "rating", "amount_log", "amount_bin", "amount_zscore", "is_round_amount", "amount_decimal_places",
    "is_small_amount", "hour", "day_of_week", "is_weekend", "is_business_hours", "is_night", "day_of_month",
    "is_month_end", "hour_bin", "merchant_name_length", "merchant_has_number", "merchant_word_count",
    "merchant_is_uppercase", "merchant_transaction_count", "merchant_avg_amount", "merchant_amount_std",
    "merchant_unique_users", "is_frequent_merchant", "merchant_amount_consistency", "merchant_popularity",
    "user_transaction_count", "user_avg_amount", "user_amount_std", "user_total_spent", "user_merchant_diversity",
    "user_preferred_hour", "user_spending_velocity", "amount_vs_user_avg", "is_unusual_amount",
    "user_consistency_score", "user_merchant_familiarity", "transactions_last_hour", "transactions_last_day",
    "transactions_last_week", "amount_percentile",
]
_ADBL = ["amount", "rating", "amount_log", "amount_zscore", "merchant_avg_amount", "merchant_amount_std",
         "merchant_amount_consistency", "merchant_popularity", "user_avg_amount", "user_amount_std", "user_total_spent",
         "user_spending_velocity", "amount_vs_user_avg", "user_consistency_score", "amount_percentile"]


def _vel(hours):
    return f"count(*) OVER (PARTITION BY user_id ORDER BY {_US} RANGE BETWEEN {hours * 3600 * 1_000_000 - 1} PRECEDING AND CURRENT ROW)"


ANALYTIC_SQL = rounded(with_(TXN,
    """ms0 AS (SELECT merchant_name, count(amount) AS merchant_transaction_count, avg(amount) AS merchant_avg_amount,
   coalesce(stddev_samp(amount), 0) AS merchant_amount_std, count(DISTINCT user_id) AS merchant_unique_users
  FROM txn WHERE merchant_name IS NOT NULL GROUP BY merchant_name)""",
    """ms AS (SELECT *, CAST(merchant_transaction_count >= 5 AS INTEGER) AS is_frequent_merchant,
   1 / (1 + merchant_amount_std) AS merchant_amount_consistency,
   merchant_unique_users / (SELECT max(merchant_unique_users) FROM ms0) AS merchant_popularity FROM ms0)""",
    f"""hc AS (SELECT user_id, hour({_TS}) AS hr, count(*) AS c FROM txn WHERE hour({_TS}) IS NOT NULL GROUP BY ALL)""",
    """md AS (SELECT user_id, hr FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, hr) AS rn FROM hc) WHERE rn = 1)""",
    """us AS (SELECT user_id, count(amount) AS user_transaction_count, avg(amount) AS user_avg_amount,
   coalesce(stddev_samp(amount), 0) AS user_amount_std, sum(amount) AS user_total_spent,
   count(DISTINCT merchant_name) AS user_merchant_diversity FROM txn GROUP BY user_id)""",
    """pc AS (SELECT amount, (coalesce(sum(eq) OVER (ORDER BY amount ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (eq + 1) / 2.0)
     / (SELECT count(*) FROM txn) AS amount_percentile FROM (SELECT amount, count(*) AS eq FROM txn GROUP BY amount))""",
    """gs AS (SELECT avg(amount) AS mu, stddev_samp(amount) AS sd FROM txn)""") + f"""
SELECT t.transaction_id, t.amount, t.rating, ln(1 + t.amount) AS amount_log, {S.rc_bin('t.amount', [0, 100, 500, 1000, 5000, 50000, float('inf')])} AS amount_bin,
  (t.amount - gs.mu) / gs.sd AS amount_zscore, CAST(t.amount % 100 = 0 AS INTEGER) AS is_round_amount,
  {S.dec_places('t.amount')} AS amount_decimal_places, CAST(t.amount < 100 AS INTEGER) AS is_small_amount,
  hour({_TS}) AS hour, isodow({_TS}) - 1 AS day_of_week, CAST(isodow({_TS}) - 1 >= 5 AS INTEGER) AS is_weekend,
  CAST(hour({_TS}) BETWEEN 9 AND 17 AS INTEGER) AS is_business_hours, CAST(hour({_TS}) >= 22 OR hour({_TS}) <= 6 AS INTEGER) AS is_night,
  day({_TS}) AS day_of_month, CAST(day({_TS}) >= 28 AS INTEGER) AS is_month_end, {S.rc_bin(f'hour({_TS})', [0, 6, 12, 18, 24])} AS hour_bin,
  length(t.merchant_name) AS merchant_name_length, coalesce(CAST(regexp_matches(t.merchant_name, '\\d') AS INTEGER), 0) AS merchant_has_number,
  {S.word_count('t.merchant_name')} AS merchant_word_count,
  CAST(upper(t.merchant_name) = t.merchant_name AND lower(t.merchant_name) <> t.merchant_name AS INTEGER) AS merchant_is_uppercase,
  ms.merchant_transaction_count, ms.merchant_avg_amount, ms.merchant_amount_std, ms.merchant_unique_users, ms.is_frequent_merchant,
  ms.merchant_amount_consistency, ms.merchant_popularity,
  us.user_transaction_count, us.user_avg_amount, us.user_amount_std, us.user_total_spent, us.user_merchant_diversity,
  coalesce(md.hr, 12) AS user_preferred_hour, us.user_total_spent / (us.user_transaction_count + 1) AS user_spending_velocity,
  t.amount / (us.user_avg_amount + 1) AS amount_vs_user_avg,
  CAST(abs(t.amount - us.user_avg_amount) > 2 * us.user_amount_std AS INTEGER) AS is_unusual_amount,
  1 / (1 + us.user_amount_std) AS user_consistency_score,
  row_number() OVER (PARTITION BY t.user_id, t.merchant_name ORDER BY {_TS}, t.transaction_id) AS user_merchant_familiarity,
  {_vel(1)} AS transactions_last_hour, {_vel(24)} AS transactions_last_day, {_vel(168)} AS transactions_last_week,
  pc.amount_percentile
FROM txn t LEFT JOIN ms USING (merchant_name) LEFT JOIN us USING (user_id) LEFT JOIN md USING (user_id)
  LEFT JOIN pc USING (amount) CROSS JOIN gs""", _ADBL)


def _analytic(spark, sf):
    t = txn(spark, sf)
    return MX.analytic(t, percentile_table(t))


@register("analytic_features", ANALYTIC_SQL)
def q_analytic_features(spark, sf):
    a = MX.numeric_only(_analytic(spark, sf))
    return finish(a.select("transaction_id", *ANALYTIC_COLS))


# --- K14 ---------------------------------------------------------------------
_STD = ["amount", "amount_log", "hour", "merchant_avg_amount", "user_avg_amount", "amount_vs_user_avg",
        "user_merchant_familiarity", "transactions_last_day", "amount_percentile"]


@register("standardized_features", rounded(f"WITH a AS ({ANALYTIC_SQL}) SELECT transaction_id, " + ", ".join(
    f"(CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM a)) / CASE WHEN (SELECT stddev_pop({c}) FROM a) > 0 THEN (SELECT stddev_pop({c}) FROM a) ELSE 1.0 END AS {c}"
    for c in _STD) + " FROM a", _STD))
def q_standardized_features(spark, sf):
    """K14 over a slice of the analytic matrix (population std, 0 -> 1)."""
    a = finish(MX.numeric_only(_analytic(spark, sf)))
    return finish(MX.standardize(a.select("transaction_id", *[F.col(c).cast("double").alias(c) for c in _STD]), _STD))


# --- B6 ----------------------------------------------------------------------
from ..operators import rolling as R  # noqa: E402
from .q_features import _merchant_roll_sql  # noqa: E402

_CANON_SQL = "CASE lower(\"Category\") " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in X.CATALOG_CANONICAL.items()) + " END"
ADV_CAT = f"""adv AS (SELECT c.tok AS merchant_token, {_CID('c.cc')} AS adv_catalog_id FROM
  (SELECT {S.norm('"Merchant Name"')} AS tok, ord, {_CANON_SQL} AS cc FROM catalog) c
  JOIN (SELECT {S.norm('"Merchant Name"')} AS tok, max(ord) AS ord FROM catalog GROUP BY 1) l USING (tok, ord))"""
_h, _dow, _dom, _mon = f"hour({_TS})", f"(isodow({_TS}) - 1)", f"day({_TS})", f"month({_TS})"
_tk = "b.tok"
_u30 = "ru.user_avg_transaction_amount_30d"
_dev = f"abs(amount - {_u30}) / {_u30}"
_trust = S.merchant_trust("b.merchant_name")
_corp = f"CAST({S.rlike(_tk, X.LEGAL_SUFFIX_PATTERN)} AS INTEGER)"
_cid = "coalesce(adv.adv_catalog_id, 0.0)"
_ADV = {
    "hour": _h, "day_of_week": _dow, "day_of_month": _dom, "month": _mon, "quarter": f"quarter({_TS})",
    "week_of_year": f"weekofyear({_TS})", "is_weekend": f"CAST({_dow} >= 5 AS INTEGER)", "is_month_end": f"CAST({_dom} > 25 AS INTEGER)",
    "is_month_start": f"CAST({_dom} <= 5 AS INTEGER)", "hour_sin": S.cyc("sin", _h, 24), "hour_cos": S.cyc("cos", _h, 24),
    "day_of_week_sin": S.cyc("sin", _dow, 7), "day_of_week_cos": S.cyc("cos", _dow, 7),
    "month_sin": S.cyc("sin", _mon, 12), "month_cos": S.cyc("cos", _mon, 12),
    **{k: f"ru.{k}" for k in R.USER_DEFAULTS},
    "merchant_name_length": f"length({_tk})", "merchant_has_numbers": f"CAST(regexp_matches({_tk}, '\\d') AS INTEGER)",
    "merchant_word_count": S.word_count(_tk), "merchant_has_ltd": _corp,
    "merchant_has_location": f"CAST({S.rlike(_tk, X.CITY_PATTERN)} AS INTEGER)",
    "vpa_handle_length": "length(b.hnd)", "vpa_is_bank": f"CAST({S.rlike('b.hnd', X.VPA_BANK_PATTERN)} AS INTEGER)",
    "vpa_is_wallet": f"CAST({S.rlike('b.hnd', X.VPA_WALLET_PATTERN)} AS INTEGER)",
    **{k: f"mr.{k}" for k in R.MERCHANT_DEFAULTS},
    "merchant_trust_score": _trust, "payee_seen_before": "CAST(b.fam > 1 AS INTEGER)",
    "merchant_known": f"CAST({_cid} > 0 AS INTEGER)", "is_corporate_merchant": _corp, "is_individual_merchant": f"1 - {_corp}",
    "merchant_token": _tk, "log_amount": _LA,
    "amount_rounded_to_10": "CAST(amount % 10 = 0 AS INTEGER)", "amount_rounded_to_50": "CAST(amount % 50 = 0 AS INTEGER)",
    "amount_rounded_to_100": "CAST(amount % 100 = 0 AS INTEGER)", "amount_rounded_to_500": "CAST(amount % 500 = 0 AS INTEGER)",
    "is_micro_transaction": "CAST(amount < 50 AS INTEGER)", "is_large_transaction": "CAST(amount > 5000 AS INTEGER)",
    "amount_bin": S.rc_bin("amount", [0, 50, 100, 500, 1000, 5000, 10000, float("inf")]),
    "amount_deviation_from_user_avg": _dev,
    **{n: f"CAST({S.rlike(_ML, p)} AS INTEGER)" for n, p in X.MEMO_TOPIC_PATTERNS}, "memo_length": f"length({_ML})",
    "vpa_handle": "b.hnd", "caps_state_int": "coalesce(caps.caps_state_int, 0)",
    "daily_spending_rate": "ru.user_avg_transaction_amount_7d / 7", "monthly_spending_rate": f"{_u30} / 30",
    "days_since_month_start": _dom, "is_salary_week": f"CAST({_dom} <= 7 OR {_dom} >= 25 AS INTEGER)",
    "spending_consistency_score": "0.5", "budget_adherence_score": "0.7",
    "emergency_spending_indicator": f"CAST(amount > {_u30} * 2 AND {_dow} < 5 AS INTEGER)",
    "high_risk_time": f"CAST({_h} >= 22 OR {_h} <= 5 AS INTEGER)", "unusual_amount_flag": f"CAST({_dev} > 2 AS INTEGER)",
    "catalog_category_id": _cid, "catalog_confidence": f"CAST({_cid} > 0 AS DOUBLE) * 0.95",
    **{n: f"CAST({_cid} = {float(i)!r} AS INTEGER)" for i, n in enumerate(MX.ADV_ONEHOT, start=1)},
    "amount_x_hour": f"amount * {_h}", "amount_x_weekend": f"amount * CAST({_dow} >= 5 AS INTEGER)",
    "amount_x_month_end": f"amount * CAST({_dom} > 25 AS INTEGER)",
    "merchant_freq_x_user_freq": "mr.merchant_frequency_30d * ru.user_transaction_frequency_30d",
    "merchant_trust_x_amount": f"{_trust} * {_LA}",
    "time_merchant_consistency": "mr.merchant_time_consistency * mr.merchant_business_hours_alignment",
}
ADV_DOUBLES = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
               *R.USER_DEFAULTS, *[k for k in R.MERCHANT_DEFAULTS if k != "merchant_is_new"], "merchant_trust_score",
               "log_amount", "amount_deviation_from_user_avg", "daily_spending_rate", "monthly_spending_rate",
               "spending_consistency_score", "budget_adherence_score", "catalog_category_id", "catalog_confidence",
               "amount_x_hour", "amount_x_weekend", "amount_x_month_end", "merchant_freq_x_user_freq",
               "merchant_trust_x_amount", "time_merchant_consistency"]
ADVANCED_SQL = rounded(with_(TXN, CATALOG, ADV_CAT, CAPS,
    f"ru AS (SELECT * EXCLUDE (user_id) FROM ({_user_roll_sql()}))",
    f"mr AS (SELECT * EXCLUDE (merchant_name) FROM ({_merchant_roll_sql()}))",
    f"""b AS (SELECT t.*, {S.norm('merchant_name')} AS tok, {S.handle('vpa')} AS hnd,
   row_number() OVER (PARTITION BY user_id, merchant_name ORDER BY {_TS}, transaction_id) AS fam,
   strftime({_TS}, '%Y-%m') AS month, coalesce(category, 'other') AS cat FROM txn t)""") + "SELECT b.transaction_id, "
    + ", ".join(f"{v} AS {k}" for k, v in _ADV.items()) + """
FROM b JOIN ru USING (transaction_id) JOIN mr USING (transaction_id) LEFT JOIN adv ON adv.merchant_token = b.tok
  LEFT JOIN caps ON caps.user_id = b.user_id AND caps.category = b.cat AND caps.month = b.month""", ADV_DOUBLES)


@register("advanced_features", ADVANCED_SQL)
def q_advanced_features(spark, sf):
    t = txn(spark, sf)
    return finish(MX.advanced(t, catalog(spark, sf), cap_states(spark, sf)))
