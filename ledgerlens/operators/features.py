"""Row-level feature operators (sections B–E): pure Column expressions over
the canonical transactions, one narrow ``select`` each (no shuffle)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import amount as A
from ..functions import text as X
from ..functions import time as T


def merchant_tokens(t: DataFrame) -> DataFrame:
    return t.select("transaction_id", "merchant_name",
                    X.normalize_name("merchant_name").alias("merchant_token"),
                    X.category_hint("merchant_name").alias("merchant_category_hint"))


def vpa_features(t: DataFrame) -> DataFrame:
    h = X.vpa_handle("vpa")
    return t.select("transaction_id", "vpa", h.alias("vpa_handle"),
                    F.length(h).alias("vpa_handle_length"),
                    h.rlike(X.VPA_BANK_PATTERN).cast("int").alias("vpa_is_bank"),
                    h.rlike(X.VPA_WALLET_PATTERN).cast("int").alias("vpa_is_wallet"))


def merchant_name_shape(t: DataFrame) -> DataFrame:
    tok = X.normalize_name("merchant_name")
    raw = F.col("merchant_name")
    return t.select(
        "transaction_id",
        # on the normalised token (advanced set)
        F.length(tok).alias("merchant_name_length"),
        tok.rlike(r"\d").cast("int").alias("merchant_has_numbers"),
        X.word_count(tok).alias("merchant_word_count"),
        tok.rlike(X.LEGAL_SUFFIX_PATTERN).cast("int").alias("merchant_has_ltd"),
        tok.rlike(X.CITY_PATTERN).cast("int").alias("merchant_has_location"),
        # on the raw name (analytic set)
        F.length(raw).alias("raw_name_length"),
        F.coalesce(raw.rlike(r"\d").cast("int"), F.lit(0)).alias("raw_has_number"),
        X.word_count(raw).alias("raw_word_count"),
        X.is_all_upper(raw).alias("raw_is_uppercase"),
    )


def memo_flags(t: DataFrame) -> DataFrame:
    m = F.lower(F.coalesce(F.col("memo"), F.lit("")))
    d = F.lower(F.col("direction"))
    return t.select(
        "transaction_id",
        (X.whole_word(m, "loan") | X.whole_word(m, "lend") | X.whole_word(m, "borrow")).cast("int").alias("memo_has_loan"),
        (X.whole_word(m, "repay") | X.whole_word(m, "return")).cast("int").alias("memo_has_repay"),
        X.whole_word(m, "gift").cast("int").alias("memo_has_gift"),
        X.whole_word(m, "tip").cast("int").alias("memo_has_tip"),
        F.coalesce((d == "send").cast("int"), F.lit(0)).alias("direction_send"),
        F.coalesce((d == "receive").cast("int"), F.lit(0)).alias("direction_receive"),
    )


def memo_topics(t: DataFrame) -> DataFrame:
    m = F.lower(F.coalesce(F.col("memo"), F.lit("")))
    return t.select("transaction_id",
                    *[m.rlike(p).cast("int").alias(n) for n, p in X.MEMO_TOPIC_PATTERNS],
                    F.length(m).alias("memo_length"))


def temporal_features(t: DataFrame) -> DataFrame:
    ts = F.col("timestamp")
    h, dow, dom, mon = F.hour(ts), F.weekday(ts), F.dayofmonth(ts), F.month(ts)
    return t.select(
        "transaction_id",
        h.alias("hour"), dow.alias("day_of_week"), dom.alias("day_of_month"), mon.alias("month"),
        F.quarter(ts).alias("quarter"), F.weekofyear(ts).alias("week_of_year"),
        (dow >= 5).cast("int").alias("is_weekend"),
        (dom > 25).cast("int").alias("is_month_end"),
        (dom <= 5).cast("int").alias("is_month_start"),
        T.cyc_sin(h, 24).alias("hour_sin"), T.cyc_cos(h, 24).alias("hour_cos"),
        T.cyc_sin(dow, 7).alias("day_of_week_sin"), T.cyc_cos(dow, 7).alias("day_of_week_cos"),
        T.cyc_sin(mon, 12).alias("month_sin"), T.cyc_cos(mon, 12).alias("month_cos"),
        # analytic variants
        ((h >= 9) & (h <= 17)).cast("int").alias("is_business_hours"),
        ((h >= 22) | (h <= 6)).cast("int").alias("is_night"),
        (dom >= 28).cast("int").alias("is_month_end_28"),
        T.hour_bin(h).alias("hour_bin"),
        # financial calendar
        dom.alias("days_since_month_start"),
        ((dom <= 7) | (dom >= 25)).cast("int").alias("is_salary_week"),
        ((h >= 22) | (h <= 5)).cast("int").alias("high_risk_time"),
    )


def amount_features(t: DataFrame) -> DataFrame:
    a = F.col("amount")
    return t.select(
        "transaction_id", "amount",
        A.log_amount(a).alias("log_amount"),
        A.is_multiple(a, 10).alias("amount_rounded_to_10"),
        A.is_multiple(a, 50).alias("amount_rounded_to_50"),
        A.is_multiple(a, 100).alias("amount_rounded_to_100"),
        A.is_multiple(a, 500).alias("amount_rounded_to_500"),
        ((a % 50 == 0) | (a % 100 == 0)).cast("int").alias("is_round_amount_parity"),
        (a < 50).cast("int").alias("is_micro_transaction"),
        (a > 5000).cast("int").alias("is_large_transaction"),
        (a < 100).cast("int").alias("is_small_amount"),
        A.right_closed_bin(a, A.ADVANCED_AMOUNT_EDGES).alias("amount_bin"),
        A.right_closed_bin(a, A.ANALYTIC_AMOUNT_EDGES).alias("amount_bin_analytic"),
        A.decimal_places(a).alias("amount_decimal_places"),
    )


def amount_zscore(t: DataFrame) -> DataFrame:
    """Global z-score with sample std. Mean and std are scalar subqueries
    (one tiny aggregate job), not a window over the whole table."""
    stats = t.agg(F.avg("amount").alias("mu"), F.stddev_samp("amount").alias("sd"))
    mu = stats.select("mu").scalar()
    sd = stats.select("sd").scalar()
    return t.select("transaction_id", "amount", ((F.col("amount") - mu) / sd).alias("amount_zscore"))


def label_signatures(t: DataFrame) -> DataFrame:
    return t.select("transaction_id", "merchant_name", "vpa",
                    X.label_signature("merchant_name", X.vpa_handle("vpa")).alias("signature"))
