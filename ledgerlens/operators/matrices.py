"""Model-input matrices (B1, B2, B5, B6, B7/B9, K14): each is one chain of
row-preserving operators (windows add columns, dimension joins add
columns), then one ``select`` in spec order. Global statistics (mean, std,
max) are scalar subqueries, never windows over the whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import amount as AM
from ..functions import text as X
from ..functions import time as T
from ..session import cut_lineage
from . import aggregates as A
from . import rolling as R
from . import tagging as TG
from .windows import rolling_stats, with_running_count

# fixed values: the 31-column parity spec, in order
PARITY_COLUMNS = [
    "log_amount", "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "vpa_handle_id", "merchant_id",
    "caps_state_int", "is_round_amount", "user_food_ratio_30d", "user_transport_ratio_30d", "user_shopping_ratio_30d",
    "user_avg_transaction_amount", "user_transaction_frequency_score", "payee_seen_before", "merchant_known",
    "catalog_category_id", "catalog_confidence", "novelty_score", "catalog_is_food", "catalog_is_shopping",
    "catalog_is_transport", "catalog_is_healthcare", "catalog_is_personal", "catalog_is_bills", "memo_has_loan",
    "memo_has_repay", "memo_has_gift", "memo_has_tip", "direction_send", "direction_receive",
]
PARITY_CATEGORICAL = ["vpa_handle_id", "merchant_id", "caps_state_int"]
USER_FREQUENCY_SCORE = 0.5  # reference default; no source defines it


PARITY_USER = ["user_food_ratio_30d", "user_transport_ratio_30d", "user_shopping_ratio_30d", "user_avg_transaction_amount_30d"]


def _familiarity(t: DataFrame) -> DataFrame:
    """``_fam``: the row's number among the user's payments to the merchant."""
    seen = with_running_count(t.select("transaction_id", "user_id", "merchant_name", "timestamp"), ["user_id", "merchant_name"],
                              "timestamp", "transaction_id", out="_fam")
    return seen.select("transaction_id", "_fam")


def parity(t: DataFrame, cdim: DataFrame, labels: DataFrame, caps: DataFrame, fit_ids: DataFrame | None = None) -> DataFrame:
    """The 31 parity columns; encoders (vocabularies, amount scaler) are
    fitted on the rows of ``fit_ids`` (transaction_id), by default on all of
    ``t``; values that they do not know get the code of ``<UNK>``."""
    la = AM.log_amount("amount")
    fit = t.select("transaction_id", X.vpa_handle("vpa").alias("vpa_handle"), X.normalize_name("merchant_name").alias("merchant_token"),
                   la.alias("_la"))
    if fit_ids is not None:
        # three encoders read the training rows: joined once
        fit = cut_lineage(fit.join(fit_ids, "transaction_id", "left_semi").drop("transaction_id"))
    d = TG.priors(t, cdim, labels)
    d = d.withColumn("_month", F.date_format("timestamp", "yyyy-MM")).withColumn("_cat", F.coalesce("category", F.lit("other")))
    d = d.join(caps.select(F.col("user_id"), F.col("category").alias("_cat"), F.col("month").alias("_month"),
                           F.col("caps_state_int").alias("_caps")), ["user_id", "_cat", "_month"], "left")
    # vocabularies come straight from the input, not from the widened rows
    vv = TG.vocabulary(fit, "vpa_handle")
    vm = TG.vocabulary(fit, "merchant_token")
    d = TG.encode(d, "vpa_handle", vv, "vpa_handle_id")
    d = TG.encode(d, "merchant_token", vm, "merchant_id")
    # every statistic comes from the narrow input and joins by id, after the
    # joins on other columns
    d = d.join(R.user_features(t, PARITY_USER), "transaction_id").join(_familiarity(t), "transaction_id")
    d = d.withColumn("payee_seen_before", F.when(F.col("_fam") > 1, 1).otherwise(F.col("payee_seen_before")))
    stats = fit.agg(F.avg("_la").alias("mu"), F.stddev_pop("_la").alias("sd"))
    mu, sd = stats.select("mu").scalar(), stats.select("sd").scalar()
    h = F.coalesce(F.hour("timestamp"), F.lit(0))
    dow = F.coalesce(F.weekday("timestamp"), F.lit(0))
    m = F.lower(F.coalesce(F.col("memo"), F.lit("")))
    dr = F.lower(F.col("direction"))
    cols = {
        "log_amount": (la - mu) / F.when(sd > 0, sd).otherwise(F.lit(1.0)),
        "hour_sin": T.cyc_sin(h, 24), "hour_cos": T.cyc_cos(h, 24),
        "day_of_week_sin": T.cyc_sin(dow, 7), "day_of_week_cos": T.cyc_cos(dow, 7),
        "vpa_handle_id": F.col("vpa_handle_id"), "merchant_id": F.col("merchant_id"),
        "caps_state_int": F.coalesce("_caps", F.lit(0)),
        "is_round_amount": ((F.col("amount") % 50 == 0) | (F.col("amount") % 100 == 0)).cast("int"),
        "user_food_ratio_30d": F.col("user_food_ratio_30d"),
        "user_transport_ratio_30d": F.col("user_transport_ratio_30d"),
        "user_shopping_ratio_30d": F.col("user_shopping_ratio_30d"),
        "user_avg_transaction_amount": F.col("user_avg_transaction_amount_30d"),
        "user_transaction_frequency_score": F.lit(USER_FREQUENCY_SCORE),
        "payee_seen_before": F.col("payee_seen_before"), "merchant_known": F.col("merchant_known"),
        "catalog_category_id": F.col("catalog_category_id"), "catalog_confidence": F.col("catalog_confidence"),
        "novelty_score": ((F.col("catalog_confidence") <= 0) & (F.col("payee_seen_before") <= 0)).cast("double"),
        **{c: F.col(c) for c in TG.ONEHOT},
        "memo_has_loan": (X.whole_word(m, "loan") | X.whole_word(m, "lend") | X.whole_word(m, "borrow")).cast("int"),
        "memo_has_repay": (X.whole_word(m, "repay") | X.whole_word(m, "return")).cast("int"),
        "memo_has_gift": X.whole_word(m, "gift").cast("int"),
        "memo_has_tip": X.whole_word(m, "tip").cast("int"),
        "direction_send": F.coalesce((dr == "send").cast("int"), F.lit(0)),
        "direction_receive": F.coalesce((dr == "receive").cast("int"), F.lit(0)),
    }
    out = [F.col("transaction_id")]
    for c in PARITY_COLUMNS:
        typ = "long" if c in PARITY_CATEGORICAL else "double"
        out.append(F.coalesce(cols[c].cast(typ), F.lit(0).cast(typ)).alias(c))
    return d.select(*out)


def analytic(t: DataFrame, percentiles: DataFrame) -> DataFrame:
    """The analytic feature set (amount 7, time 8, merchant 12, user 10,
    velocity 3) per row; B7 keeps only its numeric columns."""
    a, ts = F.col("amount"), F.col("timestamp")
    h, dow, dom = F.hour(ts), F.weekday(ts), F.dayofmonth(ts)
    both = t.agg(F.avg("amount").alias("mu"), F.stddev_samp("amount").alias("sd"))
    mu, sd = both.select("mu").scalar(), both.select("sd").scalar()
    d = t.select(
        "*", F.log1p(a).alias("amount_log"), AM.right_closed_bin(a, AM.ANALYTIC_AMOUNT_EDGES).alias("amount_bin"),
        ((a - mu) / sd).alias("amount_zscore"), (a % 100 == 0).cast("int").alias("is_round_amount"),
        AM.decimal_places(a).alias("amount_decimal_places"), (a < 100).cast("int").alias("is_small_amount"),
        h.alias("hour"), dow.alias("day_of_week"), (dow >= 5).cast("int").alias("is_weekend"),
        ((h >= 9) & (h <= 17)).cast("int").alias("is_business_hours"), ((h >= 22) | (h <= 6)).cast("int").alias("is_night"),
        dom.alias("day_of_month"), (dom >= 28).cast("int").alias("is_month_end"), T.hour_bin(h).alias("hour_bin"),
        F.length("merchant_name").alias("merchant_name_length"),
        F.coalesce(F.col("merchant_name").rlike(r"\d").cast("int"), F.lit(0)).alias("merchant_has_number"),
        X.word_count("merchant_name").alias("merchant_word_count"),
        X.is_all_upper("merchant_name").alias("merchant_is_uppercase"),
        X.category_hint("merchant_name").alias("merchant_category_hint"))
    d = d.join(A.merchant_stats(t), "merchant_name", "left")
    d = d.join(A.user_aggregates(t), "user_id", "left").select("*", *A.user_row_features())
    d = with_running_count(d, ["user_id", "merchant_name"], "timestamp", "transaction_id", out="user_merchant_familiarity")
    one = F.lit(1)
    d = d.join(rolling_stats(t, ["user_id"], "timestamp", "transaction_id", {
        "transactions_last_hour": (one, 3600), "transactions_last_day": (one, 24 * 3600),
        "transactions_last_week": (one, 168 * 3600)}, include_current=True), "transaction_id")
    for c in ("transactions_last_hour", "transactions_last_day", "transactions_last_week"):
        d = d.withColumn(c, F.col(c).cast("long"))
    d = d.join(percentiles, "amount", "left")
    return d


def numeric_only(df: DataFrame, drop=("transaction_id",)) -> DataFrame:
    """Numeric columns only (Catalyst prunes everything else)."""
    keep = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in drop]
    return df.select("transaction_id", *keep)


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population std per column, zero std -> 1; the stats
    are one aggregate row read as scalar subqueries."""
    # the matrix is read twice (statistics, then rows) and computed once
    df = cut_lineage(df.select("transaction_id", *cols))
    # one aggregate job; its single row (2 numbers per column) is the fitted scaler
    stats = df.agg(*[F.avg(c).alias(f"mu_{c}") for c in cols], *[F.stddev_pop(c).alias(f"sd_{c}") for c in cols]).first()
    out = []
    for c in cols:
        mu, sd = stats[f"mu_{c}"], stats[f"sd_{c}"]
        sd = sd if sd else 1.0
        out.append(((F.col(c) - F.lit(mu)) / F.lit(sd)).alias(c))
    return df.select("transaction_id", *out)


def quality_report(df: DataFrame, spec: list[str], dtypes: dict[str, str]) -> DataFrame:
    """B2: one row per spec column: present, actual type, expected type,
    dtype match, null count (one aggregate over the matrix)."""
    present = set(df.columns)
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in spec if c in present])
    actual = dict(df.dtypes)
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"),
                              F.lit(c in present).alias("present"), F.lit(actual.get(c, "missing")).alias("actual_type"),
                              F.lit(dtypes[c]).alias("expected_type"),
                              (F.col(c) if c in present else F.lit(None).cast("long")).alias("null_count"))
                     for i, c in enumerate(spec)])
    return nulls.select(F.inline(rows)).select(
        "position", "feature", F.col("present").cast("int").alias("present"), "actual_type", "expected_type",
        (F.col("actual_type") == F.col("expected_type")).cast("int").alias("dtype_match"), "null_count")


ADV_ONEHOT = ["catalog_is_food_dining", "catalog_is_shopping", "catalog_is_transport", "catalog_is_healthcare",
              "catalog_is_personal", "catalog_is_bills"]


def advanced_catalog(catalog: DataFrame) -> DataFrame:
    """Advanced-set catalog map: the *last* catalog row per normalised name
    wins (its canonical category may be none -> id 0)."""
    canon = F.element_at(X.lit_map(X.CATALOG_CANONICAL), F.lower(F.col("Category")))
    d = catalog.select(X.normalize_name(F.col("Merchant Name")).alias("merchant_token"), "ord", canon.alias("_canon"))
    last = d.groupBy("merchant_token").agg(F.max("ord").alias("ord"))
    j = last.join(d, ["merchant_token", "ord"])
    return j.select("merchant_token", F.coalesce(F.element_at(X.lit_map(X.CANONICAL_IDS), F.col("_canon")),
                                                 F.lit(0.0)).alias("adv_catalog_id"))


def advanced(t: DataFrame, catalog: DataFrame, caps: DataFrame) -> DataFrame:
    """The advanced feature set (spec v2 columns) per row."""
    tok = X.normalize_name("merchant_name")
    hnd = X.vpa_handle("vpa")
    d = t.withColumn("merchant_token", tok).withColumn("vpa_handle", hnd)
    d = d.join(advanced_catalog(catalog), "merchant_token", "left")
    d = d.withColumn("_month", F.date_format("timestamp", "yyyy-MM")).withColumn("_cat", F.coalesce("category", F.lit("other")))
    d = d.join(caps.select(F.col("user_id"), F.col("category").alias("_cat"), F.col("month").alias("_month"),
                           F.col("caps_state_int").alias("_caps")), ["user_id", "_cat", "_month"], "left")
    # the wide rows travel once, by id: joins on other columns come before
    d = (d.join(R.user_features(t), "transaction_id").join(R.merchant_features(t), "transaction_id")
         .join(_familiarity(t), "transaction_id"))
    a, ts = F.col("amount"), F.col("timestamp")
    h, dow, dom, mon = F.hour(ts), F.weekday(ts), F.dayofmonth(ts), F.month(ts)
    wk = (dow >= 5).cast("int")
    la = AM.log_amount(a)
    u30 = F.col("user_avg_transaction_amount_30d")
    dev = AM.float_div(F.abs(a - u30), u30)
    cid = F.coalesce("adv_catalog_id", F.lit(0.0))
    tk = F.col("merchant_token")
    m = F.lower(F.coalesce(F.col("memo"), F.lit("")))
    trust = X.merchant_trust("merchant_name")
    corporate = tk.rlike(X.LEGAL_SUFFIX_PATTERN).cast("int")
    cols = {
        "hour": h, "day_of_week": dow, "day_of_month": dom, "month": mon, "quarter": F.quarter(ts),
        "week_of_year": F.weekofyear(ts), "is_weekend": wk, "is_month_end": (dom > 25).cast("int"),
        "is_month_start": (dom <= 5).cast("int"), "hour_sin": T.cyc_sin(h, 24), "hour_cos": T.cyc_cos(h, 24),
        "day_of_week_sin": T.cyc_sin(dow, 7), "day_of_week_cos": T.cyc_cos(dow, 7),
        "month_sin": T.cyc_sin(mon, 12), "month_cos": T.cyc_cos(mon, 12),
        **{k: F.col(k) for k in R.USER_DEFAULTS},
        "merchant_name_length": F.length(tk), "merchant_has_numbers": tk.rlike(r"\d").cast("int"),
        "merchant_word_count": X.word_count(tk), "merchant_has_ltd": corporate,
        "merchant_has_location": tk.rlike(X.CITY_PATTERN).cast("int"),
        "vpa_handle_length": F.length("vpa_handle"), "vpa_is_bank": F.col("vpa_handle").rlike(X.VPA_BANK_PATTERN).cast("int"),
        "vpa_is_wallet": F.col("vpa_handle").rlike(X.VPA_WALLET_PATTERN).cast("int"),
        **{k: F.col(k) for k in R.MERCHANT_DEFAULTS},
        "merchant_trust_score": trust,
        "payee_seen_before": (F.col("_fam") > 1).cast("int"), "merchant_known": (cid > 0).cast("int"),
        "is_corporate_merchant": corporate, "is_individual_merchant": 1 - corporate,
        "merchant_token": tk,
        "log_amount": la, "amount_rounded_to_10": AM.is_multiple(a, 10), "amount_rounded_to_50": AM.is_multiple(a, 50),
        "amount_rounded_to_100": AM.is_multiple(a, 100), "amount_rounded_to_500": AM.is_multiple(a, 500),
        "is_micro_transaction": (a < 50).cast("int"), "is_large_transaction": (a > 5000).cast("int"),
        "amount_bin": AM.right_closed_bin(a, AM.ADVANCED_AMOUNT_EDGES),
        "amount_deviation_from_user_avg": dev,
        **{n: m.rlike(p).cast("int") for n, p in X.MEMO_TOPIC_PATTERNS}, "memo_length": F.length(m),
        "vpa_handle": F.col("vpa_handle"),
        "caps_state_int": F.coalesce("_caps", F.lit(0)),
        "daily_spending_rate": F.col("user_avg_transaction_amount_7d") / 7,
        "monthly_spending_rate": u30 / 30, "days_since_month_start": dom,
        "is_salary_week": ((dom <= 7) | (dom >= 25)).cast("int"),
        "spending_consistency_score": F.lit(0.5), "budget_adherence_score": F.lit(0.7),
        "emergency_spending_indicator": ((a > u30 * 2) & (wk == 0)).cast("int"),
        "high_risk_time": ((h >= 22) | (h <= 5)).cast("int"), "unusual_amount_flag": (dev > 2).cast("int"),
        "catalog_category_id": cid, "catalog_confidence": (cid > 0).cast("double") * 0.95,
        **{n: (cid == float(i)).cast("int") for i, n in enumerate(ADV_ONEHOT, start=1)},
        "amount_x_hour": a * h, "amount_x_weekend": a * wk, "amount_x_month_end": a * (dom > 25).cast("int"),
        "merchant_freq_x_user_freq": F.col("merchant_frequency_30d") * F.col("user_transaction_frequency_30d"),
        "merchant_trust_x_amount": trust * la,
        "time_merchant_consistency": F.col("merchant_time_consistency") * F.col("merchant_business_hours_alignment"),
    }
    return d.select("transaction_id", *[v.alias(k) for k, v in cols.items()])
