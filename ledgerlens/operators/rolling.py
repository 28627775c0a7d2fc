"""Rolling user (G3) and merchant (G19) features: trailing event-time
windows over the row's history only ([t - W, t), no leakage), from
``rolling_stats``: all statistics of a key in one narrow pass, joined back by
id. Rows without history get the reference's cold-start constants."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .windows import rolling_stats, with_running_count

DAY = 86400
# fixed values: cold-start defaults
USER_DEFAULTS = {
    "user_food_ratio_7d": 0.25, "user_food_ratio_30d": 0.25,
    "user_transport_ratio_7d": 0.15, "user_transport_ratio_30d": 0.15,
    "user_shopping_ratio_7d": 0.30, "user_shopping_ratio_30d": 0.30,
    "user_bills_ratio_7d": 0.20, "user_bills_ratio_30d": 0.20,
    "user_entertainment_ratio_7d": 0.10, "user_entertainment_ratio_30d": 0.10,
    "user_avg_transaction_amount_7d": 500.0, "user_avg_transaction_amount_30d": 500.0,
    "user_max_transaction_amount_7d": 2000.0, "user_max_transaction_amount_30d": 5000.0,
    "user_transaction_frequency_7d": 10.0, "user_transaction_frequency_30d": 40.0,
    "user_unique_merchants_7d": 5.0, "user_unique_merchants_30d": 15.0,
    "user_weekend_spending_ratio": 0.3, "user_evening_spending_ratio": 0.4,
}
MERCHANT_DEFAULTS = {
    "merchant_frequency_7d": 1.0, "merchant_frequency_30d": 2.0, "merchant_frequency_all_time": 5.0,
    "merchant_avg_amount": 500.0, "merchant_amount_variance": 100.0, "merchant_is_new": 0,
    "merchant_category_consistency": 0.8, "merchant_time_consistency": 0.7,
    "merchant_amount_consistency": 0.6, "merchant_business_hours_alignment": 0.5,
    "merchant_weekend_activity": 0.3,
}
# spend groups of the ratios, from the category hint of the merchant name
RATIO_GROUPS = [("food", "food"), ("transport", "transport"), ("shopping", "shopping"),
                ("bills", "utilities"), ("entertainment", "entertainment")]


def _ratio(num: Column, n: Column, den: Column, default: float) -> Column:
    """``num / den`` where the window holds ``n`` > 0 non-zero amounts. The
    test is on the exact count: a running-sum difference may leave a residue
    where the true sum is 0."""
    return F.when((n > 0) & (den > 0), num / den).otherwise(F.lit(default))


def user_rolling(t: DataFrame) -> DataFrame:
    """The rows with all user features."""
    return t.join(user_features(t), "transaction_id").select(*t.columns, *USER_DEFAULTS)


def user_features(t: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``transaction_id`` and the named user features (all by default); only
    the statistics that they need are computed."""
    names = list(USER_DEFAULTS) if names is None else names
    h = F.hour("timestamp")
    t = t.select("transaction_id", "user_id", "merchant_name", "timestamp", "amount", X.category_hint("merchant_name").alias("_hint"))
    amt = F.coalesce(F.col("amount"), F.lit(0.0))
    nonzero, has_amt = (amt != 0).cast("int"), F.col("amount").isNotNull().cast("int")
    # one Column per value, whatever the number of windows it is summed over
    spent = {f"user_{name}_ratio": F.when(F.col("_hint") == group, amt).otherwise(0.0) for name, group in RATIO_GROUPS}
    when = {"user_weekend_spending_ratio": F.when(F.weekday("timestamp") >= 5, amt).otherwise(0.0),
            "user_evening_spending_ratio": F.when((h >= 17) & (h <= 21), amt).otherwise(0.0)}
    sums, maxes, distincts, cols = {}, {}, {}, {}

    def total(key: str, value: Column, days: int) -> Column:
        sums[f"{key}{days}"] = (value, days * DAY)
        return F.col(f"{key}{days}")

    for days in (7, 30):
        def share(name: str, value: Column, days: int = days) -> Column:
            return _ratio(total(f"_{name}", value, days), total("_nz", nonzero, days), total("_s", amt, days), USER_DEFAULTS[name])

        def known(name: str, value: Column, days: int = days) -> Column:
            return F.when(total("_n", has_amt, days) > 0, value).otherwise(USER_DEFAULTS[name])

        for name, value in spent.items():
            k = f"{name}_{days}d"
            if k in names:
                cols[k] = share(k, value)
        if days == 30:
            for k, value in when.items():
                if k in names:
                    cols[k] = share(k, value)
        k = f"user_avg_transaction_amount_{days}d"
        if k in names:
            # exactly 0 over zero amounts: a residue would pass for an average
            mean = total("_s", amt, days) / total("_n", has_amt, days)
            cols[k] = known(k, F.when(total("_nz", nonzero, days) > 0, mean).otherwise(0.0))
        k = f"user_max_transaction_amount_{days}d"
        if k in names:
            maxes[f"_mx{days}"] = (F.col("amount"), days * DAY)
            cols[k] = known(k, F.col(f"_mx{days}"))
        k = f"user_transaction_frequency_{days}d"
        if k in names:
            cols[k] = known(k, total("_n", has_amt, days).cast("double"))
        k = f"user_unique_merchants_{days}d"
        if k in names:
            distincts[f"_u{days}"] = (F.col("merchant_name"), days * DAY)
            cols[k] = known(k, F.col(f"_u{days}").cast("double"))
    stats = rolling_stats(t, ["user_id"], "timestamp", "transaction_id", sums, maxes, distincts)
    return stats.select("transaction_id", *[cols[k].alias(k) for k in names])


def merchant_rolling(t: DataFrame) -> DataFrame:
    """The rows with all merchant features."""
    return t.join(merchant_features(t), "transaction_id").select(*t.columns, *MERCHANT_DEFAULTS)


def merchant_features(t: DataFrame) -> DataFrame:
    """``transaction_id`` and the merchant features: one pass over the
    merchant's events, with counts by category and by hour as parts of it."""
    h = F.hour("timestamp")
    # amounts are summed as differences from the merchant's mean: a sum of
    # squares around 0 would lose a small variance of large amounts
    mean = t.groupBy(F.col("merchant_name").alias("_m")).agg(F.avg("amount").alias("_ref"))
    d = t.select("transaction_id", "merchant_name", "timestamp", "amount", h.alias("_h"),
                 F.coalesce("category", F.lit("other")).alias("_cat"),
                 (F.weekday("timestamp") >= 5).cast("double").alias("_wk"),
                 ((h >= 9) & (h <= 17)).cast("double").alias("_bh"))
    d = d.join(mean, F.col("merchant_name").eqNullSafe(F.col("_m")), "left").drop("_m")
    has_amt = F.col("amount").isNotNull()
    dev = F.coalesce(F.col("amount") - F.col("_ref"), F.lit(0.0))
    month = 30 * DAY
    one = has_amt.cast("int")
    own = rolling_stats(d, ["merchant_name"], "timestamp", "transaction_id", {
        "_n7": (one, 7 * DAY), "_n30": (one, month), "_s30": (dev, month), "_ss30": (dev * dev, month),
        "_wks30": (F.when(has_amt, F.col("_wk")).otherwise(0.0), month), "_bhs30": (F.when(has_amt, F.col("_bh")).otherwise(0.0), month),
        "_nc30": (one, month, 1), "_nh30": (one, month, 2)}, parts=[F.col("_cat"), F.col("_h")])
    seen = with_running_count(d.select("transaction_id", "merchant_name", "timestamp", "_ref"), ["merchant_name"], "timestamp",
                              "transaction_id", out="_rc")
    out = own.join(seen.select("transaction_id", "_rc", "_ref"), "transaction_id")
    n30, has = F.col("_n30"), F.col("_n30") > 0
    off = F.col("_s30") / n30
    mu = F.col("_ref") + off
    var = F.greatest(F.lit(0.0), F.col("_ss30") / n30 - off * off)
    M = MERCHANT_DEFAULTS
    return out.select(
        "transaction_id",
        F.col("_n7").cast("double").alias("merchant_frequency_7d"),
        n30.cast("double").alias("merchant_frequency_30d"),
        (F.col("_rc") - 1).cast("double").alias("merchant_frequency_all_time"),
        F.when(has, mu).otherwise(M["merchant_avg_amount"]).alias("merchant_avg_amount"),
        F.when(has, var).otherwise(M["merchant_amount_variance"]).alias("merchant_amount_variance"),
        (F.col("_rc") == 1).cast("int").alias("merchant_is_new"),
        F.when(has, F.col("_nc30") / n30).otherwise(M["merchant_category_consistency"]).alias("merchant_category_consistency"),
        F.when(has, F.col("_nh30") / n30).otherwise(M["merchant_time_consistency"]).alias("merchant_time_consistency"),
        F.when(has & (mu > 0), 1 / (1 + F.sqrt(var) / mu)).otherwise(M["merchant_amount_consistency"]).alias("merchant_amount_consistency"),
        F.when(has, F.col("_bhs30") / n30).otherwise(M["merchant_business_hours_alignment"]).alias("merchant_business_hours_alignment"),
        F.when(has, F.col("_wks30") / n30).otherwise(M["merchant_weekend_activity"]).alias("merchant_weekend_activity"),
    )
