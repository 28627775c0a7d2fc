"""Per-user trust score (L1–L9) and the amount-outlier operator (K13),
computed for all users in one job.

Every per-user statistic is a ``groupBy(user_id)`` aggregate (partial
aggregation map-side); the only ordered step, the gap to the previous
transaction, uses the time-bucketed ``with_prev_ts``. Exact per-user
percentiles (K13) come from ``ranking.group_quantiles``.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import time as T
from .ranking import group_quantiles
from .windows import with_prev_ts

# fixed values: component weights, defaults and stand-in constants
WEIGHTS = {"history": 0.40, "network": 0.25, "behavior": 0.20, "community": 0.15}
GEO_CONSISTENCY = 0.85
ACCOUNT_AGE_DAYS = 30
EPS = 1e-8
DEFAULT_SCORE = 0.5


def _clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def amount_outliers(t: DataFrame, contamination: float = 0.10, min_rows: int = 10) -> DataFrame:
    """K13 (re-aimed isolation forest): distance from the user's own median;
    outlier when above the user's own (1 - contamination) quantile of that
    distance, and only for users with more than ``min_rows`` rows."""
    med = t.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).join(
        group_quantiles(t, ["user_id"], "amount", {"median_amount": 0.5}), "user_id", "left")
    d = t.select("transaction_id", "user_id", "amount").join(med, "user_id").withColumn(
        "distance", F.abs(F.col("amount") - F.col("median_amount")))
    q = group_quantiles(d, ["user_id"], "distance", {"p90_distance": 1.0 - contamination})
    d = d.join(q, "user_id", "left")
    return d.select("transaction_id", "user_id", "amount", "median_amount", "distance", "p90_distance",
                    ((F.col("_n") > min_rows) & (F.col("distance") > F.col("p90_distance"))).cast("int").alias("is_outlier"),
                    F.col("_n").alias("n"))


def outlier_shares(t: DataFrame, contamination: float = 0.10, min_rows: int = 10) -> DataFrame:
    """``outlier_share`` per user: the mean of K13's flag, from counts of
    distinct amounts and distances, without going back to the rows."""
    values = t.groupBy("user_id", "amount").agg(F.count(F.lit(1)).alias("_n"))
    med = group_quantiles(values, ["user_id"], "amount", {"_med": 0.5}, weight="_n")
    far = values.join(med, "user_id").withColumn("distance", F.abs(F.col("amount") - F.col("_med")))
    q = group_quantiles(far, ["user_id"], "distance", {"_far": 1.0 - contamination}, weight="_n")
    known = F.when(F.col("distance").isNotNull(), F.col("_n"))
    out = F.coalesce(F.sum(F.when(F.col("distance") > F.col("_far"), F.col("_n"))), F.lit(0)) / F.sum(known)
    return far.join(q, "user_id").groupBy("user_id").agg(
        F.when(F.sum("_n") > min_rows, out).otherwise(0.0).alias("outlier_share"))


def components(t: DataFrame, failed_ratio_default: float = 0.05) -> DataFrame:
    """One row per user with every input the four components need."""
    base = t.select("transaction_id", "user_id", "merchant_name", "amount", "timestamp", "status", "category")
    agg = base.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("amount").alias("mu"),
        F.stddev_pop("amount").alias("sd"),
        F.count_distinct("merchant_name").alias("n_merchants"),
        F.count_distinct(F.coalesce("category", F.lit("other"))).alias("n_categories"),
        F.avg(F.when(F.col("status").isNull(), F.lit(None)).otherwise((F.col("status") == "failed").cast("double"))).alias("_failed"),
        F.avg(X.merchant_trust("merchant_name")).alias("merchant_trust_mean"),
        F.avg(((F.col("amount") % 100) == 0).cast("double")).alias("round_share"),
        F.avg(((F.hour("timestamp") >= 23) | (F.hour("timestamp") <= 5)).cast("double")).alias("night_share"),
        F.avg((F.col("amount") > 10000).cast("double")).alias("high_value_share"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
    )
    g = with_prev_ts(base.select("transaction_id", "user_id", "timestamp"), ["user_id"], "timestamp",
                     "transaction_id")
    gh = (T.epoch_micros("timestamp") - T.epoch_micros("prev_ts")) / F.lit(3.6e9)
    gaps = g.where(F.col("prev_ts").isNotNull()).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_gaps"), F.avg(gh).alias("gap_mu"), F.stddev_pop(gh).alias("gap_sd"))
    out = outlier_shares(base)
    c = agg.join(gaps, "user_id", "left").join(out, "user_id", "left")
    return c.withColumn("failed_ratio", F.coalesce("_failed", F.lit(failed_ratio_default))).drop("_failed")


def scored(t: DataFrame) -> DataFrame:
    c = components(t)
    days = T.whole_days_between("last_ts", "first_ts")
    consistency = 1 - F.least(F.col("sd") / (F.col("mu") + EPS), F.lit(1.0))
    regularity = F.when(F.coalesce("n_gaps", F.lit(0)) > 1,
                        1 - F.least(F.col("gap_sd") / (F.col("gap_mu") + EPS), F.lit(1.0))).otherwise(0.7)
    diversity = F.least(F.col("n_merchants") / F.greatest(F.col("n"), F.lit(1)), F.lit(1.0))
    failure = F.greatest(F.lit(0.0), 1 - F.col("failed_ratio") * 10)
    history = 0.25 * consistency + 0.25 * regularity + 0.25 * diversity + 0.25 * failure
    pattern = 1 - F.least(F.col("round_share") * 2, F.lit(1.0))
    network = 0.40 * F.col("merchant_trust_mean") + 0.30 * pattern + 0.30 * GEO_CONSISTENCY
    v = F.col("n") / F.greatest(days + 1, F.lit(1))
    vscore = F.when((v >= 1) & (v <= 5), 1.0).when(v < 1, 0.8).otherwise(F.greatest(F.lit(0.0), 1 - (v - 5) * 0.1))
    tscore = 1 - F.least(F.col("night_share") * 3, F.lit(0.8))
    ascore = F.when(F.col("n") > 10, 1 - F.least(F.col("outlier_share") * 5, F.lit(0.9))).otherwise(0.7)
    behavior = 0.4 * vscore + 0.3 * tscore + 0.3 * ascore
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col("user_id")), 1, 8), 16, 10).cast("long"), F.lit(100))
    community = _clamp01(0.75 + (bucket - 50) / 500.0)
    return c.select(
        "*", days.alias("history_days"),
        consistency.alias("consistency"), regularity.alias("regularity"), diversity.alias("diversity"),
        failure.alias("failure_score"), history.alias("history_score"),
        pattern.alias("amount_pattern_score"), network.alias("network_score"),
        v.alias("velocity"), vscore.alias("velocity_score"), tscore.alias("time_pattern_score"),
        ascore.alias("amount_behavior_score"), behavior.alias("behavior_score"),
        community.alias("community_score"),
    ).withColumn("overall_score", WEIGHTS["history"] * F.col("history_score") + WEIGHTS["network"] * F.col("network_score")
                 + WEIGHTS["behavior"] * F.col("behavior_score") + WEIGHTS["community"] * F.col("community_score"))


def with_default_scores(s: DataFrame, users: DataFrame) -> DataFrame:
    """Users without any payment get the default score (all components
    0.5, no flags, medium level)."""
    rest = users.select("user_id").where(F.col("user_id").isNotNull()).distinct().join(s.select("user_id"), "user_id", "left_anti")
    half = [F.lit(DEFAULT_SCORE).alias(c) for c in ("overall_score", "history_score", "network_score", "behavior_score", "community_score")]
    return s.unionByName(rest.select("user_id", *half), allowMissingColumns=True)


def trust_level(s: Column) -> Column:
    return (F.when(s >= 0.90, "very_high").when(s >= 0.75, "high").when(s >= 0.50, "medium")
             .when(s >= 0.25, "low").otherwise("very_low"))


def risk_flags(df: DataFrame) -> Column:
    h, b, n, c = (F.col(x) for x in ("history_score", "behavior_score", "network_score", "community_score"))
    flags = F.array(
        F.when(h < 0.3, "high_risk").when(h < 0.5, "medium_risk"),
        F.when(b < 0.3, "high_risk").when(b < 0.5, "low_risk"),
        F.when(n < 0.4, "medium_risk"),
        F.when(c < 0.3, "low_risk"),
        F.when(F.col("high_value_share") > 0.3, "medium_risk"),
    )
    fl = F.filter(flags, lambda x: x.isNotNull())
    return F.when(F.size(fl) == 0, F.array(F.lit("no_risk"))).otherwise(fl)


def confidence(df: DataFrame) -> Column:
    return F.least(F.lit(1.0), 0.5 + F.least(F.col("n") / 50.0, F.lit(0.3))
                   + F.least(F.col("history_days") / 180.0, F.lit(0.2)))


def risk_profile(s: DataFrame) -> DataFrame:
    """L8; the advice texts are fixed values."""
    flags = risk_flags(s)
    score = F.col("overall_score")
    d = s.withColumn("_flags", flags)
    level = (F.when((score >= 0.8) & F.array_contains("_flags", "no_risk"), "low").when(score >= 0.6, "medium")
              .when(score >= 0.4, "high").otherwise("critical"))
    recs = F.array_compact(F.array(
        F.when(score < 0.5, "Enable additional verification for high-value transactions"),
        F.when(score < 0.5, "Implement transaction monitoring"),
        F.when(F.array_contains("_flags", "high_risk"), "Require manual review for transactions above ₹1000"),
        F.when(F.array_contains("_flags", "high_risk"), "Enable real-time fraud monitoring"),
        F.when(F.col("behavior_score") < 0.4, "Monitor for unusual spending patterns"),
        F.when(F.col("network_score") < 0.4, "Verify merchant legitimacy for new payees"),
    ))
    monitoring = (F.when(score >= 0.8, "weekly").when(score >= 0.6, "daily").when(score >= 0.4, "hourly")
                   .otherwise("real_time"))
    return d.select(
        "user_id", score.alias("trust_score"), trust_level(score).alias("trust_level"),
        F.array_join("_flags", ",").alias("risk_flags"), level.alias("risk_level"),
        F.array_join(recs, "|").alias("recommendations"), monitoring.alias("monitoring_frequency"),
        (score * 50000).alias("daily_limit"), (score * 25000).alias("per_transaction_limit"),
        (score * 1000000).alias("monthly_limit"))


def factors(s: DataFrame, as_of: str) -> DataFrame:
    asof = T.ntz_literal(as_of)
    return s.select(
        "user_id", confidence(s).alias("confidence"), F.col("n").alias("transaction_count"),
        F.col("n_merchants").alias("unique_merchants"), F.col("mu").alias("avg_transaction_amount"),
        F.lit(ACCOUNT_AGE_DAYS).alias("account_age_days"),
        F.col("failed_ratio").alias("failed_transaction_ratio"),
        F.lit(GEO_CONSISTENCY).alias("geographic_consistency"),
        T.whole_days_between(asof, "last_ts").alias("last_transaction_days_ago"),
        (F.col("n") / F.greatest(F.col("history_days"), F.lit(1)) * 7).alias("transaction_frequency_per_week"),
        F.col("n_categories").alias("spending_categories"))
