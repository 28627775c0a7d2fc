"""Trust score family (L1–L8) and amount outliers (K13), on ``txn``."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trust as TR
from ..sources.adapters import txn
from ..sources.tables import table
from . import sqlx as S
from .common import finish, rounded
from .oracle_base import TXN, with_
from .registry import register

AS_OF = "2024-02-01T00:00:00"
_TS = '"timestamp"'
_US = f"epoch_us({_TS})"

OUTLIER_CTES = [
    """med AS (SELECT user_id, quantile_cont(amount, 0.5) AS median_amount, count(*) AS n FROM txn GROUP BY user_id)""",
    """dist AS (SELECT t.transaction_id, t.user_id, t.amount, m.median_amount, abs(t.amount - m.median_amount) AS distance, m.n
               FROM txn t JOIN med m USING (user_id))""",
    """p AS (SELECT user_id, quantile_cont(distance, 0.9) AS p90_distance FROM dist GROUP BY user_id)""",
    """outl AS (SELECT d.*, p.p90_distance, CAST(d.n > 10 AND d.distance > p.p90_distance AS INTEGER) AS is_outlier
               FROM dist d JOIN p USING (user_id))""",
]

BASE = with_(TXN, *OUTLIER_CTES, f"""agg AS (SELECT user_id, count(*) AS n, avg(amount) AS mu, stddev_pop(amount) AS sd,
   count(DISTINCT merchant_name) AS n_merchants, count(DISTINCT coalesce(category, 'other')) AS n_categories,
   coalesce(avg(CASE WHEN status IS NULL THEN NULL ELSE CAST(status = 'failed' AS DOUBLE) END), 0.05) AS failed_ratio,
   avg({S.merchant_trust('merchant_name')}) AS merchant_trust_mean,
   avg(CAST(amount % 100 = 0 AS DOUBLE)) AS round_share,
   avg(CAST(hour({_TS}) >= 23 OR hour({_TS}) <= 5 AS DOUBLE)) AS night_share,
   avg(CAST(amount > 10000 AS DOUBLE)) AS high_value_share,
   min({_TS}) AS first_ts, max({_TS}) AS last_ts
  FROM txn GROUP BY user_id)""",
f"""g AS (SELECT user_id, ({_US} - lag({_US}) OVER (PARTITION BY user_id ORDER BY {_TS}, transaction_id)) / 3600000000.0 AS gh FROM txn)""",
"""gaps AS (SELECT user_id, count(gh) AS n_gaps, avg(gh) AS gap_mu, stddev_pop(gh) AS gap_sd FROM g WHERE gh IS NOT NULL GROUP BY user_id)""",
"""os AS (SELECT user_id, avg(is_outlier) AS outlier_share FROM outl GROUP BY user_id)""",
"""c AS (SELECT a.*, gaps.n_gaps, gaps.gap_mu, gaps.gap_sd, os.outlier_share,
          CAST(floor((epoch_us(last_ts) - epoch_us(first_ts)) / 86400000000.0) AS BIGINT) AS history_days
        FROM agg a LEFT JOIN gaps USING (user_id) LEFT JOIN os USING (user_id))""",
"""s1 AS (SELECT *,
   1 - least(sd / (mu + 1e-8), 1.0) AS consistency,
   CASE WHEN coalesce(n_gaps, 0) > 1 THEN 1 - least(gap_sd / (gap_mu + 1e-8), 1.0) ELSE 0.7 END AS regularity,
   least(n_merchants / greatest(n, 1), 1.0) AS diversity,
   greatest(0.0, 1 - failed_ratio * 10) AS failure_score,
   1 - least(round_share * 2, 1.0) AS amount_pattern_score,
   n / greatest(history_days + 1, 1) AS velocity,
   1 - least(night_share * 3, 0.8) AS time_pattern_score,
   CASE WHEN n > 10 THEN 1 - least(outlier_share * 5, 0.9) ELSE 0.7 END AS amount_behavior_score,
   greatest(0.0, least(1.0, 0.75 + ((CAST(('0x' || substr(md5(user_id), 1, 8)) AS BIGINT) % 100) - 50) / 500.0)) AS community_score
  FROM c)""",
"""s2 AS (SELECT *,
   0.25 * consistency + 0.25 * regularity + 0.25 * diversity + 0.25 * failure_score AS history_score,
   0.40 * merchant_trust_mean + 0.30 * amount_pattern_score + 0.30 * 0.85 AS network_score,
   CASE WHEN velocity >= 1 AND velocity <= 5 THEN 1.0 WHEN velocity < 1 THEN 0.8 ELSE greatest(0.0, 1 - (velocity - 5) * 0.1) END AS velocity_score
  FROM s1)""",
"""s3 AS (SELECT *, 0.4 * velocity_score + 0.3 * time_pattern_score + 0.3 * amount_behavior_score AS behavior_score FROM s2)""",
"""s AS (SELECT *, 0.40 * history_score + 0.25 * network_score + 0.20 * behavior_score + 0.15 * community_score AS overall_score FROM s3)""",
"""fl AS (SELECT *, list_filter([
     CASE WHEN history_score < 0.3 THEN 'high_risk' WHEN history_score < 0.5 THEN 'medium_risk' END,
     CASE WHEN behavior_score < 0.3 THEN 'high_risk' WHEN behavior_score < 0.5 THEN 'low_risk' END,
     CASE WHEN network_score < 0.4 THEN 'medium_risk' END,
     CASE WHEN community_score < 0.3 THEN 'low_risk' END,
     CASE WHEN high_value_share > 0.3 THEN 'medium_risk' END], lambda x: x IS NOT NULL) AS fl0 FROM s)""",
"""f AS (SELECT *, CASE WHEN len(fl0) = 0 THEN ['no_risk'] ELSE fl0 END AS flags FROM fl)""")

LEVEL = ("CASE WHEN overall_score >= 0.90 THEN 'very_high' WHEN overall_score >= 0.75 THEN 'high' "
         "WHEN overall_score >= 0.50 THEN 'medium' WHEN overall_score >= 0.25 THEN 'low' ELSE 'very_low' END")


ALL_USERS = """, fa AS (SELECT * FROM f UNION ALL BY NAME
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, 0.5 AS overall_score, 0.5 AS history_score, 0.5 AS network_score,
    0.5 AS behavior_score, 0.5 AS community_score, ['no_risk'] AS flags FROM customer
  WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT user_id FROM f WHERE user_id IS NOT NULL))
"""


def _scored(spark, sf):
    return TR.scored(txn(spark, sf))


def _scored_all(spark, sf):
    """Scores of every customer, with the default where there is no payment."""
    users = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("user_id"))
    return TR.with_default_scores(_scored(spark, sf), users)


@register("trust_history", rounded(BASE + "SELECT user_id, consistency, regularity, diversity, failure_score, history_score FROM f",
                                   ["consistency", "regularity", "diversity", "failure_score", "history_score"]))
def q_trust_history(spark, sf):
    return finish(_scored(spark, sf).select("user_id", "consistency", "regularity", "diversity", "failure_score", "history_score"))


@register("trust_network", rounded(BASE + "SELECT user_id, merchant_trust_mean, round_share, amount_pattern_score, network_score FROM f",
                                   ["merchant_trust_mean", "round_share", "amount_pattern_score", "network_score"]))
def q_trust_network(spark, sf):
    return finish(_scored(spark, sf).select("user_id", "merchant_trust_mean", "round_share", "amount_pattern_score", "network_score"))


_BEH = ["velocity", "velocity_score", "night_share", "time_pattern_score", "outlier_share", "amount_behavior_score", "behavior_score"]


@register("trust_behavior", rounded(BASE + "SELECT user_id, " + ", ".join(_BEH) + " FROM f", _BEH))
def q_trust_behavior(spark, sf):
    return finish(_scored(spark, sf).select("user_id", *_BEH))


@register("trust_community", rounded(BASE + "SELECT user_id, community_score FROM f", ["community_score"]))
def q_trust_community(spark, sf):
    return finish(_scored(spark, sf).select("user_id", "community_score"))


_SC = ["overall_score", "history_score", "network_score", "behavior_score", "community_score"]


@register("trust_score", rounded(BASE + ALL_USERS + f"SELECT user_id, {', '.join(_SC)}, {LEVEL} AS trust_level FROM fa", _SC))
def q_trust_score(spark, sf):
    s = _scored_all(spark, sf)
    return finish(s.select("user_id", *_SC, TR.trust_level(F.col("overall_score")).alias("trust_level")))


@register("trust_risk_flags", BASE + ALL_USERS + "SELECT user_id, array_to_string(flags, ',') AS risk_flags, len(flags) AS n_flags FROM fa")
def q_trust_risk_flags(spark, sf):
    s = _scored_all(spark, sf)
    fl = TR.risk_flags(s)
    return finish(s.select("user_id", F.array_join(fl, ",").alias("risk_flags"), F.size(fl).cast("bigint").alias("n_flags")))


_FAC = ["confidence", "avg_transaction_amount", "failed_transaction_ratio", "geographic_consistency",
        "transaction_frequency_per_week"]


@register("trust_factors", rounded(BASE + f"""
SELECT user_id, least(1.0, 0.5 + least(n / 50.0, 0.3) + least(history_days / 180.0, 0.2)) AS confidence,
  n AS transaction_count, n_merchants AS unique_merchants, mu AS avg_transaction_amount, 30 AS account_age_days,
  failed_ratio AS failed_transaction_ratio, 0.85 AS geographic_consistency,
  CAST(floor((epoch_us(TIMESTAMP '{AS_OF.replace('T', ' ')}') - epoch_us(last_ts)) / 86400000000.0) AS BIGINT) AS last_transaction_days_ago,
  n / greatest(history_days, 1) * 7 AS transaction_frequency_per_week, n_categories AS spending_categories
FROM f""", _FAC))
def q_trust_factors(spark, sf):
    return finish(TR.factors(_scored(spark, sf), AS_OF))


_RP = ["trust_score", "daily_limit", "per_transaction_limit", "monthly_limit"]


@register("risk_profile", rounded(BASE + ALL_USERS + f"""
SELECT user_id, overall_score AS trust_score, {LEVEL} AS trust_level, array_to_string(flags, ',') AS risk_flags,
  CASE WHEN overall_score >= 0.8 AND list_contains(flags, 'no_risk') THEN 'low' WHEN overall_score >= 0.6 THEN 'medium'
       WHEN overall_score >= 0.4 THEN 'high' ELSE 'critical' END AS risk_level,
  array_to_string(list_filter([
    CASE WHEN overall_score < 0.5 THEN 'Enable additional verification for high-value transactions' END,
    CASE WHEN overall_score < 0.5 THEN 'Implement transaction monitoring' END,
    CASE WHEN list_contains(flags, 'high_risk') THEN 'Require manual review for transactions above ₹1000' END,
    CASE WHEN list_contains(flags, 'high_risk') THEN 'Enable real-time fraud monitoring' END,
    CASE WHEN behavior_score < 0.4 THEN 'Monitor for unusual spending patterns' END,
    CASE WHEN network_score < 0.4 THEN 'Verify merchant legitimacy for new payees' END], lambda x: x IS NOT NULL), '|') AS recommendations,
  CASE WHEN overall_score >= 0.8 THEN 'weekly' WHEN overall_score >= 0.6 THEN 'daily' WHEN overall_score >= 0.4 THEN 'hourly'
       ELSE 'real_time' END AS monitoring_frequency,
  overall_score * 50000 AS daily_limit, overall_score * 25000 AS per_transaction_limit, overall_score * 1000000 AS monthly_limit
FROM fa""", _RP))
def q_risk_profile(spark, sf):
    return finish(TR.risk_profile(_scored_all(spark, sf)))


@register("amount_outliers", rounded(with_(TXN, *OUTLIER_CTES) + """
SELECT transaction_id, user_id, amount, median_amount, distance, p90_distance, is_outlier, n FROM outl""",
    ["amount", "median_amount", "distance", "p90_distance"]))
def q_amount_outliers(spark, sf):
    return finish(TR.amount_outliers(txn(spark, sf)))


@register("merchant_trust_override", rounded(with_(TXN) + f"""
SELECT merchant_name, {S.merchant_trust('merchant_name')} AS default_trust,
  arg_max(CASE WHEN rating IS NOT NULL THEN rating / 5.0 END, CASE WHEN rating IS NOT NULL THEN ("timestamp", transaction_id) END) AS override_trust,
  coalesce(arg_max(CASE WHEN rating IS NOT NULL THEN rating / 5.0 END, CASE WHEN rating IS NOT NULL THEN ("timestamp", transaction_id) END),
           {S.merchant_trust('merchant_name')}) AS effective_trust,
  count(rating) AS feedback_count
FROM txn WHERE merchant_name IS NOT NULL GROUP BY merchant_name""", ["default_trust", "override_trust", "effective_trust"]))
def q_merchant_trust_override(spark, sf):
    """Rated payments are trust feedback for the merchant; the latest
    feedback overrides the keyword trust table, others keep the default."""
    from ..functions import text as X
    t = txn(spark, sf).where(F.col("merchant_name").isNotNull())
    fb = t.where(F.col("rating").isNotNull())
    latest = fb.groupBy("merchant_name").agg(
        F.max_by(F.col("rating") / 5.0, F.struct("timestamp", "transaction_id")).alias("override_trust"),
        F.count(F.lit(1)).alias("feedback_count"))
    m = t.select("merchant_name").distinct().join(latest, "merchant_name", "left")
    d = X.merchant_trust("merchant_name")
    return finish(m.select("merchant_name", d.alias("default_trust"), "override_trust",
                           F.coalesce("override_trust", d).alias("effective_trust"),
                           F.coalesce("feedback_count", F.lit(0)).cast("long").alias("feedback_count")))
