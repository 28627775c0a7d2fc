"""Core per-user / per-merchant aggregates."""
from __future__ import annotations

from ..operators import aggregates as A
from ..sources.adapters import pay, txn
from .common import finish, rounded
from .oracle_base import PAY, TXN, with_
from .registry import register

USER_STATS_SQL = rounded(with_(TXN, """base AS (SELECT transaction_id, user_id, merchant_name, amount, hour("timestamp") AS hr FROM txn)""",
"""agg AS (SELECT user_id, count(amount) AS n, avg(amount) AS mu, coalesce(stddev_samp(amount), 0) AS sd,
                 sum(amount) AS tot, count(DISTINCT merchant_name) AS divers FROM base GROUP BY user_id)""",
"""hc AS (SELECT user_id, hr, count(*) AS c FROM base WHERE hr IS NOT NULL GROUP BY user_id, hr)""",
"""md AS (SELECT user_id, hr FROM (SELECT user_id, hr, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, hr ASC) AS rn FROM hc) WHERE rn = 1)""") + """
SELECT b.transaction_id, b.user_id, b.amount,
       a.n AS user_transaction_count, a.mu AS user_avg_amount, a.sd AS user_amount_std,
       a.tot AS user_total_spent, a.divers AS user_merchant_diversity,
       coalesce(md.hr, 12) AS user_preferred_hour,
       a.tot / (a.n + 1) AS user_spending_velocity,
       b.amount / (a.mu + 1) AS amount_vs_user_avg,
       CAST(abs(b.amount - a.mu) > 2 * a.sd AS INTEGER) AS is_unusual_amount,
       1 / (1 + a.sd) AS user_consistency_score
FROM base b JOIN agg a USING (user_id) LEFT JOIN md USING (user_id)""",
    ["amount", "user_avg_amount", "user_amount_std", "user_total_spent", "user_spending_velocity",
     "amount_vs_user_avg", "user_consistency_score"])


@register("user_stats", USER_STATS_SQL)
def q_user_stats(spark, sf_dir):
    return finish(A.user_stats(txn(spark, sf_dir)))


MERCHANT_STATS_SQL = rounded(with_(PAY, """m AS (SELECT merchant_name, count(amount) AS merchant_transaction_count,
       avg(amount) AS merchant_avg_amount, coalesce(stddev_samp(amount), 0) AS merchant_amount_std,
       count(DISTINCT user_id) AS merchant_unique_users
  FROM pay WHERE merchant_name IS NOT NULL GROUP BY merchant_name)""") + """
SELECT merchant_name, merchant_transaction_count, merchant_avg_amount, merchant_amount_std,
       merchant_unique_users,
       CAST(merchant_transaction_count >= 5 AS INTEGER) AS is_frequent_merchant,
       1 / (1 + merchant_amount_std) AS merchant_amount_consistency,
       merchant_unique_users / (SELECT max(merchant_unique_users) FROM m) AS merchant_popularity
FROM m""", ["merchant_avg_amount", "merchant_amount_std", "merchant_amount_consistency", "merchant_popularity"])


@register("merchant_stats", MERCHANT_STATS_SQL)
def q_merchant_stats(spark, sf_dir):
    return finish(A.merchant_stats(pay(spark, sf_dir)))
