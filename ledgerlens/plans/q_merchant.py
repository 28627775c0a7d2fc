"""Merchant family (M1–M19, F7) per VPA on ``pay``."""
from __future__ import annotations

from ..functions import text as X
from ..operators import merchant as M
from ..session import cut_lineage
from ..sources.adapters import pay
from . import sqlx as S
from .common import finish, rounded
from .oracle_base import PAY, with_
from .registry import register

_TS = '"timestamp"'
_US = f"epoch_us({_TS})"
_CAT = S.first_match("lower(coalesce(vpa, ''))", X.MERCHANT_BUSINESS_KEYWORDS, "other")
_INITCAP = "array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"

_CTES = [
f"""mk AS (SELECT {_CAT} AS category, avg(amount) AS mkt FROM pay GROUP BY 1)""",
f"""g AS (SELECT vpa, floor(({_US} - lag({_US}) OVER (PARTITION BY vpa ORDER BY {_TS}, transaction_id)) / 86400000000.0) AS gd
  FROM pay WHERE {_TS} IS NOT NULL)""",
"""fq AS (SELECT vpa, count(*) AS nt, avg(gd) AS mean_gap_days FROM g GROUP BY vpa)""",
f"""mv AS (SELECT vpa, strftime({_TS}, '%Y-%m') AS m, sum(amount) AS v FROM pay
  WHERE {_TS} IS NOT NULL AND amount IS NOT NULL AND amount <> 0 GROUP BY ALL)""",
"""gm AS (SELECT vpa, count(*) AS months, arg_min(v, m) AS first_v, arg_max(v, m) AS last_v FROM mv GROUP BY vpa)""",
f"""a AS (SELECT vpa, count(*) AS n, sum(coalesce(amount, 0)) AS total_volume, avg(coalesce(amount, 0)) AS mu,
   stddev_pop(coalesce(amount, 0)) AS sd,
   avg(coalesce(CAST(status = 'failed' AS DOUBLE), 0)) AS fail,
   avg(coalesce(CAST(status = 'success' AS DOUBLE), 0)) AS success_rate,
   count({_TS}) AS n_timed,
   avg(CASE WHEN {_TS} IS NOT NULL THEN CAST(hour({_TS}) < 6 OR hour({_TS}) > 22 AS DOUBLE) END) AS night_share,
   min({_TS}) AS first_ts, max({_TS}) AS last_ts,
   avg(coalesce(CAST(disputed AS DOUBLE), 0)) AS dispute_rate,
   avg(coalesce(CAST(refunded AS DOUBLE), 0)) AS refund_rate,
   avg(CASE WHEN coalesce(rating, 0) <> 0 THEN rating / 5.0 WHEN coalesce(disputed, FALSE) THEN 0.1
            WHEN coalesce(refunded, FALSE) THEN 0.2 ELSE 0.7 END) AS user_sentiment,
   max(CAST(amount > 50000 AS INTEGER)) AS large, max(vpa) AS vv
  FROM pay GROUP BY vpa)""",
f"""b AS (SELECT a.*, sd / greatest(mu, 1.0) AS cv,
   CAST(n > 1 AND sd / greatest(mu, 1.0) > 2.0 AS INTEGER) + CAST(coalesce(fail, 0) > 0.1 AS INTEGER)
     + CAST(coalesce(night_share, 0) > 0.3 AS INTEGER) AS factors,
   CAST(floor((epoch_us(last_ts) - epoch_us(first_ts)) / 86400000000.0) AS BIGINT) AS span,
   {_CAT.replace('vpa', 'vv')} AS category
  FROM a)""",
f"""p AS (SELECT b.vpa, n AS transaction_count, total_volume, total_volume / greatest(n, 1) AS avg_transaction_size,
   CASE WHEN factors >= 3 THEN 'critical' WHEN factors = 2 THEN 'high' WHEN factors = 1 THEN 'medium' ELSE 'low' END AS risk_level,
   greatest(0.0, least(1.0, (0.8 + CASE WHEN factors >= 3 THEN -0.4 WHEN factors = 2 THEN -0.2 WHEN factors = 1 THEN 0.0 ELSE 0.1 END) * success_rate)) AS trust_score,
   CASE WHEN n = 0 THEN 0.0 WHEN n_timed < 2 THEN 0.3 WHEN span = 0 THEN 0.5
        WHEN n * 30 / greatest(span, 1) >= 4 THEN 1.0 WHEN n * 30 / greatest(span, 1) >= 2 THEN 0.8
        WHEN n * 30 / greatest(span, 1) >= 1 THEN 0.6 ELSE 0.4 END AS loyalty_score,
   dispute_rate, refund_rate, user_sentiment,
   greatest(0.0, least(1.0, 0.8 * success_rate * (1 - dispute_rate) * (1 - refund_rate * 0.5))) AS service_quality,
   least(1.0, 0.8 + 0.1 * large + 0.1 * CAST(n >= 10 AS INTEGER)) AS compliance_score,
   split_part(vv, '@', 1) AS merchant_id,
   {_INITCAP.format(x="translate(split_part(vv, '@', 1), '._', '  ')")} AS business_name,
   b.category, cv, mu, night_share,
   fq.mean_gap_days,
   CASE WHEN coalesce(fq.nt, 0) < 2 THEN 0.0 WHEN fq.mean_gap_days <= 1 THEN 1.0 WHEN fq.mean_gap_days <= 7 THEN 0.8
        WHEN fq.mean_gap_days <= 30 THEN 0.6 WHEN fq.mean_gap_days <= 90 THEN 0.4 ELSE 0.2 END AS frequency_score,
   CASE WHEN n < 4 OR coalesce(gm.months, 0) < 2 THEN 0.5
        ELSE least(1.0, greatest(0.0, 0.5 + (gm.last_v - gm.first_v) / greatest(gm.first_v, 1.0))) END AS growth_trend,
   CASE WHEN mk.mkt IS NULL AND n > 1 THEN greatest(0.0, least(1.0, 1 - cv / 2)) WHEN mk.mkt IS NULL THEN 0.7
        WHEN mk.mkt = 0 THEN 0.5 WHEN mu / mk.mkt <= 0.9 THEN 1.0 WHEN mu / mk.mkt <= 1.1 THEN 0.8
        WHEN mu / mk.mkt <= 1.3 THEN 0.6 ELSE 0.3 END AS pricing_fairness
  FROM b LEFT JOIN fq USING (vpa) LEFT JOIN gm USING (vpa) LEFT JOIN mk ON mk.category = b.category)"""]
BASE = with_(PAY, *_CTES)
# the same per (user, VPA): both in one key, taken apart at the end
BY_USER = with_(PAY, "payu AS (SELECT * REPLACE (concat(user_id, chr(1), vpa) AS vpa) FROM pay)",
                *[c.replace("FROM pay", "FROM payu") for c in _CTES])

PROFILE_COLS = ["vpa", "merchant_id", "business_name", "category", "transaction_count", "total_volume",
                "avg_transaction_size", "frequency_score", "loyalty_score", "pricing_fairness", "growth_trend",
                "risk_level", "trust_score"]
PROFILE_DBL = ["total_volume", "avg_transaction_size", "frequency_score", "loyalty_score", "pricing_fairness",
               "growth_trend", "trust_score"]


def _profile(spark, sf):
    t = pay(spark, sf)
    return M.profile(t, M.market_averages(t))


@register("merchant_profile", rounded(BASE + f"SELECT {', '.join(PROFILE_COLS)} FROM p", PROFILE_DBL))
def q_merchant_profile(spark, sf):
    return finish(_profile(spark, sf).select(*PROFILE_COLS))


@register("merchant_risk", rounded(BASE + "SELECT vpa, risk_level, trust_score, cv, night_share FROM p",
                                   ["trust_score", "cv", "night_share"]))
def q_merchant_risk(spark, sf):
    return finish(_profile(spark, sf).select("vpa", "risk_level", "trust_score", "_cv", "night_share")
                  .withColumnRenamed("_cv", "cv"))


@register("merchant_loyalty", rounded(BASE + "SELECT vpa, transaction_count, loyalty_score FROM p", ["loyalty_score"]))
def q_merchant_loyalty(spark, sf):
    return finish(_profile(spark, sf).select("vpa", "transaction_count", "loyalty_score"))


_Q = ["dispute_rate", "refund_rate", "user_sentiment", "service_quality", "compliance_score"]


@register("merchant_quality", rounded(BASE + f"SELECT vpa, {', '.join(_Q)} FROM p", _Q))
def q_merchant_quality(spark, sf):
    return finish(_profile(spark, sf).select("vpa", *_Q))


@register("merchant_insights", rounded(BASE + """
SELECT vpa,
  array_to_string(list_filter([CASE WHEN pricing_fairness < 0.7 THEN 'pricing_optimization' END,
    CASE WHEN frequency_score > 0.8 THEN 'spending_pattern' END,
    CASE WHEN risk_level IN ('high', 'critical') THEN 'risk_warning' END,
    CASE WHEN growth_trend > 0.5 THEN 'market_opportunity' END,
    CASE WHEN service_quality < 0.6 THEN 'service_warning' END], lambda x: x IS NOT NULL), ',') AS insights,
  CASE WHEN pricing_fairness < 0.7 THEN avg_transaction_size * 0.15 END AS estimated_savings,
  array_to_string(list_filter([CASE WHEN trust_score < 0.5 THEN 'Low trust score indicates reliability concerns' END,
    CASE WHEN dispute_rate > 0.1 THEN 'High dispute rate suggests service issues' END,
    CASE WHEN refund_rate > 0.05 THEN 'Elevated refund rate may indicate quality problems' END,
    CASE WHEN pricing_fairness < 0.6 THEN 'Pricing significantly above market average' END,
    CASE WHEN compliance_score < 0.7 THEN 'Potential regulatory compliance concerns' END], lambda x: x IS NOT NULL), '|') AS risk_factors,
  array_to_string(list_filter([CASE WHEN loyalty_score > 0.8 THEN 'High loyalty - negotiate volume discounts' END,
    CASE WHEN frequency_score > 0.7 THEN 'Frequent usage - explore loyalty programs' END,
    CASE WHEN growth_trend > 0.6 THEN 'Growing merchant - potential partnership opportunities' END,
    CASE WHEN service_quality > 0.8 THEN 'High service quality - reliable for important transactions' END], lambda x: x IS NOT NULL), '|') AS opportunities,
  array_to_string(list_filter([CASE WHEN risk_level = 'high' THEN 'Set transaction limits for this merchant' END,
    CASE WHEN risk_level = 'high' THEN 'Enable transaction notifications' END,
    CASE WHEN loyalty_score > 0.8 THEN 'Explore exclusive offers or discounts' END,
    CASE WHEN frequency_score > 0.8 THEN 'Consider setting monthly spending caps' END,
    CASE WHEN service_quality < 0.6 THEN 'Monitor service quality and consider alternatives' END], lambda x: x IS NOT NULL), '|') AS recommendations
FROM p""", ["estimated_savings"]))
def q_merchant_insights(spark, sf):
    return finish(M.insights(_profile(spark, sf)))


def _insight_sql(name, cond, figure):
    title, before, after, impact, confidence, advice, mitigation = M.INSIGHT_TEXTS[name]
    text = f"concat({S.q(before)}, {figure}, {S.q(after)})"
    savings = "avg_transaction_size * 0.15" if name == "pricing_optimization" else "CAST(NULL AS DOUBLE)"
    return (f"SELECT vpa, {S.q(name)} AS insight_type, {S.q(title)} AS title, {text} AS description, {impact!r} AS impact_score, "
            f"{confidence!r} AS confidence, {S.q(advice)} AS recommendation, {savings} AS estimated_savings, "
            f"{S.q(mitigation) if mitigation else 'CAST(NULL AS VARCHAR)'} AS risk_mitigation FROM p WHERE {cond}")


def _fixed_sql(x, digits):
    whole = f"CAST(round(round(CAST({x} AS DOUBLE), 6) * {10**digits}) AS BIGINT)"
    return f"concat({whole} // {10**digits}, '.', lpad(CAST({whole} % {10**digits} AS VARCHAR), {digits}, '0'))"


@register("merchant_insight_rows", rounded(BASE + " UNION ALL ".join(_insight_sql(*x) for x in (
    ("pricing_optimization", "pricing_fairness < 0.7", _fixed_sql("((1 - pricing_fairness) * 100)", 1)),
    ("spending_pattern", "frequency_score > 0.8", "''"),
    ("risk_warning", "risk_level IN ('high', 'critical')", _fixed_sql("trust_score", 2)),
    ("market_opportunity", "growth_trend > 0.5", "''"),
    ("service_warning", "service_quality < 0.6", _fixed_sql("service_quality", 2)))),
    ["impact_score", "confidence", "estimated_savings"]))
def q_merchant_insight_rows(spark, sf):
    return finish(M.insight_rows(_profile(spark, sf)))


_VPA = "split_part(vpa, chr(1), 2)"


@register("merchant_profile_by_user", rounded(BY_USER + f"""SELECT split_part(vpa, chr(1), 1) AS user_id, {_VPA} AS vpa,
  split_part({_VPA}, '@', 1) AS merchant_id, {_INITCAP.format(x=f"translate(split_part({_VPA}, '@', 1), '._', '  ')")} AS business_name,
  {', '.join(PROFILE_COLS[3:])} FROM p""", PROFILE_DBL))
def q_merchant_profile_by_user(spark, sf):
    """The profile per (user, VPA)."""
    t = pay(spark, sf)
    return finish(M.profile(t, M.market_averages(t), ["user_id", "vpa"]).select("user_id", *PROFILE_COLS))


@register("merchant_competition", rounded(BASE + """
SELECT vpa, category, percent_rank() OVER (PARTITION BY category ORDER BY total_volume) AS category_percentile,
  pricing_fairness AS price_competitiveness,
  CASE WHEN service_quality > 0.7 THEN 'Above Average' ELSE 'Below Average' END AS service_comparison,
  total_volume / sum(total_volume) OVER (PARTITION BY category) AS market_share_estimate
FROM p""", ["category_percentile", "price_competitiveness", "market_share_estimate"]))
def q_merchant_competition(spark, sf):
    # the market, the shares and the ranks read the merchants, not the payments
    p = cut_lineage(M.profile(pay(spark, sf), series=False).select(*M.COMPETITION_COLUMNS))
    return finish(M.competition(M.priced(p, M.market_averages(p))))


@register("merchant_behavior", BASE + f""", hc AS (SELECT vpa, hour({_TS}) AS hr, count(*) AS c FROM pay WHERE {_TS} IS NOT NULL GROUP BY ALL),
md AS (SELECT vpa, hr FROM (SELECT *, row_number() OVER (PARTITION BY vpa ORDER BY c DESC, hr) AS rn FROM hc) WHERE rn = 1)
SELECT p.vpa, md.hr AS modal_hour,
  CASE WHEN md.hr IS NULL THEN 'Unknown' WHEN md.hr BETWEEN 9 AND 17 THEN 'Regular business hours'
       WHEN md.hr BETWEEN 18 AND 22 THEN 'Evening' ELSE 'Late night or early morning' END AS transaction_timing,
  CASE WHEN cv < 0.5 THEN 'Consistent' ELSE 'Variable' END AS spending_consistency,
  CASE WHEN avg_transaction_size < 500 THEN 'Small amounts' WHEN avg_transaction_size < 5000 THEN 'Consistent medium amounts'
       ELSE 'Large amounts' END AS transaction_size_pattern,
  CASE WHEN mean_gap_days IS NULL THEN 'Single visit' WHEN mean_gap_days <= 1 THEN 'Daily' WHEN mean_gap_days <= 7 THEN 'Weekly regular'
       WHEN mean_gap_days <= 30 THEN 'Monthly' ELSE 'Occasional' END AS frequency_pattern
FROM p LEFT JOIN md USING (vpa)""")
def q_merchant_behavior(spark, sf):
    t = pay(spark, sf)
    return finish(M.behavior(t, M.profile(t, M.market_averages(t))))
