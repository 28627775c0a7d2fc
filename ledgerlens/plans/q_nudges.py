"""Psychology profile and nudges (N1–N12) on ``txn`` with customer-derived
budgets and goals. Every ``txn`` row is a proposed purchase evaluated
against the whole history."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import nudges as N
from ..sources.adapters import budgets, goals, txn
from . import sqlx as S
from .common import finish, rounded
from .oracle_base import TXN, with_
from .registry import register

_TS = '"timestamp"'
_M2 = "fx2({x})"


def _fixed_sql(x, places):
    sc = 10 ** places
    pos = lambda v: (f"(CAST(CAST(floor(({v}) * {sc} + 0.5) AS BIGINT) // {sc} AS VARCHAR) || '.' || "  # noqa: E731
                     f"lpad(CAST(CAST(floor(({v}) * {sc} + 0.5) AS BIGINT) % {sc} AS VARCHAR), {places}, '0'))")
    return f"(CASE WHEN ({x}) < 0 THEN '-' || {pos('-(' + x + ')')} ELSE {pos(x)} END)"


CUST = """cust AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, 20000.0 + abs(c_acctbal) * 5 AS monthly_income,
   c_acctbal AS acctbal, c_mktsegment AS segment FROM customer)"""
GOALS = """goals AS (SELECT user_id, 0 AS goal_order, 'Emergency Fund' AS name, 'savings' AS type, CAST(NULL AS VARCHAR) AS category,
   monthly_income * 6 AS target_amount, greatest(acctbal, 0.0) AS current_amount, DATE '2024-12-31' AS target_date FROM cust
  UNION ALL SELECT user_id, 1, 'Home Upgrade', 'purchase', 'purchase', 50000.0, greatest(acctbal, 0.0) / 2, DATE '2025-06-30'
  FROM cust WHERE segment = 'BUILDING')"""
BUDGETS = """budgets AS (SELECT uc.user_id, uc.category, greatest(100.0, abs(c.c_acctbal) / 10) AS "limit" FROM
  (SELECT DISTINCT user_id, coalesce(category, 'other') AS category FROM txn) uc JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = uc.user_id)"""
PSYCH = [
    f"""d AS (SELECT user_id, amount, coalesce(category, 'other') AS cat, type,
   strftime(coalesce({_TS}, TIMESTAMP '2024-01-01'), '%Y-%m') AS month, strftime(coalesce({_TS}, TIMESTAMP '2024-01-01'), '%Y-%m-%d') AS day,
   CAST(isodow(coalesce({_TS}, TIMESTAMP '2024-01-01')) - 1 >= 5 AS DOUBLE) AS wk FROM txn)""",
    """u AS (SELECT user_id, count(*) AS n, avg(CAST(type = 'refund' AS DOUBLE)) AS ref, avg(wk) AS wkr, count(DISTINCT cat) AS ncat FROM d GROUP BY user_id)""",
    """mon AS (SELECT user_id, month, count(*) AS c, avg(amount) AS mu, stddev_pop(amount) AS sd FROM d GROUP BY ALL)""",
    """com AS (SELECT user_id, avg(1 - least(1.0, CASE WHEN mu > 0 THEN sd / mu ELSE 1.0 END)) AS com FROM mon WHERE c > 1 GROUP BY user_id)""",
    """dy AS (SELECT user_id, day, count(*) AS dc FROM d GROUP BY ALL)""",
    """ds AS (SELECT user_id, avg(dc) AS dmu, stddev_pop(dc) AS dsd, count(*) AS nd FROM dy GROUP BY user_id)""",
    """sp AS (SELECT dy.user_id, any_value(nd) AS nd, count(*) FILTER (WHERE dc > dmu + 2 * dsd) AS sp FROM dy JOIN ds USING (user_id) GROUP BY dy.user_id)""",
    """ct AS (SELECT user_id, cat, count(*) AS c, avg(amount) AS mu, stddev_pop(amount) AS sd FROM d GROUP BY ALL)""",
    """anc AS (SELECT user_id, avg(CASE WHEN mu > 0 THEN sd / mu ELSE 0.0 END) AS anc FROM ct WHERE c > 3 GROUP BY user_id)""",
    """psych AS (SELECT u.user_id, n AS transaction_count,
   CASE WHEN n > 10 THEN least(1.0, ref * 3) ELSE 0.5 END AS loss_aversion_sensitivity,
   CASE WHEN n > 20 THEN least(1.0, ncat / least(n, 10)) ELSE 0.5 END AS social_influence_susceptibility,
   coalesce(com.com, 0.5) AS commitment_tendency, wkr AS temporal_preference,
   CASE WHEN anc.anc IS NOT NULL THEN 1 - least(1.0, anc.anc) ELSE 0.5 END AS anchoring_susceptibility,
   0.5 AS risk_tolerance, least(1.0, sp.sp / sp.nd * 5) AS spending_impulsiveness
  FROM u LEFT JOIN com USING (user_id) LEFT JOIN sp USING (user_id) LEFT JOIN anc USING (user_id))""",
]
CTX = [
    f"""mt AS (SELECT user_id, coalesce(category, 'other') AS category, strftime({_TS}, '%Y-%m') AS month, sum(amount) AS mtot FROM txn GROUP BY ALL)""",
    """peer AS (SELECT coalesce(category, 'other') AS category, avg(amount) AS peer_average, quantile_cont(amount, 0.1) AS top_10_percent FROM txn GROUP BY 1)""",
    """anch AS (SELECT user_id, coalesce(category, 'other') AS category, avg(amount) AS user_average, quantile_cont(amount, 0.5) AS user_typical,
   max(amount) AS user_maximum FROM txn GROUP BY ALL)""",
    f"""p AS (SELECT transaction_id AS proposal_id, user_id, amount, coalesce(category, 'other') AS category, merchant_name AS merchant,
   strftime({_TS}, '%Y-%m') AS month FROM txn)""",
    """c AS (SELECT p.*, coalesce(mt.mtot - p.amount, 0.0) AS spent, coalesce(b."limit", 0.0) AS budget,
   ps.loss_aversion_sensitivity, ps.social_influence_susceptibility, ps.commitment_tendency, ps.temporal_preference,
   ps.anchoring_susceptibility, ps.risk_tolerance, ps.spending_impulsiveness,
   peer.peer_average, peer.top_10_percent, an.user_average, an.user_typical, an.user_maximum
  FROM p LEFT JOIN mt USING (user_id, category, month) LEFT JOIN budgets b USING (user_id, category)
  LEFT JOIN psych ps USING (user_id) LEFT JOIN peer USING (category) LEFT JOIN anch an USING (user_id, category))""",
]


def tmpl_sql(ntype, which, inten, **subs):
    subs = {k: (_fixed_sql(v[4:-1], 2) if v.startswith("fx2(") else v) for k, v in subs.items()}
    parts = []
    for i in ("gentle", "moderate", "strong"):
        text = S.q(N.TEMPLATES[(ntype, i)][which])
        for k, v in subs.items():
            text = f"replace({text}, {S.q('{' + k + '}')}, {v})"
        parts.append(f"WHEN {S.q(i)} THEN {text}")
    return f"CASE {inten} " + " ".join(parts) + " END"


_LOSS_INT = ("CASE WHEN ov > budget * 0.5 THEN 'strong' WHEN ov > budget * 0.2 THEN 'moderate' ELSE 'gentle' END")
NUDGES = [
    f"""n_loss AS (SELECT proposal_id, user_id, 'loss_aversion' AS nudge_type, it AS intensity, loss_aversion_sensitivity * 0.9 AS confidence,
   CASE WHEN it = 'strong' THEN 'Skip this purchase' ELSE 'Delay purchase for 24 hours' END AS recommended_action, 0 AS goal_order,
   {tmpl_sql('loss_aversion', 0, 'it', amount=_M2.format(x='amount'), overspend=_M2.format(x='ov'), category='category', total_impact=_M2.format(x='amount * 2'))} AS message,
   ov AS overspend_amount, CASE WHEN budget > 0 THEN (spent + amount) / budget ELSE 0.0 END AS budget_utilization
  FROM (SELECT *, {_LOSS_INT} AS it FROM (SELECT *, CASE WHEN budget > 0 THEN greatest(0.0, spent + amount - budget) ELSE 0.0 END AS ov FROM c))
  WHERE loss_aversion_sensitivity > 0.3)""",
    f"""n_social AS (SELECT proposal_id, user_id, 'social_proof' AS nudge_type, it AS intensity, social_influence_susceptibility * 0.85 AS confidence,
   'Compare with similar users before purchasing' AS recommended_action, 0 AS goal_order,
   CASE WHEN dev > 0 THEN {tmpl_sql('social_proof', 1, 'it', benchmark=_M2.format(x='peer'), category='category', percentage='CAST(CAST(trunc(dev * 100) AS BIGINT) AS VARCHAR)')}
        ELSE {tmpl_sql('social_proof', 0, 'it', category='category')} END AS message,
   peer AS peer_average, dev AS user_vs_peer_deviation, coalesce(top_10_percent, amount * 0.5) AS top_savers_benchmark
  FROM (SELECT *, CASE WHEN dev > 1.0 THEN 'strong' WHEN dev > 0.5 THEN 'moderate' ELSE 'gentle' END AS it FROM (
    SELECT *, CASE WHEN peer > 0 THEN (amount - peer) / peer ELSE 0.0 END AS dev FROM (SELECT *, coalesce(peer_average, amount * 0.8) AS peer FROM c)))
  WHERE social_influence_susceptibility > 0.3)""",
    f"""n_mental AS (SELECT proposal_id, user_id, 'mental_accounting' AS nudge_type, it AS intensity, 0.8 AS confidence,
   CASE WHEN it = 'gentle' THEN 'Review budget allocation' ELSE 'Reallocate from another category' END AS recommended_action, 0 AS goal_order,
   {tmpl_sql('mental_accounting', 0, 'it', amount=_M2.format(x='amount'), category='category', other_category="'savings'", allocated=_M2.format(x='budget'), violation=_M2.format(x='viol'))} AS message,
   util AS budget_utilization, viol AS budget_violation
  FROM (SELECT *, CASE WHEN util > 1.2 THEN 'strong' WHEN util > 1.0 THEN 'moderate' ELSE 'gentle' END AS it FROM (
    SELECT *, (spent + amount) / budget AS util, greatest(0.0, spent + amount - budget) AS viol FROM c WHERE budget > 0)))""",
    f"""n_commit AS (SELECT proposal_id, user_id, 'commitment_device' AS nudge_type, it AS intensity, commitment_tendency * 0.9 AS confidence,
   'Review your commitment before proceeding' AS recommended_action, goal_order,
   {tmpl_sql('commitment_device', 0, 'it', goal_amount=_M2.format(x='target_amount'), date='CAST(target_date AS VARCHAR)', category='c_category')} AS message,
   delay AS delay_days, CASE WHEN target_amount > 0 THEN current_amount / target_amount * 100 ELSE 0.0 END AS progress_percentage
  FROM (SELECT *, CASE WHEN delay > 7 THEN 'strong' ELSE 'moderate' END AS it FROM (
    SELECT c.proposal_id, c.user_id, c.category AS c_category, c.commitment_tendency, g.goal_order, g.target_amount, g.current_amount, g.target_date,
      CAST(CASE WHEN g.target_amount - g.current_amount > 0 THEN floor(c.amount / (g.target_amount - g.current_amount) * 30) ELSE 0 END AS BIGINT) AS delay
    FROM c JOIN goals g ON g.user_id = c.user_id AND (g.category = c.category OR g.type = 'savings')
    WHERE c.commitment_tendency > 0.2)))""",
    f"""n_temporal AS (SELECT proposal_id, user_id, 'temporal_discounting' AS nudge_type, it AS intensity, (1 - temporal_preference) * 0.8 AS confidence,
   'Wait 24 hours to reduce temporal bias' AS recommended_action, 0 AS goal_order,
   {tmpl_sql('temporal_discounting', 0, 'it', amount=_M2.format(x='amount'), opportunity_cost=_M2.format(x='f1 - amount'), future_value=_M2.format(x='f6'))} AS message,
   f6 AS future_value_6m, f1 AS future_value_1y, f10 AS future_value_10y, f1 - amount AS opportunity_cost
  FROM (SELECT *, amount * 1.06 AS f6, amount * 1.12 AS f1, amount * pow(1.12, 10) AS f10,
    CASE WHEN temporal_preference > 0.7 THEN 'strong' WHEN temporal_preference > 0.5 THEN 'moderate' ELSE 'gentle' END AS it FROM c
    WHERE temporal_preference > 0.4))""",
    f"""n_anch AS (SELECT proposal_id, user_id, 'anchoring' AS nudge_type, it AS intensity, anchoring_susceptibility * 0.7 AS confidence,
   'Compare with your typical spending pattern' AS recommended_action, 0 AS goal_order,
   {tmpl_sql('anchoring', 0, 'it', anchor_amount=_M2.format(x='user_typical'), category='category', amount=_M2.format(x='amount'),
             multiplier=_fixed_sql("CASE WHEN user_average > 0 THEN amount / user_average ELSE 1.0 END", 1),
             extreme_multiplier=_fixed_sql("amount / user_average", 1))} AS message,
   user_average, user_typical, user_maximum, dev AS deviation_from_average, tdev AS deviation_from_typical
  FROM (SELECT *, CASE WHEN dev > 2.0 THEN 'strong' WHEN dev > 0.5 THEN 'moderate' ELSE 'gentle' END AS it FROM (
    SELECT *, CASE WHEN user_average > 0 THEN (amount - user_average) / user_average ELSE 0.0 END AS dev,
      CASE WHEN user_typical > 0 THEN (amount - user_typical) / user_typical ELSE 0.0 END AS tdev FROM c
    WHERE anchoring_susceptibility > 0.3 AND user_average IS NOT NULL)))""",
]
_COMMON = "proposal_id, user_id, nudge_type, intensity, confidence, recommended_action, goal_order, message"
ALL = f"""allz AS (SELECT a.*, 
   {' '.join([])}CASE nudge_type WHEN 'loss_aversion' THEN 0.9 WHEN 'social_proof' THEN 0.8 WHEN 'mental_accounting' THEN 0.85
     WHEN 'commitment_device' THEN 0.75 WHEN 'temporal_discounting' THEN 0.7 ELSE 0.65 END
   * CASE nudge_type WHEN 'loss_aversion' THEN ps.loss_aversion_sensitivity WHEN 'social_proof' THEN ps.social_influence_susceptibility
     WHEN 'commitment_device' THEN ps.commitment_tendency WHEN 'temporal_discounting' THEN 1 - ps.temporal_preference
     WHEN 'anchoring' THEN ps.anchoring_susceptibility ELSE 1.0 END
   * CASE intensity WHEN 'gentle' THEN 0.8 WHEN 'moderate' THEN 1.0 ELSE 1.2 END * confidence AS effectiveness_score,
   CASE nudge_type WHEN 'loss_aversion' THEN 0 WHEN 'social_proof' THEN 1 WHEN 'mental_accounting' THEN 2 WHEN 'commitment_device' THEN 3
     WHEN 'temporal_discounting' THEN 4 ELSE 5 END AS type_order
  FROM (SELECT {_COMMON} FROM n_loss UNION ALL SELECT {_COMMON} FROM n_social UNION ALL SELECT {_COMMON} FROM n_mental
        UNION ALL SELECT {_COMMON} FROM n_commit UNION ALL SELECT {_COMMON} FROM n_temporal UNION ALL SELECT {_COMMON} FROM n_anch) a
  JOIN psych ps USING (user_id))"""

BASE_SQL = with_(TXN, CUST, GOALS, BUDGETS, *PSYCH, *CTX, *NUDGES, ALL)


def _ctx(spark, sf):
    t = txn(spark, sf)
    prof = N.psych_profile(t)
    props = t.select(F.col("transaction_id").alias("proposal_id"), "user_id", "amount", "category",
                     F.col("merchant_name").alias("merchant"), "timestamp")
    return N.context(t, props, budgets(spark, sf, t), prof)


_TRAITS = N.TRAITS


@register("psych_profile", rounded(BASE_SQL + f"SELECT user_id, transaction_count, {', '.join(_TRAITS)} FROM psych", _TRAITS))
def q_psych_profile(spark, sf):
    return finish(N.psych_profile(txn(spark, sf)))


@register("psych_insights", rounded(BASE_SQL + """SELECT user_id,
  array_to_string(list_filter([
    CASE WHEN loss_aversion_sensitivity > 0.7 THEN 'High loss aversion - responds well to savings-focused messaging'
         WHEN loss_aversion_sensitivity < 0.3 THEN 'Low loss aversion - may need stronger financial guardrails' END,
    CASE WHEN social_influence_susceptibility > 0.7 THEN 'Highly influenced by social proof - peer comparisons are effective'
         WHEN social_influence_susceptibility < 0.3 THEN 'Less influenced by others - focus on personal goals' END,
    CASE WHEN spending_impulsiveness > 0.7 THEN 'High impulsiveness - benefits from delayed gratification techniques'
         WHEN spending_impulsiveness < 0.3 THEN 'Low impulsiveness - already shows good self-control' END,
    CASE WHEN commitment_tendency > 0.7 THEN 'High commitment tendency - commitment devices will be effective'
         WHEN commitment_tendency < 0.3 THEN 'Low commitment tendency - may need external accountability' END], lambda x: x IS NOT NULL), '|') AS insights,
  array_to_string(list_filter([CASE WHEN loss_aversion_sensitivity > 0.5 THEN 'loss_aversion' END,
    CASE WHEN social_influence_susceptibility > 0.5 THEN 'social_proof' END, CASE WHEN commitment_tendency > 0.5 THEN 'commitment_device' END,
    CASE WHEN temporal_preference > 0.6 THEN 'temporal_discounting' END], lambda x: x IS NOT NULL), ',') AS recommended_nudge_types,
  transaction_count, least(1.0, transaction_count / 50.0) AS analysis_confidence,
  CASE WHEN transaction_count < 20 THEN 'Collect more transaction data for better analysis' ELSE 'Sufficient data for reliable analysis' END AS analysis_recommendation
FROM psych""", ["analysis_confidence"]))
def q_psych_insights(spark, sf):
    return finish(N.psych_insights(N.psych_profile(txn(spark, sf))))


def _reg_family(key, cte, fn, cols, dbl):
    @register(key, rounded(BASE_SQL + f"SELECT {', '.join(cols)} FROM {cte}", dbl))
    def q(spark, sf):
        return finish(fn(spark, sf).select(*cols))
    return q


_LOSS = ["proposal_id", "user_id", "intensity", "confidence", "recommended_action", "message", "overspend_amount", "budget_utilization"]
_reg_family("nudge_loss_aversion", "n_loss", lambda s, f: N.loss_aversion(_ctx(s, f)), _LOSS,
            ["confidence", "overspend_amount", "budget_utilization"])
_SOC = ["proposal_id", "user_id", "intensity", "confidence", "message", "peer_average", "user_vs_peer_deviation", "top_savers_benchmark"]
_reg_family("nudge_social_proof", "n_social", lambda s, f: N.social_proof(_ctx(s, f)), _SOC,
            ["confidence", "peer_average", "user_vs_peer_deviation", "top_savers_benchmark"])
_MEN = ["proposal_id", "user_id", "intensity", "confidence", "recommended_action", "message", "budget_utilization", "budget_violation"]
_reg_family("nudge_budget", "n_mental", lambda s, f: N.mental_accounting(_ctx(s, f)), _MEN,
            ["confidence", "budget_utilization", "budget_violation"])
_COM = ["proposal_id", "user_id", "goal_order", "intensity", "confidence", "message", "delay_days", "progress_percentage"]
_reg_family("nudge_commitment", "n_commit", lambda s, f: N.commitment(_ctx(s, f), goals(s, f)), _COM,
            ["confidence", "progress_percentage"])
_TMP = ["proposal_id", "user_id", "intensity", "confidence", "message", "future_value_6m", "future_value_1y",
        "future_value_10y", "opportunity_cost"]
_reg_family("nudge_temporal", "n_temporal", lambda s, f: N.temporal(_ctx(s, f)), _TMP,
            ["confidence", "future_value_6m", "future_value_1y", "future_value_10y", "opportunity_cost"])
_ANC = ["proposal_id", "user_id", "intensity", "confidence", "message", "user_average", "user_typical", "user_maximum",
        "deviation_from_average", "deviation_from_typical"]
_reg_family("nudge_anchoring", "n_anch", lambda s, f: N.anchoring(_ctx(s, f)), _ANC,
            ["confidence", "user_average", "user_typical", "user_maximum", "deviation_from_average", "deviation_from_typical"])


def _all(spark, sf):
    return N.all_nudges(_ctx(spark, sf), goals(spark, sf))


@register("nudge_messages", BASE_SQL + "SELECT proposal_id, nudge_type, goal_order, intensity, message FROM allz")
def q_nudge_messages(spark, sf):
    return finish(_all(spark, sf).select("proposal_id", "nudge_type", "goal_order", "intensity", "message"))


_REC = ("CASE WHEN top1 = 'loss_aversion' THEN 'Consider the long-term impact on your financial goals|Wait 24 hours before making this purchase' "
        "WHEN top1 = 'social_proof' THEN 'Compare with similar users'' spending patterns|Consider what financially successful people would do' "
        "WHEN top1 = 'mental_accounting' THEN 'Review your budget allocation for this category|Consider reallocating from another category' ELSE '' END")


@register("nudge_ranking", rounded(BASE_SQL + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY effectiveness_score DESC, type_order, goal_order) AS rank FROM allz),
top AS (SELECT proposal_id, nudge_type AS top1 FROM rk WHERE rank = 1)
SELECT rk.proposal_id, CAST(rank AS INTEGER) AS rank, nudge_type, intensity, goal_order, effectiveness_score, confidence, {_REC} AS top_recommendations
FROM rk JOIN top USING (proposal_id) WHERE rank <= 3""", ["effectiveness_score", "confidence"]))
def q_nudge_ranking(spark, sf):
    r = N.ranked(_all(spark, sf))
    top = r.where("rank = 1").select("proposal_id", N.recommendations(F.col("nudge_type")).alias("top_recommendations"))
    return finish(r.join(top, "proposal_id").select("proposal_id", F.col("rank").cast("int").alias("rank"), "nudge_type",
                                                    "intensity", "goal_order", "effectiveness_score", "confidence",
                                                    "top_recommendations"))


AS_OF = "2024-02-01T00:00:00"


@register("nudge_analytics", rounded(BASE_SQL + f""", rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id
   ORDER BY effectiveness_score DESC, type_order, goal_order) AS rank FROM allz) WHERE rank <= 3),
nx AS (SELECT transaction_id AS proposal_id, amount, "timestamp", lead("timestamp") OVER (PARTITION BY user_id ORDER BY "timestamp", transaction_id) AS next_ts FROM txn),
lg AS (SELECT rk.user_id, rk.nudge_type, CASE WHEN next_ts IS NULL OR (epoch_us(next_ts) - epoch_us(nx."timestamp")) / 3600000000.0 > 24
   THEN 'delayed' ELSE 'purchased' END AS user_action, amount, nx."timestamp" FROM rk JOIN nx USING (proposal_id)),
w AS (SELECT *, CASE WHEN user_action = 'delayed' THEN amount ELSE 0.0 END AS amount_saved FROM lg
   WHERE "timestamp" >= TIMESTAMP '{AS_OF.replace('T', ' ')}' - INTERVAL 30 DAY AND "timestamp" < TIMESTAMP '{AS_OF.replace('T', ' ')}'),
bt AS (SELECT user_id, nudge_type, count(*) FILTER (WHERE user_action = 'delayed') AS f FROM w GROUP BY ALL),
best AS (SELECT user_id, arg_min(nudge_type, (-f, nudge_type)) AS most_effective_nudge_type FROM bt GROUP BY user_id)
SELECT user_id, 30 AS period_days, count(*) AS total_nudges_shown, count(*) FILTER (WHERE user_action = 'delayed') AS nudges_followed,
  count(*) FILTER (WHERE user_action = 'delayed') / count(*) AS effectiveness_rate, sum(amount_saved) AS money_saved,
  any_value(most_effective_nudge_type) AS most_effective_nudge_type
FROM w JOIN best USING (user_id) GROUP BY user_id""", ["effectiveness_rate", "money_saved"]))
def q_nudge_analytics(spark, sf):
    t = txn(spark, sf)
    props = t.select(F.col("transaction_id").alias("proposal_id"), "user_id", "amount", "timestamp")
    r = N.ranked(_all(spark, sf)).select("proposal_id", "user_id", "nudge_type", "intensity", "confidence")
    log = N.nudge_log(r.drop("user_id").join(props.select("proposal_id", "user_id"), "proposal_id"), props)
    return finish(N.nudge_analytics(log, AS_OF, 30))
