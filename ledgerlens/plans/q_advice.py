"""Financial-advice tables over ``conversations`` (requests and stored
replies) joined with customer-derived profiles and ``pay`` spending."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advice as AD
from ..operators import aggregates as A
from ..sources.adapters import goals, pay, user_profiles
from ..sources.tables import table
from . import sqlx as S
from .common import finish, rounded
from .oracle_base import PAY, with_
from .q_nudges import CUST, GOALS, _fixed_sql
from .registry import register

_CTX_SQL = "CASE " + " ".join(f"WHEN {S.contains_any('lower(coalesce(text, \'\'))', kws)} THEN {S.q(lbl)}"
                             for lbl, kws in AD.CONTEXT_RULES) + " ELSE 'spending_review' END"
REQ = f"""req AS (SELECT CAST(conv_id AS VARCHAR) AS user_id, conv_id, turn, text AS query, {_CTX_SQL} AS context_type
  FROM conversations WHERE role = 'user')"""
PROF = """prof AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, 20000.0 + abs(c_acctbal) * 5 AS monthly_income,
   CAST(22 + c_custkey % 40 AS INTEGER) AS age, CAST(c_custkey % 4 AS INTEGER) AS dependents,
   CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'moderate' ELSE 'low' END AS risk_tolerance FROM customer)"""


def _req(spark, sf):
    return AD.requests(table(spark, sf, "conversations"))


@register("goal_suggestions", rounded(with_(PROF) + """
SELECT user_id, 0 AS goal_order, 'Emergency Fund' AS goal_name, monthly_income * 6 AS target_amount, 12 AS timeline_months,
  monthly_income * 6 / 12 AS monthly_sip, 'high' AS priority FROM prof
UNION ALL SELECT user_id, 1, 'Retirement Fund', monthly_income * 12 * 25, greatest(58 - age, 10) * 12,
  monthly_income * 12 * 25 / (greatest(58 - age, 10) * 12) * 0.6, 'medium' FROM prof
UNION ALL SELECT user_id, 2, 'Home Purchase', monthly_income * 60, 60, monthly_income * 60 / 60 * 0.8, 'medium' FROM prof WHERE age < 35""",
    ["target_amount", "monthly_sip"]))
def q_goal_suggestions(spark, sf):
    return finish(AD.goal_suggestions(user_profiles(spark, sf)))


@register("goal_progress", rounded(with_(CUST, GOALS) + """
SELECT user_id, goal_order, name, target_amount, current_amount,
  CASE WHEN target_amount > 0 THEN current_amount / target_amount * 100 ELSE 0.0 END AS progress_pct FROM goals""",
    ["target_amount", "current_amount", "progress_pct"]))
def q_goal_progress(spark, sf):
    return finish(AD.goal_progress(goals(spark, sf)))


CTX = [REQ, PROF, """ua AS (SELECT user_id, sum(amount) AS user_total_spent, count(amount) AS user_transaction_count FROM pay GROUP BY user_id)""",
       """ctx AS (SELECT r.user_id, r.conv_id, r.turn, r.context_type, coalesce(p.monthly_income, 75000.0) AS monthly_income,
   coalesce(p.age, 28) AS age, coalesce(p.dependents, 1) AS dependents, coalesce(p.risk_tolerance, 'moderate') AS risk_tolerance,
   coalesce(ua.user_total_spent, 45000.0) AS monthly_expenses, CAST(coalesce(ua.user_transaction_count, 25) AS BIGINT) AS transaction_count,
   0.35 AS savings_rate FROM req r LEFT JOIN prof p USING (user_id) LEFT JOIN ua USING (user_id))"""]


def _ctx(spark, sf):
    return AD.advice_context(_req(spark, sf), user_profiles(spark, sf), pay(spark, sf))


@register("advice_context", rounded(with_(PAY, *CTX) + "SELECT * FROM ctx", ["monthly_income", "monthly_expenses", "savings_rate"]))
def q_advice_context(spark, sf):
    return finish(_ctx(spark, sf))


def _m0(x):
    return f"format('{{:,}}', CAST(floor({x} + 0.5) AS BIGINT))"


PROMPT_SQL = with_(PAY, *CTX, CUST, GOALS,
    f"""gl AS (SELECT user_id, string_agg('- ' || name || ': ₹' || {_m0('current_amount')} || ' / ₹' || {_m0('target_amount')} || ' (' ||
     {_fixed_sql('current_amount / target_amount * 100', 1)} || '% complete)', chr(10) ORDER BY goal_order) AS goal_lines FROM goals GROUP BY user_id)""",
    f"""cs AS (SELECT user_id, coalesce(category, 'other') AS category, sum(amount) AS spent FROM pay GROUP BY ALL)""",
    f"""cl AS (SELECT user_id, string_agg('- ' || upper(category[1]) || lower(category[2:]) || ': ₹' || {_m0('spent')}, chr(10) ORDER BY category) AS category_lines
     FROM cs GROUP BY user_id)""",
    """rt AS (SELECT * FROM (SELECT user_id, amount, merchant_name, category, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, transaction_id DESC) AS rank FROM pay) WHERE rank <= 5)""",
    """rl AS (SELECT user_id, string_agg('- ₹' || CAST(amount AS VARCHAR) || ' at ' || merchant_name || ' (' || category || ')', chr(10) ORDER BY rank DESC) AS recent_lines
     FROM rt GROUP BY user_id)""") + f"""
SELECT c.user_id, c.conv_id, c.turn, c.context_type, prompt, length(prompt) AS prompt_chars FROM (
  SELECT c.*, '[system:base]' || chr(10) || '[system:' || c.context_type || ']' || chr(10) || chr(10) || 'USER FINANCIAL PROFILE:' || chr(10) ||
    '- Monthly Income: ₹' || {_m0('c.monthly_income')} || chr(10) || '- Monthly Expenses: ₹' || {_m0('c.monthly_expenses')} || chr(10) ||
    '- Savings Rate: 35.0%' || chr(10) || '- Age: ' || CAST(c.age AS VARCHAR) || ' years' || chr(10) || '- Dependents: ' ||
    CAST(c.dependents AS VARCHAR) || chr(10) || '- Risk Tolerance: ' || c.risk_tolerance || chr(10) || chr(10) ||
    'CURRENT FINANCIAL GOALS:' || chr(10) || coalesce(gl.goal_lines, '') || chr(10) || chr(10) || 'SPENDING BREAKDOWN (Monthly):' || chr(10) ||
    coalesce(cl.category_lines, '') || CASE WHEN rl.recent_lines IS NOT NULL THEN chr(10) || chr(10) || 'RECENT TRANSACTIONS:' || chr(10) || rl.recent_lines ELSE '' END ||
    chr(10) || chr(10) || 'USER QUERY: ' || r.query AS prompt
  FROM ctx c JOIN req r USING (conv_id, turn) LEFT JOIN gl ON gl.user_id = c.user_id LEFT JOIN cl ON cl.user_id = c.user_id
  LEFT JOIN rl ON rl.user_id = c.user_id) c"""


@register("advice_prompts", PROMPT_SQL)
def q_advice_prompts(spark, sf):
    p = pay(spark, sf)
    cs = p.groupBy("user_id", F.coalesce("category", F.lit("other")).alias("category")).agg(F.sum("amount").alias("spent"))
    recent = A.top_k(p.select("user_id", "transaction_id", "timestamp", "amount", "merchant_name", "category"), ["user_id"],
                     [F.col("timestamp").desc(), F.col("transaction_id").desc()], 5)
    return finish(AD.prompts(_ctx(spark, sf), goals(spark, sf), cs, recent, _req(spark, sf)))


_LINES = "list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
_KEEP = "(" + " OR ".join(f"contains(lower(x), {S.q(m)})" for m in AD.ACTION_MARKERS) + ") AND length(x) > 10"


@register("advice_parse", rounded(f"""
SELECT conv_id, turn, CASE WHEN obj THEN coalesce(j_adv, text) ELSE text END AS advice,
  CASE WHEN obj THEN coalesce(j_conf, 0.8) ELSE 0.7 END AS confidence_score,
  array_to_string(steps, '|') AS actionable_steps, CAST(len(steps) AS BIGINT) AS n_steps,
  CASE WHEN obj THEN 'json' ELSE 'text' END AS response_type
FROM (SELECT *, CASE WHEN obj THEN coalesce(j_steps, []) ELSE list_slice(list_filter({_LINES}, lambda x: {_KEEP}), 1, 5) END AS steps FROM (
  SELECT conv_id, turn, text, coalesce(CASE WHEN json_valid(text) THEN json_type(text) = 'OBJECT' ELSE FALSE END, FALSE) AS obj,
    CASE WHEN json_valid(text) THEN json_extract_string(text, '$.advice') END AS j_adv,
    CASE WHEN json_valid(text) THEN TRY_CAST(json_extract(text, '$.confidence_score') AS DOUBLE) END AS j_conf,
    CASE WHEN json_valid(text) THEN TRY_CAST(json_extract(text, '$.actionable_steps') AS VARCHAR[]) END AS j_steps
  FROM conversations WHERE role = 'assistant'))""", ["confidence_score"]))
def q_advice_parse(spark, sf):
    replies = table(spark, sf, "conversations").where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    return finish(AD.parse_replies(replies))


@register("advice_fallback", rounded(with_(REQ) + f"""
SELECT user_id, conv_id, turn, context_type,
  CASE WHEN context_type = 'goal_setting' THEN {S.q(AD.FALLBACK['goal_setting'][0])} ELSE {S.q(AD.FALLBACK['spending_review'][0])} END AS advice,
  0.6 AS confidence_score,
  CASE WHEN context_type = 'goal_setting' THEN {S.q('|'.join(AD.FALLBACK['goal_setting'][1]))} ELSE {S.q('|'.join(AD.FALLBACK['spending_review'][1]))} END AS actionable_steps
FROM req""", ["confidence_score"]))
def q_advice_fallback(spark, sf):
    return finish(AD.fallback(_req(spark, sf)))
