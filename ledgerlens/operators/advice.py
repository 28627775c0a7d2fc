"""Financial-advice tables (O1–O5, F13, F14): goal suggestions, goal
progress, request context, prompt texts, parsing of stored replies and the
fallback advice, all as joins and Column expressions per request."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import aggregates as A
from .nudges import fixed

# fixed values: defaults of the request context
DEFAULT_EXPENSES = 45000.0
DEFAULT_TXN_COUNT = 25
SAVINGS_RATE = 0.35
ACTION_MARKERS = ["1.", "2.", "3.", "•", "-", "step"]
FALLBACK = {
    "spending_review": (
        "Based on typical spending patterns, consider reviewing your discretionary expenses and focusing on "
        "building an emergency fund of 6-12 months of expenses.",
        ["Track your expenses for the next month", "Identify top 3 categories where you can reduce spending",
         "Set up an automated SIP for ₹5,000/month", "Use UPI apps to monitor real-time spending"]),
    "goal_setting": (
        "Start with building an emergency fund, then focus on long-term goals like home purchase or retirement "
        "through systematic investments.",
        ["Open a high-yield savings account for emergency fund", "Start SIP in diversified equity mutual funds",
         "Consider ELSS funds for tax saving under 80C", "Review and increase SIP amount annually"]),
}
# request routing by query words (our rule; first match wins)
CONTEXT_RULES = [("investment_advice", ["invest", "sip", "mutual", "stock"]),
                 ("goal_setting", ["goal", "save", "saving", "target"]),
                 ("debt_management", ["debt", "loan", "emi", "credit"])]


def context_type(query: Column) -> Column:
    from ..functions.text import first_match
    return first_match(F.lower(F.coalesce(query, F.lit(""))), CONTEXT_RULES, "spending_review")


def requests(conversations: DataFrame) -> DataFrame:
    """User turns are advice requests; the conversation is the user."""
    u = conversations.where(F.col("role") == "user")
    return u.select(F.col("conv_id").cast("string").alias("user_id"), "conv_id", "turn",
                    F.col("text").alias("query"), context_type(F.col("text")).alias("context_type"))


def goal_suggestions(profiles: DataFrame) -> DataFrame:
    """O1: emergency fund 6x income over 12 months; retirement 300x income
    over max(58 - age, 10) years at 0.6; home 60x income if age < 35 at 0.8."""
    inc, age = F.col("monthly_income"), F.col("age")
    yrs = F.greatest(F.lit(58) - age, F.lit(10))
    def goal(order, name, target, months, sip, prio):
        return F.struct(F.lit(order).alias("goal_order"), F.lit(name).alias("goal_name"),
                        target.cast("double").alias("target_amount"), months.cast("int").alias("timeline_months"),
                        sip.cast("double").alias("monthly_sip"), F.lit(prio).alias("priority"))
    goals = F.array(
        goal(0, "Emergency Fund", inc * 6, F.lit(12), inc * 6 / 12, "high"),
        goal(1, "Retirement Fund", inc * 12 * 25, yrs * 12, inc * 12 * 25 / (yrs * 12) * 0.6, "medium"),
        F.when(age < 35, goal(2, "Home Purchase", inc * 60, F.lit(60), inc * 60 / 60 * 0.8, "medium")))
    return profiles.select("user_id", F.inline(F.array_compact(goals)))


def goal_progress(goals: DataFrame) -> DataFrame:
    return goals.select("user_id", "goal_order", "name", "target_amount", "current_amount",
                        F.when(F.col("target_amount") > 0, F.col("current_amount") / F.col("target_amount") * 100)
                         .otherwise(0.0).alias("progress_pct"))


def advice_context(req: DataFrame, profiles: DataFrame, pay_t: DataFrame) -> DataFrame:
    """request ⋈ profile ⋈ payment features, with the cited defaults."""
    ua = A.user_aggregates(pay_t).select("user_id", "user_total_spent", "user_transaction_count")
    d = req.join(profiles, "user_id", "left").join(ua, "user_id", "left")
    return d.select("user_id", "conv_id", "turn", "context_type",
                    F.coalesce("monthly_income", F.lit(75000.0)).alias("monthly_income"),
                    F.coalesce("age", F.lit(28)).alias("age"), F.coalesce("dependents", F.lit(1)).alias("dependents"),
                    F.coalesce("risk_tolerance", F.lit("moderate")).alias("risk_tolerance"),
                    F.coalesce("user_total_spent", F.lit(DEFAULT_EXPENSES)).alias("monthly_expenses"),
                    F.coalesce("user_transaction_count", F.lit(DEFAULT_TXN_COUNT)).cast("long").alias("transaction_count"),
                    F.lit(SAVINGS_RATE).alias("savings_rate"))


def money0(c: Column) -> Column:
    """Whole rupees with thousands separators; rounded half up first, so the
    grouping step formats an integer (engine-independent text)."""
    return F.format_number(F.floor(c + 0.5).cast("long"), 0)


def prompts(ctx: DataFrame, goals: DataFrame, cat_spend: DataFrame, recent: DataFrame, req: DataFrame) -> DataFrame:
    """O3: one prompt text per request (profile, goals with progress, spend
    by category, last 5 transactions, query). Per-user lists are bounded:
    goals (<= 2), categories (a handful), recent rows (5)."""
    gl = goals.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "goal_order", F.concat(F.lit("- "), F.col("name"), F.lit(": ₹"), money0(F.col("current_amount")), F.lit(" / ₹"),
                               money0(F.col("target_amount")), F.lit(" ("),
                               fixed(F.col("current_amount") / F.col("target_amount") * 100, 1),
                               F.lit("% complete)")).alias("line")))), lambda x: x["line"]), "\n").alias("goal_lines"))
    cl = cat_spend.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "category", F.concat(F.lit("- "), F.initcap("category"), F.lit(": ₹"), money0(F.col("spent"))).alias("line")))),
        lambda x: x["line"]), "\n").alias("category_lines"))
    rl = recent.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        (-F.col("rank")).alias("o"), F.concat(F.lit("- ₹"), F.col("amount").cast("string"), F.lit(" at "),
                                               F.col("merchant_name"), F.lit(" ("), F.col("category"), F.lit(")")).alias("line")))),
        lambda x: x["line"]), "\n").alias("recent_lines"))
    d = (ctx.join(req.select("conv_id", "turn", "query"), ["conv_id", "turn"])
            .join(gl, "user_id", "left").join(cl, "user_id", "left").join(rl, "user_id", "left"))
    text = F.concat(
        F.lit("[system:base]\n[system:"), F.col("context_type"), F.lit("]\n\nUSER FINANCIAL PROFILE:\n- Monthly Income: ₹"),
        money0(F.col("monthly_income")), F.lit("\n- Monthly Expenses: ₹"), money0(F.col("monthly_expenses")),
        F.lit("\n- Savings Rate: 35.0%\n- Age: "), F.col("age").cast("string"), F.lit(" years\n- Dependents: "),
        F.col("dependents").cast("string"), F.lit("\n- Risk Tolerance: "), F.col("risk_tolerance"),
        F.lit("\n\nCURRENT FINANCIAL GOALS:\n"), F.coalesce("goal_lines", F.lit("")),
        F.lit("\n\nSPENDING BREAKDOWN (Monthly):\n"), F.coalesce("category_lines", F.lit("")),
        F.when(F.col("recent_lines").isNotNull(), F.concat(F.lit("\n\nRECENT TRANSACTIONS:\n"), F.col("recent_lines")))
         .otherwise(F.lit("")),
        F.lit("\n\nUSER QUERY: "), F.col("query"))
    return d.select("user_id", "conv_id", "turn", "context_type", text.alias("prompt"), F.length(text).alias("prompt_chars"))


def action_items(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def keep(line):
        low = F.lower(line)
        hit = F.lit(False)
        for mk in ACTION_MARKERS:
            hit = hit | low.contains(mk)
        return hit & (F.length(line) > 10)
    return F.slice(F.filter(lines, keep), 1, 5)


def parse_replies(replies: DataFrame) -> DataFrame:
    """JSON object replies -> fields with defaults (confidence 0.8);
    anything else -> the text itself, confidence 0.7, extracted steps."""
    v = F.expr("try_parse_json(text)")
    is_obj = v.isNotNull() & (F.expr("schema_of_variant(try_parse_json(text))").startswith("OBJECT"))
    j_adv = F.expr("try_variant_get(try_parse_json(text), '$.advice', 'string')")
    j_conf = F.expr("try_variant_get(try_parse_json(text), '$.confidence_score', 'double')")
    j_steps = F.expr("try_variant_get(try_parse_json(text), '$.actionable_steps', 'array<string>')")
    steps = F.when(is_obj, F.coalesce(j_steps, F.array().cast("array<string>"))).otherwise(action_items(F.col("text")))
    return replies.select(
        "conv_id", "turn", F.when(is_obj, F.coalesce(j_adv, F.col("text"))).otherwise(F.col("text")).alias("advice"),
        F.when(is_obj, F.coalesce(j_conf, F.lit(0.8))).otherwise(F.lit(0.7)).alias("confidence_score"),
        F.array_join(steps, "|").alias("actionable_steps"), F.size(steps).cast("long").alias("n_steps"),
        F.when(is_obj, "json").otherwise("text").alias("response_type"))


def fallback(req: DataFrame) -> DataFrame:
    """template by context type, default spending_review."""
    def pick(i):
        return (F.when(F.col("context_type") == "goal_setting", F.lit(FALLBACK["goal_setting"][i] if i == 0 else
                                                                       "|".join(FALLBACK["goal_setting"][1])))
                 .otherwise(F.lit(FALLBACK["spending_review"][i] if i == 0 else "|".join(FALLBACK["spending_review"][1]))))
    return req.select("user_id", "conv_id", "turn", "context_type", pick(0).alias("advice"),
                      F.lit(0.6).alias("confidence_score"), pick(1).alias("actionable_steps"))


# --- O5 ----------------------------------------------------------------------
def interactions(req: DataFrame) -> DataFrame:
    """One row per answered request (with ``asked_at``): what the advice log
    keeps of it, and the day that its folder is named after."""
    d = fallback(req).drop("actionable_steps").join(req.select("conv_id", "turn", "query", "asked_at"), ["conv_id", "turn"])
    return d.withColumnRenamed("advice", "advice_given").withColumn("day", F.to_date("asked_at"))


def write_log(log: DataFrame, path: str) -> str:
    """Store the interactions by day. A run replaces the days it has rows for
    and leaves the others, so a repeated run changes nothing."""
    log.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return path


def read_log(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_interactions(log: DataFrame) -> DataFrame:
    """The last interaction of each user and day, under its feature key."""
    last = log.groupBy("user_id", "day").agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.max_by(F.struct("query", "context_type", "advice_given", "confidence_score"), F.struct("asked_at", "conv_id", "turn")).alias("_l"))
    return last.select(F.concat(F.lit("advice_"), F.col("user_id"), F.lit("_"), F.date_format("day", "yyyyMMdd")).alias("feature_key"),
                       "user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_requests", "_l.*")
