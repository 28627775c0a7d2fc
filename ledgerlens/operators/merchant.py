"""Merchant profile, risk, quality and insight operators (M1–M19), one row
per merchant VPA (or per any key list, e.g. (user_id, vpa) for the
per-user view), computed for every merchant in one job."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import time as T
from . import aggregates as A
from .ranking import group_ranks

# fixed values: title, description around its figure, impact, confidence,
# recommendation and risk mitigation per insight
INSIGHT_TEXTS = {
    "pricing_optimization": ("Overpriced Merchant Detected", "This merchant charges ", "% above market average", 0.8, 0.9,
                             "Consider finding alternative merchants or negotiate pricing", None),
    "spending_pattern": ("High-Frequency Merchant", "You transact with this merchant very frequently", "", 0.7, 0.95,
                         "Consider setting up automatic caps or budgets for this merchant", "Monitor for overspending patterns"),
    "risk_warning": ("High-Risk Merchant Alert", "This merchant has elevated risk indicators (Trust Score: ", ")", 0.9, 0.85,
                     "Exercise caution and monitor transactions closely", "Consider transaction limits and increased verification"),
    "market_opportunity": ("Growing Business Opportunity", "This merchant shows strong growth patterns", "", 0.6, 0.8,
                           "Potential for loyalty programs or bulk discounts", None),
    "service_warning": ("Service Quality Concern", "Service quality indicators below average (", ")", 0.7, 0.8,
                        "Monitor service quality and consider alternatives", "Document any service issues for dispute resolution"),
}
RISK_ADJ = {"low": 0.1, "medium": 0.0, "high": -0.2, "critical": -0.4}


def _clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def market_averages(t: DataFrame) -> DataFrame:
    """``market(category, average_transaction)``: mean amount per merchant
    business category over all rows (the peer benchmark the fairness test
    compares against). ``t`` are payments, or their ``profile`` per VPA."""
    mean = F.avg("amount") if "amount" in t.columns else F.when(F.sum("_n_paid") > 0, F.sum("total_volume") / F.sum("_n_paid"))
    return (t.withColumn("category", X.merchant_business_category("vpa"))
             .groupBy("category").agg(mean.alias("average_transaction")))


def profile(t: DataFrame, market: DataFrame | None = None, key: str | list[str] = "vpa", series: bool = True) -> DataFrame:
    """One row per ``key``: "vpa" for the merchant as such, ["user_id",
    "vpa"] for the merchant as one user knows it. Without ``series`` the
    columns that need a key's days in order (gaps, frequency, growth) are left
    out, for queries that do not read them."""
    key = [key] if isinstance(key, str) else list(key)
    per = _totals(t, key, series)
    # rows whose key is not known are no series in time
    known = reduce(lambda c, k: c & F.col(k).isNotNull(), key, F.lit(True))
    n = F.col("transaction_count")
    cv = F.col("_sd") / F.greatest(F.col("_mu"), F.lit(1.0))
    factors = ((n > 1) & (cv > 2.0)).cast("int") + (F.coalesce("_fail", F.lit(0.0)) > 0.1).cast("int") \
        + (F.coalesce("night_share", F.lit(0.0)) > 0.3).cast("int")
    risk = F.when(factors >= 3, "critical").when(factors == 2, "high").when(factors == 1, "medium").otherwise("low")
    adj = F.element_at(X.lit_map(RISK_ADJ), risk)
    span = T.whole_days_between("_last", "_first")
    per_month = n * 30 / F.greatest(span, F.lit(1))
    loyalty = (F.when(n == 0, 0.0).when(F.col("_n_timed") < 2, 0.3).when(span == 0, 0.5)
                .when(per_month >= 4, 1.0).when(per_month >= 2, 0.8).when(per_month >= 1, 0.6).otherwise(0.4))
    service = _clamp01(0.8 * F.col("success_rate") * (1 - F.col("dispute_rate")) * (1 - F.col("refund_rate") * 0.5))
    compliance = F.least(F.lit(1.0), 0.8 + 0.1 * F.col("_large") + 0.1 * (n >= 10).cast("int"))
    p = per.select(
        *key, "transaction_count", "total_volume",
        (F.col("total_volume") / F.greatest(n, F.lit(1))).alias("avg_transaction_size"),
        risk.alias("risk_level"), _clamp01((0.8 + adj) * F.col("success_rate")).alias("trust_score"),
        loyalty.alias("loyalty_score"), "dispute_rate", "refund_rate", "user_sentiment",
        service.alias("service_quality"), compliance.alias("compliance_score"),
        F.substring_index(F.col("_vpa"), "@", 1).alias("merchant_id"),
        X.business_name(F.col("_vpa")).alias("business_name"),
        X.merchant_business_category(F.col("_vpa")).alias("category"),
        cv.alias("_cv"), F.col("_mu"), "_n_paid", "night_share", *([
            F.when(known, F.col("mean_gap_days")).alias("mean_gap_days"),
            F.when(known, _frequency_score(F.col("_n_timed"), F.col("mean_gap_days"))).otherwise(0.0).alias("frequency_score"),
            F.when(known, A.growth_trend(n, F.col("_months"), F.col("_first_v"), F.col("_last_v"))).alias("growth_trend"),
        ] if series else []))
    return priced(p, market)


def priced(p: DataFrame, market: DataFrame | None) -> DataFrame:
    """The profile with its pricing fairness against the market, if given."""
    if market is not None:
        p = p.join(market.withColumnRenamed("average_transaction", "_mkt"), "category", "left")
        ratio = F.col("_mu") / F.col("_mkt")
        fair = (F.when(F.col("_mkt").isNull() & (F.col("transaction_count") > 1), _clamp01(1 - F.col("_cv") / 2))
                 .when(F.col("_mkt").isNull(), 0.7)
                 .when(F.col("_mkt") == 0, 0.5).when(ratio <= 0.9, 1.0).when(ratio <= 1.1, 0.8)
                 .when(ratio <= 1.3, 0.6).otherwise(0.3))
    else:
        fair = F.when(F.col("transaction_count") > 1, _clamp01(1 - F.col("_cv") / 2)).otherwise(0.7)
    return p.withColumn("pricing_fairness", fair)


def _totals(t: DataFrame, key: list[str], series: bool = True) -> DataFrame:
    """One row per key with all that ``profile`` needs, from one reading of
    ``t``: rows are summed by key and day before they travel, days are put in
    order within the key (as many rows as days, whatever the key's rows), and
    summed. Two payments of one day are less than a day apart, so whole days
    pass only from the last time of a day to the first of the next one. Without
    ``series`` rows are summed by key alone and nothing is put in order."""
    ts, amount = F.col("timestamp"), F.coalesce("amount", F.lit(0.0))
    h = F.hour(ts)
    spent = F.col("amount").isNotNull() & (F.col("amount") != 0) & ts.isNotNull()

    def share(cond: Column) -> Column:
        return F.sum(F.coalesce(cond.cast("double"), F.lit(0.0)))
    days = t.groupBy(*key, *([F.to_date(ts).alias("_day")] if series else [])).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_s"), F.var_pop(amount).alias("_var"), F.count(ts).alias("_nt"),
        F.count("amount").alias("_na"),
        share(F.col("status") == "failed").alias("_failed"), share(F.col("status") == "success").alias("_succeeded"),
        share((h < 6) | (h > 22)).alias("_night"), F.min(ts).alias("_from"), F.max(ts).alias("_to"),
        share(F.col("disputed")).alias("_disputed"), share(F.col("refunded")).alias("_refunded"),
        F.sum(F.when(F.coalesce(F.col("rating"), F.lit(0.0)) != 0, F.col("rating") / 5.0)
               .when(F.coalesce("disputed", F.lit(False)), 0.1)
               .when(F.coalesce("refunded", F.lit(False)), 0.2).otherwise(0.7)).alias("_sentiment"),
        F.max((F.col("amount") > 50000).cast("int")).alias("_large"), *([] if "vpa" in key else [F.max("vpa").alias("_vpa")]),
        F.count_if(spent).alias("_nv"), F.sum(F.when(spent, F.col("amount"))).alias("_v"))
    n, nt = F.sum("_n"), F.sum("_nt")
    off = F.col("_s") / F.col("_n") - F.col("_mu")
    whole = Window.partitionBy(*key)
    mean = (F.sum("_s").over(whole) / F.sum("_n").over(whole)).alias("_mu")
    outs = [
        n.alias("transaction_count"), F.sum("_s").alias("total_volume"), F.sum("_na").alias("_n_paid"), F.max("_mu").alias("_mu"),
        F.sqrt(F.sum(F.col("_n") * (F.col("_var") + off * off)) / n).alias("_sd"),
        (F.sum("_failed") / n).alias("_fail"), (F.sum("_succeeded") / n).alias("success_rate"), nt.alias("_n_timed"),
        F.when(nt > 0, F.sum("_night") / nt).alias("night_share"), F.min("_from").alias("_first"), F.max("_to").alias("_last"),
        (F.sum("_disputed") / n).alias("dispute_rate"), (F.sum("_refunded") / n).alias("refund_rate"),
        (F.sum("_sentiment") / n).alias("user_sentiment"), F.max("_large").alias("_large"), F.max("vpa" if "vpa" in key else "_vpa").alias("_vpa")]
    if not series:
        return days.select("*", mean).groupBy(*key).agg(*outs)
    order = whole.orderBy("_day")
    d = days.withColumn("_month", F.when(F.col("_nv") > 0, F.date_format(F.col("_day"), "yyyy-MM")))
    d = d.select("*", mean, F.lag("_to").over(order).alias("_before"),
                 F.min("_month").over(whole).alias("_m1"), F.max("_month").over(whole).alias("_m2"),
                 F.max("_month").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_m0"))
    new_month = F.col("_month").isNotNull() & (F.col("_m0").isNull() | (F.col("_month") > F.col("_m0")))
    return d.groupBy(*key).agg(
        *outs,
        F.when(nt > 1, F.coalesce(F.sum(T.whole_days_between("_from", "_before")), F.lit(0)) / (nt - 1)).alias("mean_gap_days"),
        F.count_if(new_month).alias("_months"), F.sum(F.when(F.col("_month") == F.col("_m1"), F.col("_v"))).alias("_first_v"),
        F.sum(F.when(F.col("_month") == F.col("_m2"), F.col("_v"))).alias("_last_v"))


def _frequency_score(n_timed: Column, gap: Column) -> Column:
    return (F.when(n_timed < 2, 0.0).when(gap <= 1, 1.0).when(gap <= 7, 0.8).when(gap <= 30, 0.6)
             .when(gap <= 90, 0.4).otherwise(0.2))


def _fixed(x: Column, digits: int) -> Column:
    """Non-negative number as text with ``digits`` decimals; six places are
    kept first, so noise beyond them never decides a tie."""
    whole = F.round(F.round(x, 6) * 10**digits).cast("bigint")
    return F.concat(F.floor(whole / 10**digits).cast("string"), F.lit("."),
                    F.lpad((whole % 10**digits).cast("string"), digits, "0"))


def insight_rows(p: DataFrame, keys: tuple = ("vpa",)) -> DataFrame:
    """One full row per insight of a merchant."""
    fixed = INSIGHT_TEXTS
    fair, trust, svc = F.col("pricing_fairness"), F.col("trust_score"), F.col("service_quality")
    when = {"pricing_optimization": fair < 0.7, "spending_pattern": F.col("frequency_score") > 0.8,
            "risk_warning": F.col("risk_level").isin("high", "critical"), "market_opportunity": F.col("growth_trend") > 0.5,
            "service_warning": svc < 0.6}
    value = {"pricing_optimization": _fixed((1 - fair) * 100, 1), "risk_warning": _fixed(trust, 2), "service_warning": _fixed(svc, 2)}
    found = []
    for name, (title, before, after, impact, confidence, advice, mitigation) in fixed.items():
        text = F.concat(F.lit(before), value.get(name, F.lit("")), F.lit(after))
        savings = F.col("avg_transaction_size") * 0.15 if name == "pricing_optimization" else F.lit(None).cast("double")
        found.append(F.when(when[name], F.struct(
            F.lit(name).alias("insight_type"), F.lit(title).alias("title"), text.alias("description"), F.lit(impact).alias("impact_score"),
            F.lit(confidence).alias("confidence"), F.lit(advice).alias("recommendation"), savings.alias("estimated_savings"),
            F.lit(mitigation).cast("string").alias("risk_mitigation"))))
    return p.select(*keys, F.inline(F.array_compact(F.array(*found))))


def insights(p: DataFrame) -> DataFrame:
    """M12–M15 as arrays of rule outputs (ordered, nulls dropped). The texts
    are fixed values."""
    fair, freq, risk = F.col("pricing_fairness"), F.col("frequency_score"), F.col("risk_level")
    growth, svc, loyal = F.col("growth_trend"), F.col("service_quality"), F.col("loyalty_score")
    ins = F.array_compact(F.array(
        F.when(fair < 0.7, "pricing_optimization"), F.when(freq > 0.8, "spending_pattern"),
        F.when(risk.isin("high", "critical"), "risk_warning"), F.when(growth > 0.5, "market_opportunity"),
        F.when(svc < 0.6, "service_warning")))
    savings = F.when(fair < 0.7, F.col("avg_transaction_size") * 0.15)
    rf = F.array_compact(F.array(
        F.when(F.col("trust_score") < 0.5, "Low trust score indicates reliability concerns"),
        F.when(F.col("dispute_rate") > 0.1, "High dispute rate suggests service issues"),
        F.when(F.col("refund_rate") > 0.05, "Elevated refund rate may indicate quality problems"),
        F.when(fair < 0.6, "Pricing significantly above market average"),
        F.when(F.col("compliance_score") < 0.7, "Potential regulatory compliance concerns")))
    opp = F.array_compact(F.array(
        F.when(loyal > 0.8, "High loyalty - negotiate volume discounts"),
        F.when(freq > 0.7, "Frequent usage - explore loyalty programs"),
        F.when(growth > 0.6, "Growing merchant - potential partnership opportunities"),
        F.when(svc > 0.8, "High service quality - reliable for important transactions")))
    rec = F.array_compact(F.array(
        F.when(risk == "high", "Set transaction limits for this merchant"),
        F.when(risk == "high", "Enable transaction notifications"),
        F.when(loyal > 0.8, "Explore exclusive offers or discounts"),
        F.when(freq > 0.8, "Consider setting monthly spending caps"),
        F.when(svc < 0.6, "Monitor service quality and consider alternatives")))
    return p.select("vpa", F.array_join(ins, ",").alias("insights"), savings.alias("estimated_savings"),
                    F.array_join(rf, "|").alias("risk_factors"), F.array_join(opp, "|").alias("opportunities"),
                    F.array_join(rec, "|").alias("recommendations"))


# of the profile, what pricing and competition read
COMPETITION_COLUMNS = ["vpa", "category", "transaction_count", "total_volume", "service_quality", "_cv", "_mu", "_n_paid"]


def competition(p: DataFrame) -> DataFrame:
    """M17/M18 re-aimed from constants: rank and share within the business
    category. The rank is counted over buckets of volumes, so a category that
    holds every merchant is not sorted in one task."""
    tot = p.groupBy("category").agg(F.sum("total_volume").alias("_cat"))
    rank = group_ranks(p, ["category"], "total_volume").select(
        "category", "total_volume", F.when(F.col("n_group") > 1, F.col("n_below") / (F.col("n_group") - 1)).otherwise(0.0).alias("_rank"))
    return p.join(tot, "category").join(rank, ["category", "total_volume"]).select(
        "vpa", "category", F.col("_rank").alias("category_percentile"),
        F.col("pricing_fairness").alias("price_competitiveness"),
        F.when(F.col("service_quality") > 0.7, "Above Average").otherwise("Below Average").alias("service_comparison"),
        (F.col("total_volume") / F.col("_cat")).alias("market_share_estimate"))


def behavior(t: DataFrame, p: DataFrame, key: str = "vpa") -> DataFrame:
    """M19 re-aimed from constants: labels from modal hour, cv, mean size and
    mean gap (our own thresholds)."""
    mode = A.modal_value(t.where(F.col("timestamp").isNotNull()).select(key, F.hour("timestamp").alias("hour")),
                         key, "hour", "modal_hour")
    d = p.join(mode, key, "left")
    hr, cv, mu, gap = F.col("modal_hour"), F.col("_cv"), F.col("avg_transaction_size"), F.col("mean_gap_days")
    return d.select(
        key, "modal_hour",
        F.when(hr.isNull(), "Unknown").when((hr >= 9) & (hr <= 17), "Regular business hours")
         .when((hr >= 18) & (hr <= 22), "Evening").otherwise("Late night or early morning").alias("transaction_timing"),
        F.when(cv < 0.5, "Consistent").otherwise("Variable").alias("spending_consistency"),
        F.when(mu < 500, "Small amounts").when(mu < 5000, "Consistent medium amounts").otherwise("Large amounts")
         .alias("transaction_size_pattern"),
        F.when(gap.isNull(), "Single visit").when(gap <= 1, "Daily").when(gap <= 7, "Weekly regular")
         .when(gap <= 30, "Monthly").otherwise("Occasional").alias("frequency_pattern"))
