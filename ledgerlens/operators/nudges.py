"""Psychology profile (N1, N2) and behavioural nudges for proposed purchases
(N3–N12), for every proposal in one job.

Context tables are joined by key (user; user+category; user+category+month;
category), never collected: profile and per-key statistics are
``groupBy`` aggregates, each nudge family is a projection over the joined
proposal row, the families are unioned and ranked per proposal.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

from ..functions import time as T
from .ranking import group_quantiles

# fixed values: base effectiveness, intensity multipliers, gates, returns
BASE = {"loss_aversion": 0.9, "social_proof": 0.8, "mental_accounting": 0.85,
        "commitment_device": 0.75, "temporal_discounting": 0.7, "anchoring": 0.65}
TYPE_ORDER = ["loss_aversion", "social_proof", "mental_accounting", "commitment_device",
              "temporal_discounting", "anchoring"]
INTENSITY_MULT = {"gentle": 0.8, "moderate": 1.0, "strong": 1.2}
ANNUAL_RETURN = 0.12
TRAITS = ["loss_aversion_sensitivity", "social_influence_susceptibility", "commitment_tendency",
          "temporal_preference", "anchoring_susceptibility", "risk_tolerance", "spending_impulsiveness"]
# fixed values: message templates (type, intensity) -> [first, second]
TEMPLATES = {
    ("loss_aversion", "gentle"): ["You could save ₹{amount} this month by skipping this purchase 💰",
                                  "This purchase means ₹{amount} less towards your {goal} goal 🎯"],
    ("loss_aversion", "moderate"): ["⚠️ This ₹{amount} purchase will put you ₹{overspend} over your {category} budget",
                                    "You're about to lose ₹{amount} from your savings progress 📉"],
    ("loss_aversion", "strong"): ["🚨 STOP: This purchase will cost you ₹{total_impact} in missed opportunities!",
                                  "⛔ You'll lose {days_delay} days of progress toward your {goal} goal!"],
    ("social_proof", "gentle"): ["83% of users like you skip purchases like this 👥",
                                 "Similar users spend 25% less on {category} this month 📊"],
    ("social_proof", "moderate"): ["Users in your income group spend ₹{benchmark} less on {category} 👥",
                                   "You're spending 40% more than similar users this month 📈"],
    ("social_proof", "strong"): ["🏆 Top savers in your group avoid purchases like this 95% of the time!",
                                 "⚡ You're in the top 10% of spenders - join the savers instead!"],
    ("mental_accounting", "gentle"): ["Consider moving ₹{amount} from your {from_bucket} to {to_bucket} budget 🗂️",
                                      "This fits better in your {suggested_category} mental budget 🧠"],
    ("mental_accounting", "moderate"): ["⚖️ This purchase unbalances your {category} vs {other_category} spending",
                                        "You've already allocated ₹{allocated} for {category} this month"],
    ("mental_accounting", "strong"): ["🚨 This violates your {category} budget rules by ₹{violation}!",
                                      "⛔ Emergency: This breaks your carefully planned budget structure!"],
    ("commitment_device", "gentle"): ["Remember your commitment to save ₹{goal_amount} by {date} 🤝",
                                      "This purchase delays your {goal} goal by {delay} days ⏰"],
    ("commitment_device", "moderate"): ["⚠️ This conflicts with your promise to limit {category} spending",
                                        "You committed to staying under ₹{limit} for {category} 📝"],
    ("commitment_device", "strong"): ["🚨 COMMITMENT VIOLATION: You promised to avoid purchases like this!",
                                      "⛔ Breaking this commitment costs ₹{penalty} from your goal fund!"],
    ("temporal_discounting", "gentle"): ["In 6 months, you'll have ₹{future_value} instead of this purchase ⏰",
                                         "This ₹{amount} could become ₹{investment_value} by next year 📈"],
    ("temporal_discounting", "moderate"): ["⏰ Waiting 24 hours could save you from this impulse purchase",
                                           "By year-end, this money could grow to ₹{year_end_value} 💰"],
    ("temporal_discounting", "strong"): ["🚨 This ₹{amount} costs you ₹{opportunity_cost} in future wealth!",
                                         "⛔ 10-year impact: You're sacrificing ₹{decade_cost} for this!"],
    ("anchoring", "gentle"): ["Compared to your usual ₹{anchor_amount} {category} spending... 🎯",
                              "This is {percentage}% higher than your typical {category} purchase 📊"],
    ("anchoring", "moderate"): ["⚠️ This ₹{amount} is {multiplier}x your average {category} purchase",
                                "Your friends typically spend ₹{friend_anchor} for similar items 👥"],
    ("anchoring", "strong"): ["🚨 This is {extreme_multiplier}x higher than any {category} purchase you've made!",
                              "⛔ Even luxury buyers spend only ₹{luxury_anchor} for this category!"],
}


def fixed(c: Column, places: int = 2) -> Column:
    """Number as text with ``places`` decimals, rounded half up on the IEEE
    value (integer arithmetic after one multiply-add), so every engine prints
    the same digits."""
    scale = 10 ** places

    def pos(x):
        units = F.floor(x * scale + 0.5).cast("long")
        return F.concat(F.floor(units / scale).cast("long").cast("string"), F.lit("."),
                        F.lpad(F.pmod(units, F.lit(scale)).cast("string"), places, "0"))
    return F.when(c < 0, F.concat(F.lit("-"), pos(-c))).otherwise(pos(c))


def money(c: Column) -> Column:
    """Amounts in messages: fixed two decimals (engine-independent text)."""
    return fixed(c, 2)


def psych_profile(t: DataFrame) -> DataFrame:
    """N1 per user. Month/day buckets use the timestamp (null -> 2024-01-01)."""
    ts = F.coalesce(F.col("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    d = t.select("user_id", "amount", F.coalesce("category", F.lit("other")).alias("cat"), "type",
                 F.date_format(ts, "yyyy-MM").alias("month"), F.date_format(ts, "yyyy-MM-dd").alias("day"),
                 (F.weekday(ts) >= 5).cast("double").alias("wkend"))
    u = d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"),
                                 F.avg((F.col("type") == "refund").cast("double")).alias("_ref"),
                                 F.avg(F.coalesce("wkend", F.lit(0.0))).alias("_wk"),
                                 F.count_distinct("cat").alias("_ncat"))
    mon = d.groupBy("user_id", "month").agg(F.count(F.lit(1)).alias("_c"), F.avg("amount").alias("_mu"),
                                            F.stddev_pop("amount").alias("_sd"))
    cvm = F.when(F.col("_mu") > 0, F.col("_sd") / F.col("_mu")).otherwise(1.0)
    com = mon.where(F.col("_c") > 1).groupBy("user_id").agg(F.avg(1 - F.least(F.lit(1.0), cvm)).alias("_com"))
    day = d.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("_dc"))
    dstat = day.groupBy("user_id").agg(F.avg("_dc").alias("_dmu"), F.stddev_pop("_dc").alias("_dsd"),
                                       F.count(F.lit(1)).alias("_nd"))
    spikes = (day.join(dstat, "user_id").groupBy("user_id", "_nd")
                 .agg(F.count_if(F.col("_dc") > F.col("_dmu") + 2 * F.col("_dsd")).alias("_sp")))
    cat = d.groupBy("user_id", "cat").agg(F.count(F.lit(1)).alias("_c"), F.avg("amount").alias("_mu"),
                                          F.stddev_pop("amount").alias("_sd"))
    cvc = F.when(F.col("_mu") > 0, F.col("_sd") / F.col("_mu")).otherwise(0.0)
    anc = cat.where(F.col("_c") > 3).groupBy("user_id").agg(F.avg(cvc).alias("_anc"))
    p = u.join(com, "user_id", "left").join(spikes, "user_id", "left").join(anc, "user_id", "left")
    n = F.col("n")
    return p.select(
        "user_id", n.alias("transaction_count"),
        F.when(n > 10, F.least(F.lit(1.0), F.col("_ref") * 3)).otherwise(0.5).alias("loss_aversion_sensitivity"),
        F.when(n > 20, F.least(F.lit(1.0), F.col("_ncat") / F.least(n, F.lit(10)))).otherwise(0.5)
         .alias("social_influence_susceptibility"),
        F.coalesce("_com", F.lit(0.5)).alias("commitment_tendency"),
        F.col("_wk").alias("temporal_preference"),
        F.when(F.col("_anc").isNotNull(), 1 - F.least(F.lit(1.0), F.col("_anc"))).otherwise(0.5)
         .alias("anchoring_susceptibility"),
        F.lit(0.5).alias("risk_tolerance"),
        F.least(F.lit(1.0), F.col("_sp") / F.col("_nd") * 5).alias("spending_impulsiveness"))


def psych_insights(p: DataFrame) -> DataFrame:
    """Insight texts, recommended nudge types, analysis quality."""
    la, so, im, co = (F.col(c) for c in ("loss_aversion_sensitivity", "social_influence_susceptibility",
                                          "spending_impulsiveness", "commitment_tendency"))
    tp = F.col("temporal_preference")
    ins = F.array_compact(F.array(
        F.when(la > 0.7, "High loss aversion - responds well to savings-focused messaging")
         .when(la < 0.3, "Low loss aversion - may need stronger financial guardrails"),
        F.when(so > 0.7, "Highly influenced by social proof - peer comparisons are effective")
         .when(so < 0.3, "Less influenced by others - focus on personal goals"),
        F.when(im > 0.7, "High impulsiveness - benefits from delayed gratification techniques")
         .when(im < 0.3, "Low impulsiveness - already shows good self-control"),
        F.when(co > 0.7, "High commitment tendency - commitment devices will be effective")
         .when(co < 0.3, "Low commitment tendency - may need external accountability")))
    rec = F.array_compact(F.array(F.when(la > 0.5, "loss_aversion"), F.when(so > 0.5, "social_proof"),
                                  F.when(co > 0.5, "commitment_device"), F.when(tp > 0.6, "temporal_discounting")))
    n = F.col("transaction_count")
    return p.select("user_id", F.array_join(ins, "|").alias("insights"),
                    F.array_join(rec, ",").alias("recommended_nudge_types"), n.alias("transaction_count"),
                    F.least(F.lit(1.0), n / 50.0).alias("analysis_confidence"),
                    F.when(n < 20, "Collect more transaction data for better analysis")
                     .otherwise("Sufficient data for reliable analysis").alias("analysis_recommendation"))


def context(t: DataFrame, proposals: DataFrame, budgets: DataFrame, profile: DataFrame) -> DataFrame:
    """Proposal row + budget, month-to-date spend (the month's other rows),
    traits, peer benchmark and the user's own category anchors."""
    cat = F.coalesce("category", F.lit("other"))
    month = F.date_format("timestamp", "yyyy-MM")
    mt = t.groupBy("user_id", cat.alias("category"), month.alias("month")).agg(F.sum("amount").alias("_mtot"))
    own = t.select("user_id", cat.alias("category"), "amount")
    peer = own.groupBy("category").agg(F.avg("amount").alias("peer_average")).join(
        group_quantiles(own, ["category"], "amount", {"top_10_percent": 0.1}), "category", "left")
    anch = own.groupBy("user_id", "category").agg(F.avg("amount").alias("user_average"), F.max("amount").alias("user_maximum")).join(
        group_quantiles(own, ["user_id", "category"], "amount", {"user_typical": 0.5}), ["user_id", "category"], "left")
    p = proposals.select("proposal_id", "user_id", "amount", cat.alias("category"), "merchant",
                         month.alias("month"))
    return (p.join(mt, ["user_id", "category", "month"], "left")
             .join(budgets.select("user_id", "category", F.col("limit").alias("budget")), ["user_id", "category"], "left")
             .join(profile.select("user_id", *TRAITS), "user_id", "left")
             .join(peer, "category", "left")
             .join(anch, ["user_id", "category"], "left")
             .withColumn("spent", F.coalesce(F.col("_mtot") - F.col("amount"), F.lit(0.0)))
             .withColumn("budget", F.coalesce("budget", F.lit(0.0))).drop("_mtot"))


def _tmpl(ntype: str, which: int, **subs) -> Column:
    out = None
    for inten in ("gentle", "moderate", "strong"):
        text = F.lit(TEMPLATES[(ntype, inten)][which])
        for k, v in subs.items():
            text = F.replace(text, F.lit("{" + k + "}"), v)
        out = F.when(F.col("intensity") == inten, text) if out is None else out.when(F.col("intensity") == inten, text)
    return out


def _nudge(df: DataFrame, ntype: str, intensity: Column, confidence: Column, action: Column,
           message_fn, goal: Column | None = None, extras: dict | None = None) -> DataFrame:
    d = df.withColumn("intensity", intensity)
    extras = extras or {}
    return d.select("proposal_id", "user_id", F.lit(ntype).alias("nudge_type"), "intensity",
                    confidence.alias("confidence"), action.alias("recommended_action"),
                    (goal if goal is not None else F.lit(0)).alias("goal_order"),
                    message_fn().alias("message"),
                    *[v.alias(k) for k, v in extras.items()])


def loss_aversion(c: DataFrame) -> DataFrame:
    a, b, s = F.col("amount"), F.col("budget"), F.col("spent")
    over = F.when(b > 0, F.greatest(F.lit(0.0), s + a - b)).otherwise(0.0)
    inten = F.when(over > b * 0.5, "strong").when(over > b * 0.2, "moderate").otherwise("gentle")
    d = c.where(F.col("loss_aversion_sensitivity") > 0.3).withColumn("overspend", over)
    return _nudge(d, "loss_aversion", inten, F.col("loss_aversion_sensitivity") * 0.9,
                  F.when(F.col("intensity") == "strong", "Skip this purchase").otherwise("Delay purchase for 24 hours"),
                  lambda: _tmpl("loss_aversion", 0, amount=money(a), overspend=money(F.col("overspend")),
                                category=F.col("category"), total_impact=money(a * 2)),
                  extras={"overspend_amount": F.col("overspend"),
                          "budget_utilization": F.when(b > 0, (s + a) / b).otherwise(0.0)})


def social_proof(c: DataFrame) -> DataFrame:
    a = F.col("amount")
    peer = F.coalesce("peer_average", a * 0.8)
    dev = F.when(peer > 0, (a - peer) / peer).otherwise(0.0)
    inten = F.when(dev > 1.0, "strong").when(dev > 0.5, "moderate").otherwise("gentle")
    d = c.where(F.col("social_influence_susceptibility") > 0.3).withColumn("_peer", peer).withColumn("_dev", dev)
    msg = lambda: F.when(F.col("_dev") > 0, _tmpl("social_proof", 1, benchmark=money(F.col("_peer")),
                                                  category=F.col("category"),
                                                  percentage=(F.col("_dev") * 100).cast("long").cast("string"))
                         ).otherwise(_tmpl("social_proof", 0, category=F.col("category")))
    return _nudge(d, "social_proof", inten, F.col("social_influence_susceptibility") * 0.85,
                  F.lit("Compare with similar users before purchasing"), msg,
                  extras={"peer_average": F.col("_peer"), "user_vs_peer_deviation": F.col("_dev"),
                          "top_savers_benchmark": F.coalesce("top_10_percent", a * 0.5)})


def mental_accounting(c: DataFrame) -> DataFrame:
    a, b, s = F.col("amount"), F.col("budget"), F.col("spent")
    util = (s + a) / b
    inten = F.when(util > 1.2, "strong").when(util > 1.0, "moderate").otherwise("gentle")
    d = c.where(b > 0).withColumn("_viol", F.greatest(F.lit(0.0), s + a - b))
    return _nudge(d, "mental_accounting", inten, F.lit(0.8),
                  F.when(F.col("intensity") == "gentle", "Review budget allocation").otherwise("Reallocate from another category"),
                  lambda: _tmpl("mental_accounting", 0, amount=money(a), category=F.col("category"),
                                other_category=F.lit("savings"), allocated=money(b), violation=money(F.col("_viol"))),
                  extras={"budget_utilization": util, "budget_violation": F.col("_viol")})


def commitment(c: DataFrame, goals: DataFrame) -> DataFrame:
    """F9 non-equi goal join (category match OR savings goal) as an equi-join
    on user plus a filter: goals per user are a handful."""
    g = goals.select("user_id", F.col("goal_order"), F.col("name").alias("_gname"), F.col("type").alias("_gtype"),
                     F.col("category").alias("_gcat"), F.col("target_amount").alias("_gt"),
                     F.col("current_amount").alias("_gc"), F.col("target_date").alias("_gd"))
    d = (c.where(F.col("commitment_tendency") > 0.2).join(g, "user_id")
          .where((F.col("_gcat") == F.col("category")) | (F.col("_gtype") == "savings")))
    a = F.col("amount")
    rem = F.col("_gt") - F.col("_gc")
    delay = F.when(rem > 0, F.floor(a / rem * 30)).otherwise(0).cast("long")
    d = d.withColumn("_delay", delay)
    inten = F.when(F.col("_delay") > 7, "strong").otherwise("moderate")
    return _nudge(d, "commitment_device", inten, F.col("commitment_tendency") * 0.9,
                  F.lit("Review your commitment before proceeding"),
                  lambda: _tmpl("commitment_device", 0, goal_amount=money(F.col("_gt")),
                                date=F.col("_gd").cast("string"), category=F.col("category")),
                  goal=F.col("goal_order"),
                  extras={"delay_days": F.col("_delay"),
                          "progress_percentage": F.when(F.col("_gt") > 0, F.col("_gc") / F.col("_gt") * 100).otherwise(0.0)})


def temporal(c: DataFrame) -> DataFrame:
    a, tp = F.col("amount"), F.col("temporal_preference")
    f6, f1, f10 = a * (1 + ANNUAL_RETURN / 2), a * (1 + ANNUAL_RETURN), a * F.pow(F.lit(1 + ANNUAL_RETURN), 10)
    inten = F.when(tp > 0.7, "strong").when(tp > 0.5, "moderate").otherwise("gentle")
    d = c.where(tp > 0.4)
    return _nudge(d, "temporal_discounting", inten, (1 - tp) * 0.8, F.lit("Wait 24 hours to reduce temporal bias"),
                  lambda: _tmpl("temporal_discounting", 0, amount=money(a), opportunity_cost=money(f1 - a),
                                future_value=money(f6)),
                  extras={"future_value_6m": f6, "future_value_1y": f1, "future_value_10y": f10,
                          "opportunity_cost": f1 - a})


def anchoring(c: DataFrame) -> DataFrame:
    a, avg, med = F.col("amount"), F.col("user_average"), F.col("user_typical")
    dev = F.when(avg > 0, (a - avg) / avg).otherwise(0.0)
    tdev = F.when(med > 0, (a - med) / med).otherwise(0.0)
    inten = F.when(dev > 2.0, "strong").when(dev > 0.5, "moderate").otherwise("gentle")
    d = c.where((F.col("anchoring_susceptibility") > 0.3) & avg.isNotNull()).withColumn("_dev", dev).withColumn("_tdev", tdev)
    return _nudge(d, "anchoring", inten, F.col("anchoring_susceptibility") * 0.7,
                  F.lit("Compare with your typical spending pattern"),
                  lambda: _tmpl("anchoring", 0, anchor_amount=money(med), category=F.col("category"), amount=money(a),
                                multiplier=fixed(F.when(avg > 0, a / avg).otherwise(1.0), 1),
                                extreme_multiplier=fixed(a / avg, 1)),
                  extras={"user_average": avg, "user_typical": med, "user_maximum": F.col("user_maximum"),
                          "deviation_from_average": F.col("_dev"), "deviation_from_typical": F.col("_tdev")})


COMMON = ["proposal_id", "user_id", "nudge_type", "intensity", "confidence", "recommended_action", "goal_order",
          "message"]


def all_nudges(c: DataFrame, goals: DataFrame) -> DataFrame:
    # six nudge families read the same proposal context: write it once to the
    # shared checkpoint folder instead of re-deriving it per family
    c = cut_lineage(c)
    parts = [loss_aversion(c), social_proof(c), mental_accounting(c), commitment(c, goals), temporal(c), anchoring(c)]
    u = None
    for p in parts:
        p = p.select(*COMMON)
        u = p if u is None else u.unionByName(p)
    traits = c.select("proposal_id", *TRAITS)
    u = u.join(traits, "proposal_id")
    mult = (F.when(F.col("nudge_type") == "loss_aversion", F.col("loss_aversion_sensitivity"))
             .when(F.col("nudge_type") == "social_proof", F.col("social_influence_susceptibility"))
             .when(F.col("nudge_type") == "commitment_device", F.col("commitment_tendency"))
             .when(F.col("nudge_type") == "temporal_discounting", 1 - F.col("temporal_preference"))
             .when(F.col("nudge_type") == "anchoring", F.col("anchoring_susceptibility")).otherwise(1.0))
    base = F.element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), F.col("nudge_type"))
    imult = F.element_at(F.create_map(*[F.lit(x) for kv in INTENSITY_MULT.items() for x in kv]), F.col("intensity"))
    torder = F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(TYPE_ORDER) for x in (t, i)]), F.col("nudge_type"))
    return u.select(*COMMON, (base * mult * imult * F.col("confidence")).alias("effectiveness_score"),
                    torder.alias("type_order"))


def ranked(nudges: DataFrame, k: int = 3) -> DataFrame:
    """Top k per proposal by score, ties in generation order. A
    proposal has at most a handful of nudges, so the window is small."""
    w = Window.partitionBy("proposal_id").orderBy(F.col("effectiveness_score").desc(), "type_order", "goal_order")
    return nudges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recommendations(top1: Column) -> Column:
    return (F.when(top1 == "loss_aversion", F.lit("Consider the long-term impact on your financial goals|Wait 24 hours before making this purchase"))
             .when(top1 == "social_proof", F.lit("Compare with similar users' spending patterns|Consider what financially successful people would do"))
             .when(top1 == "mental_accounting", F.lit("Review your budget allocation for this category|Consider reallocating from another category"))
             .otherwise(F.lit("")))


def nudge_log(ranked_nudges: DataFrame, proposals: DataFrame, delay_hours: int = 24) -> DataFrame:
    """N12 log: each shown (top-3) nudge with the observed outcome: the user
    'delayed' when their next transaction came more than ``delay_hours``
    later (or never), else 'purchased'; a delay saves the proposal amount."""
    from .windows import with_next_ts
    p = with_next_ts(proposals.select("proposal_id", "user_id", "amount", "timestamp"), ["user_id"], "timestamp", "proposal_id")
    gap = (T.epoch_micros("next_ts") - T.epoch_micros("timestamp")) / F.lit(3.6e9)
    delayed = F.col("next_ts").isNull() | (gap > delay_hours)
    p = p.select("proposal_id", "amount", "timestamp", F.when(delayed, "delayed").otherwise("purchased").alias("user_action"))
    return ranked_nudges.join(p, "proposal_id").select(
        "user_id", "nudge_type", "intensity", F.col("confidence").alias("predicted_confidence"), "user_action",
        F.when(F.col("user_action") == "delayed", F.col("amount")).otherwise(0.0).alias("amount_saved"), "timestamp")


def nudge_analytics(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per user over the last ``days`` days: shown, followed, rate,
    money saved, most effective type (most follows, then name)."""
    import datetime as dt
    end = dt.datetime.fromisoformat(as_of)
    start = end - dt.timedelta(days=days)
    w = log.where((F.col("timestamp") >= T.ntz_literal(start.isoformat())) & (F.col("timestamp") < T.ntz_literal(end.isoformat())))
    per = w.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_nudges_shown"),
                                   F.count_if(F.col("user_action") == "delayed").alias("nudges_followed"),
                                   F.sum("amount_saved").alias("money_saved"))
    bt = w.groupBy("user_id", "nudge_type").agg(F.count_if(F.col("user_action") == "delayed").alias("_f"))
    best = bt.groupBy("user_id").agg(F.min_by("nudge_type", F.struct(-F.col("_f"), F.col("nudge_type"))).alias("most_effective_nudge_type"))
    return per.join(best, "user_id").select(
        "user_id", F.lit(days).alias("period_days"), "total_nudges_shown", "nudges_followed",
        (F.col("nudges_followed") / F.col("total_nudges_shown")).alias("effectiveness_rate"), "money_saved",
        "most_effective_nudge_type")
