"""Extended rule tagger and pattern features (C9, C10, D6, E11), the
confidence booster (K10), the champion/delta probability blend (K7/I1) and
novelty dampening (K9)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, first_match

# fixed values: extended rule tagger groups, in order (finance only above 10000)
EXTENDED_RULES = [
    ("food", ["zomato", "swiggy", "dominos", "pizza", "burger", "restaurant", "cafe", "food", "dining", "meal",
              "kitchen", "biryani", "dosa", "mcdonald", "kfc", "subway", "starbucks", "cafe coffee day", "ccd",
              "haldiram", "barbeque", "taco bell"]),
    ("transport", ["uber", "ola", "taxi", "cab", "metro", "bus", "train", "auto", "petrol", "diesel", "fuel",
                   "parking", "toll", "transport", "rapido", "meru", "bmtc", "dmrc", "indian oil", "hp petrol",
                   "bpcl", "shell"]),
    ("shopping", ["amazon", "flipkart", "myntra", "ajio", "nykaa", "bigbasket", "grofers", "blinkit", "zepto",
                  "instamart", "dunzo", "shop", "store", "mart", "mall", "retail", "grocery", "supermarket",
                  "clothing", "fashion", "electronics", "basket"]),
    ("utilities", ["electricity", "water", "gas", "internet", "wifi", "mobile", "recharge", "bill", "utility",
                   "broadband", "jio", "airtel", "bsnl"]),
    ("entertainment", ["netflix", "spotify", "youtube", "prime", "hotstar", "movie", "cinema", "bookmyshow", "game",
                       "entertainment", "music"]),
    ("healthcare", ["hospital", "clinic", "pharmacy", "medical", "doctor", "health", "medicine", "apollo", "fortis",
                    "max", "manipal"]),
]
FINANCE_RULE = ("investment", ["bank", "mutual", "fund", "sip", "insurance", "loan", "emi", "investment", "trading",
                               "zerodha", "groww", "paytm money"])
EDUCATION_RULE = ("education", ["school", "college", "university", "course", "education", "fees", "tuition",
                                "academy", "coaching", "byju", "unacademy"])
RULE_CONFIDENCE = 0.65
# fixed values: weighted merchant keyword groups
KEYWORD_GROUPS = [
    ("food_strong", ["zomato", "swiggy", "dominos", "pizza", "restaurant", "cafe"]),
    ("food_medium", ["food", "kitchen", "meal", "dining", "biryani", "dosa"]),
    ("transport_strong", ["uber", "ola", "rapido", "metro", "bmtc"]),
    ("transport_medium", ["taxi", "cab", "petrol", "diesel", "parking", "toll"]),
    ("shopping_strong", ["amazon", "flipkart", "myntra", "ajio"]),
    ("shopping_medium", ["shop", "store", "mall", "retail"]),
    ("entertainment_strong", ["netflix", "spotify", "amazon prime", "hotstar"]),
    ("entertainment_medium", ["movie", "cinema", "theater", "game"]),
    ("utility_strong", ["electricity", "water", "gas", "airtel", "jio"]),
    ("utility_medium", ["bill", "recharge", "utility", "internet"]),
]
SPECIAL_CHARS = "!@#$%^&*()-_=+[]{}|;:,.<>?"
BOOST_CAP = 0.96
BLEND_ALPHA = 0.7
BLEND_THRESHOLD = 0.6
NOVEL_CAP = 0.6


def extended_rule(name: Column, amount: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    base = first_match(low, EXTENDED_RULES, "__none__")
    fin = amount > 10000
    return (F.when(base != "__none__", base)
             .when(fin & contains_any(low, FINANCE_RULE[1]), F.lit(FINANCE_RULE[0]))
             .when(contains_any(low, EDUCATION_RULE[1]), F.lit(EDUCATION_RULE[0]))
             .otherwise(F.lit("other")))


def keyword_features(t: DataFrame) -> DataFrame:
    name = F.coalesce(F.col("merchant_name"), F.lit(""))
    low = F.lower(name)
    special = F.lit(False)
    for ch in SPECIAL_CHARS:
        special = special | name.contains(ch)
    return t.select("transaction_id", F.length(name).alias("merchant_length"),
                    name.rlike("[0-9]").cast("double").alias("has_numbers"), special.cast("double").alias("has_special_chars"),
                    *[contains_any(low, kws).cast("double").alias(f"keyword_{g}") for g, kws in KEYWORD_GROUPS])


def daypart(ts: Column) -> dict:
    h, dow = F.hour(ts), F.weekday(ts)
    wk = dow >= 5
    b = lambda c: c.cast("double")
    return {
        "hour": h, "is_morning": b((h >= 6) & (h <= 11)), "is_lunch": b((h >= 11) & (h <= 14)),
        "is_evening": b((h >= 17) & (h <= 21)), "is_late_night": b((h >= 22) | (h <= 5)),
        "day_of_week": dow, "is_weekend": b(wk), "is_weekday": b(~wk), "is_monday": b(dow == 0),
        "is_friday": b(dow == 4), "weekend_morning": b(wk & (h >= 6) & (h <= 11)),
        "weekday_commute": b(~wk & (((h >= 7) & (h <= 10)) | ((h >= 17) & (h <= 20)))),
        "weekend_evening": b(wk & (h >= 17) & (h <= 22)),
    }


def amount_patterns(a: Column) -> dict:
    b = lambda c: c.cast("double")
    return {
        "amount": a, "amount_log": F.log1p(a), "is_micro": b(a <= 50), "is_small": b((a > 50) & (a <= 500)),
        "is_medium": b((a > 500) & (a <= 5000)), "is_large": b(a > 5000), "is_round_amount": b(a % 100 == 0),
        "is_odd_amount": b(a % 2 == 1), "likely_food_amount": b((a >= 50) & (a <= 1500)),
        "likely_transport_amount": b((a >= 10) & (a <= 500)), "likely_utility_amount": b((a >= 100) & (a <= 5000)),
        "likely_shopping_amount": b((a >= 200) & (a <= 20000)),
    }


def boosted(t: DataFrame) -> DataFrame:
    """K10 on the rule fallback (confidence 0.65): pattern boosts, cap 0.96."""
    low = F.lower(F.coalesce(F.col("merchant_name"), F.lit("")))
    kw = {g: contains_any(low, kws) for g, kws in KEYWORD_GROUPS}
    dp = daypart(F.col("timestamp"))
    ap = amount_patterns(F.col("amount"))
    on = lambda c: c > 0
    cat = extended_rule(F.col("merchant_name"), F.col("amount"))
    food = (F.when(kw["food_strong"], 0.15).when(kw["food_medium"], 0.08).otherwise(0.0)
            + F.when(on(dp["is_lunch"]) & on(ap["likely_food_amount"]), 0.10)
               .when(on(dp["is_evening"]) & on(ap["likely_food_amount"]), 0.08)
               .when(on(dp["is_late_night"]) & on(ap["is_small"]), 0.12).otherwise(0.0))
    transport = (F.when(kw["transport_strong"], 0.15).when(kw["transport_medium"], 0.08).otherwise(0.0)
                 + F.when(on(dp["weekday_commute"]) & on(ap["likely_transport_amount"]), 0.12).otherwise(0.0))
    shopping = (F.when(kw["shopping_strong"], 0.15).when(kw["shopping_medium"], 0.08).otherwise(0.0)
                + F.when(on(dp["weekend_evening"]) & on(ap["likely_shopping_amount"]), 0.10).otherwise(0.0))
    ent = (F.when(kw["entertainment_strong"], 0.15).when(kw["entertainment_medium"], 0.08).otherwise(0.0)
           + F.when(on(dp["is_evening"]) | on(dp["weekend_evening"]), 0.10).otherwise(0.0))
    util = (F.when(kw["utility_strong"], 0.15).when(kw["utility_medium"], 0.08).otherwise(0.0)
            + F.when(on(ap["likely_utility_amount"]), 0.08).otherwise(0.0))
    boost = (F.when(cat == "food", food).when(cat == "transport", transport).when(cat == "shopping", shopping)
              .when(cat == "entertainment", ent).when(cat.isin("bills", "utility"), util).otherwise(0.0))
    conf = F.least(F.lit(RULE_CONFIDENCE) + boost, F.lit(BOOST_CAP))
    return t.select("transaction_id", cat.alias("predicted_category"), F.lit(RULE_CONFIDENCE).alias("base_confidence"),
                    boost.alias("confidence_boost"), conf.alias("confidence"),
                    (conf < 0.7).cast("int").alias("requires_review"))


# --- K7 / I1 -----------------------------------------------------------------
def label_index(labels: DataFrame, col: str = "category") -> DataFrame:
    """Class index = position in the sorted label set (K rows: a handful)."""
    d = labels.select(F.col(col).alias("label")).where(F.col("label").isNotNull()).distinct()
    return d.withColumn("idx", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))


def frequency_model(train: DataFrame, key: str, idx: DataFrame, k: Column) -> DataFrame:
    """Laplace-smoothed P(class | key) as an array over class index: the
    per-key entry list holds at most K items."""
    c = train.join(F.broadcast(idx), train["category"] == idx["label"]).groupBy(key, "idx").agg(F.count(F.lit(1)).alias("_c"))
    g = c.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "_c"))).alias("_m"), F.sum("_c").alias("_n"))
    # K enters as a column first: subqueries may not sit inside lambdas
    g = g.withColumn("_k", k)
    probs = F.transform(F.sequence(F.lit(0), F.col("_k") - 1),
                        lambda i: (F.coalesce(F.element_at(F.col("_m"), i), F.lit(0)) + 1) / (F.col("_n") + F.col("_k")))
    return g.select(key, probs.alias("probs"))


def blend(rows: DataFrame, champ: DataFrame, delta: DataFrame, champ_key: str, delta_key: str,
          idx: DataFrame, k: Column) -> DataFrame:
    """K7: alpha-blend of champion and delta class probabilities (delta
    absent -> champion only), argmax, threshold, top 3 (I1)."""
    d = (rows.join(champ.withColumnRenamed("probs", "_cp"), champ_key, "left")
             .join(delta.withColumnRenamed("probs", "_dp"), delta_key, "left")).withColumn("_k", k)
    uniform = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.lit(1.0) / F.col("_k"))
    cp = F.coalesce(F.col("_cp"), uniform)
    probs = F.when(F.col("_dp").isNotNull(),
                   F.zip_with(cp, F.col("_dp"), lambda x, y: F.lit(BLEND_ALPHA) * x + F.lit(1 - BLEND_ALPHA) * y)).otherwise(cp)
    d = d.withColumn("probs", probs).withColumn(
        "prediction_source", F.when(F.col("_dp").isNotNull(), "ensemble").otherwise("champion"))
    top = F.slice(F.array_sort(F.transform("probs", lambda p, i: F.struct((-p).alias("np"), (-i).alias("ni"),
                                                                      i.alias("idx"), p.alias("p")))), 1, 3)
    d = d.select("*", (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("_arg"),
                 F.array_max("probs").alias("confidence"), top.alias("_top"))
    names = idx.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("idx", "label"))).alias("_names"))
    d = d.withColumn("_names", names.select("_names").scalar())  # one K-entry map, a scalar subquery
    nm = lambda i: F.element_at(F.col("_names"), i)
    return d.select(*rows.columns, nm(F.col("_arg")).alias("predicted_category"), "confidence",
                    *[x for j in range(3) for x in (nm(F.col("_top")[j]["idx"]).alias(f"top{j + 1}_category"),
                                                    F.col("_top")[j]["p"].alias(f"top{j + 1}_confidence"))],
                    "prediction_source", (F.col("confidence") >= BLEND_THRESHOLD).cast("int").alias("meets_threshold"))


def dampen(scored: DataFrame, novel: Column) -> DataFrame:
    """K9: a novel merchant's confidence above 0.6 is scaled to 0.6 (top-3
    scaled alike) and every novel row is sent to review."""
    c = F.col("confidence")
    hit = novel & (c > NOVEL_CAP)
    scale = F.when(hit, F.lit(NOVEL_CAP) / c).otherwise(F.lit(1.0))
    return scored.select(
        "*", novel.cast("int").alias("novel_merchant"),
        F.when(hit, F.lit(NOVEL_CAP)).otherwise(c).alias("dampened_confidence"),
        *[(F.col(f"top{j}_confidence") * scale).alias(f"dampened_top{j}_confidence") for j in (1, 2, 3)],
        (novel | (F.when(hit, F.lit(NOVEL_CAP)).otherwise(c) < 0.7)).cast("int").alias("requires_review"))
