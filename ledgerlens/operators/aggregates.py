"""Per-key aggregates joined back to rows.

Pattern used throughout: ``groupBy(key).agg(...)`` (partial aggregation runs
map-side, so a key holding a third of all rows costs one combiner per task,
not one hot reducer), then an equi-join back on the key. AQE splits a skewed
join partition; broadcast is left to AQE's measured-size rule because the
per-key tables grow with the data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as T
from .ranking import group_quantiles


def modal_value(df: DataFrame, key: str, col: str, out: str) -> DataFrame:
    """Most frequent ``col`` per ``key``, lowest value on ties (pandas
    ``mode().iloc[0]``). Two-level count: skew-safe, no group collected."""
    counts = df.groupBy(key, col).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(key).agg(F.max(F.struct(F.col("_n"), (-F.col(col)).alias("_neg"))).alias("_b"))
    return best.select(key, (-F.col("_b._neg")).alias(out))


def distinct_count(df: DataFrame, key: str, col: str, out: str) -> DataFrame:
    """Exact distinct count per key, via a pre-deduplicating groupBy."""
    return (df.where(F.col(col).isNotNull()).select(key, col).distinct()
              .groupBy(key).agg(F.count(F.lit(1)).alias(out)))


def user_aggregates(t: DataFrame) -> DataFrame:
    """G2 per user: count, mean, sample std (single row -> 0), sum, distinct
    merchants, modal hour (lowest on ties; 12 when no hours)."""
    base = t.select("user_id", "merchant_name", "amount", T.hour("timestamp").alias("hour"))
    agg = base.groupBy("user_id").agg(
        F.count("amount").alias("user_transaction_count"),
        F.avg("amount").alias("user_avg_amount"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("user_amount_std"),
        F.sum("amount").alias("user_total_spent"),
    )
    div = distinct_count(base, "user_id", "merchant_name", "user_merchant_diversity")
    mode = modal_value(base.where(F.col("hour").isNotNull()), "user_id", "hour", "user_preferred_hour")
    return (agg.join(div, "user_id", "left").join(mode, "user_id", "left")
               .select("user_id", "user_transaction_count", "user_avg_amount", "user_amount_std",
                       "user_total_spent",
                       F.coalesce("user_merchant_diversity", F.lit(0)).cast("long").alias("user_merchant_diversity"),
                       F.coalesce("user_preferred_hour", F.lit(12)).alias("user_preferred_hour")))


def user_row_features() -> list:
    return [
        (F.col("user_total_spent") / (F.col("user_transaction_count") + 1)).alias("user_spending_velocity"),
        (F.col("amount") / (F.col("user_avg_amount") + 1)).alias("amount_vs_user_avg"),
        (F.abs(F.col("amount") - F.col("user_avg_amount")) > 2 * F.col("user_amount_std")).cast("int").alias("is_unusual_amount"),
        (1 / (1 + F.col("user_amount_std"))).alias("user_consistency_score"),
    ]


def user_stats(t: DataFrame) -> DataFrame:
    """G2 + H5: per-user stats joined back to rows, plus per-row velocity,
    ratio to own mean, unusual flag, consistency."""
    out = t.select("transaction_id", "user_id", "amount").join(user_aggregates(t), "user_id", "left")
    return out.select(
        "transaction_id", "user_id", "amount", "user_transaction_count", "user_avg_amount",
        "user_amount_std", "user_total_spent", "user_merchant_diversity", "user_preferred_hour",
        *user_row_features())


def merchant_stats(t: DataFrame, threshold: int = 5) -> DataFrame:
    """G1: per-merchant count, mean, sample std (single row -> 0), distinct
    users; frequent flag, consistency, popularity = users / max(users).
    The global max is a scalar subquery, evaluated once: no unpartitioned
    window over the fact table and no cross join."""
    m = t.where(F.col("merchant_name").isNotNull()).groupBy("merchant_name").agg(
        F.count("amount").alias("merchant_transaction_count"),
        F.avg("amount").alias("merchant_avg_amount"),
        F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("merchant_amount_std"),
    )
    u = distinct_count(t, "merchant_name", "user_id", "merchant_unique_users")
    m = m.join(u, "merchant_name", "left").withColumn(
        "merchant_unique_users", F.coalesce("merchant_unique_users", F.lit(0)).cast("long"))
    max_users = m.agg(F.max("merchant_unique_users")).scalar()
    return m.select(
        "merchant_name", "merchant_transaction_count", "merchant_avg_amount", "merchant_amount_std",
        "merchant_unique_users",
        (F.col("merchant_transaction_count") >= threshold).cast("int").alias("is_frequent_merchant"),
        (1 / (1 + F.col("merchant_amount_std"))).alias("merchant_amount_consistency"),
        (F.col("merchant_unique_users") / max_users).alias("merchant_popularity"),
    )


def top_k(df: DataFrame, keys: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """Exact top-k rows per key. A filter on the row number lets every map
    task keep its own top k of a key before the shuffle (a partial window
    group limit in the plan), so of a key with a third of all rows at most
    k rows a map task travel. ``order`` must end in a unique column so
    ranking is deterministic."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def spending_summary(t: DataFrame) -> DataFrame:
    """G4 + I2: per user total, mean, count, top-5 categories by spend (ties by
    name), and rows above the user's own exact 95th percentile (linear)."""
    cats = t.groupBy("user_id", "category").agg(F.sum("amount").alias("_s"), F.count("amount").alias("_na"), F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("user_id").orderBy(F.col("_s").desc_nulls_last(), "c")
    cats = cats.withColumn("c", F.coalesce("category", F.lit("other"))).withColumn("rank", F.row_number().over(order))
    best = F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "c"))))
    per = cats.groupBy("user_id").agg(
        F.sum("_s").alias("total_spending"), F.when(F.sum("_na") > 0, F.sum("_s") / F.sum("_na")).alias("average_transaction"),
        F.sum("_n").alias("transaction_count"), F.array_join(F.transform(best, lambda x: x["c"]), "|").alias("top_categories"))
    p95 = group_quantiles(t, ["user_id"], "amount", {"_p95": 0.95}, above={"_p95": "_above"})
    return per.where(F.col("user_id").isNotNull()).join(p95, "user_id", "left").select(
        "user_id", "total_spending", "average_transaction", "transaction_count",
        F.coalesce("_above", F.lit(0)).alias("unusual_transactions"), "top_categories")


def peak_hours(t: DataFrame, key: str = "vpa") -> DataFrame:
    """Hours whose count exceeds the key's mean hourly count (over hours
    that occur), sorted, as text ``"9,19"``."""
    hc = t.where(F.col("timestamp").isNotNull()).groupBy(key, F.hour("timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"))
    mean = hc.groupBy(key).agg(F.avg("n").alias("_mu"))
    return (hc.join(mean, key).groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("n") > F.col("_mu"), F.col("hour")))), ",").alias("peak_hours"),
        F.sum("n").alias("n_timed")))


def seasonality(t: DataFrame, key: str = "vpa") -> DataFrame:
    """Share of a key's rows per month name (one row per key, month)."""
    mc = t.where(F.col("timestamp").isNotNull()).groupBy(key, F.date_format("timestamp", "MMMM").alias("month_name")).agg(
        F.count(F.lit(1)).alias("n"))
    tot = mc.groupBy(key).agg(F.sum("n").alias("_t"))
    return mc.join(tot, key).select(key, "month_name", (F.col("n") / F.col("_t")).alias("share"))


def growth(t: DataFrame, key: str | list[str] = "vpa") -> DataFrame:
    """0.5 + (last month volume - first) / max(first, 1), clamped; fewer
    than 4 rows or 2 months -> 0.5."""
    key = [key] if isinstance(key, str) else list(key)
    valid = t.where(F.col("timestamp").isNotNull() & F.col("amount").isNotNull() & (F.col("amount") != 0))
    mv = valid.groupBy(*key, F.date_format("timestamp", "yyyy-MM").alias("m")).agg(F.sum("amount").alias("v"))
    per = mv.groupBy(*key).agg(F.count(F.lit(1)).alias("months"),
                              F.min_by("v", "m").alias("first_v"), F.max_by("v", "m").alias("last_v"))
    n = t.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return (n.join(per, key, "left").select(
        *key, "n", F.coalesce("months", F.lit(0)).cast("long").alias("months"),
        growth_trend(F.col("n"), F.col("months"), F.col("first_v"), F.col("last_v")).alias("growth_trend")))


def growth_trend(n: Column, months: Column, first: Column, last: Column) -> Column:
    g = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + (last - first) / F.greatest(first, F.lit(1.0))))
    return F.when((n < 4) | (F.coalesce(months, F.lit(0)) < 2), F.lit(0.5)).otherwise(g)


def pricing(t: DataFrame, key: str = "vpa") -> DataFrame:
    """Mean, exact median, volatility = pop std / mean (0 if mean <= 0);
    rows with a null or zero amount are ignored, as in the reference."""
    a = t.where(F.col("amount").isNotNull() & (F.col("amount") != 0))
    per = a.groupBy(key).agg(
        F.avg("amount").alias("average_transaction"),
        F.when(F.avg("amount") > 0, F.stddev_pop("amount") / F.avg("amount")).otherwise(F.lit(0.0)).alias("price_volatility"))
    return per.join(group_quantiles(a, [key], "amount", {"median_transaction": 0.5}), key, "left").select(
        key, "average_transaction", "median_transaction", "price_volatility")


def dataset_summary(t: DataFrame) -> DataFrame:
    """Category distribution plus amount describe, one row per category
    and one overall row (category = '*')."""
    d = t.select(F.coalesce("category", F.lit("(null)")).alias("category"), "amount")
    cols = [F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean_amount"), F.min("amount").alias("min_amount"),
            F.max("amount").alias("max_amount")]
    mid = {"median_amount": 0.5}
    order = ["category", "n", "mean_amount", "median_amount", "min_amount", "max_amount"]
    per_cat = d.groupBy("category").agg(*cols).join(group_quantiles(d, ["category"], "amount", mid), "category", "left").select(*order)
    whole = d.withColumn("category", F.lit("*"))
    overall = whole.groupBy("category").agg(*cols).join(group_quantiles(whole, ["category"], "amount", mid), "category", "left").select(*order)
    return per_cat.unionByName(overall)
