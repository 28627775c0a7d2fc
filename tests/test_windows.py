"""Skew-safe ordered operators agree with plain windows."""
import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF
from ledgerlens.functions import time as T
from ledgerlens.operators import windows as W
from ledgerlens.sources.adapters import txn


def _t(spark):
    return txn(spark, SF).select("transaction_id", "user_id", "merchant_name", "amount", "timestamp")


def test_prev_ts_and_running_count(spark):
    t = _t(spark)
    w = Window.partitionBy("user_id").orderBy("timestamp", "transaction_id")
    ref = t.select("transaction_id", F.lag("timestamp").over(w).alias("p"), F.row_number().over(w).alias("r"))
    got = W.with_running_count(W.with_prev_ts(t, ["user_id"], "timestamp", "transaction_id"),
                               ["user_id"], "timestamp", "transaction_id")
    j = ref.join(got, "transaction_id")
    assert j.where(~F.col("p").eqNullSafe(F.col("prev_ts")) | (F.col("r") != F.col("running_count"))).count() == 0


def _sparse(spark):
    """Users with pauses of 8 and 40 days, amounts near 1e8 that differ by
    cents, zero amounts, one user with a third of the rows, ties and nulls."""
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for u in range(60):
        at = start + dt.timedelta(minutes=rng.randint(0, 3000))
        for k in range(rng.randint(1, 6)):
            rows.append((f"u{u}", at, rng.choice([1e8 + rng.randint(0, 3) / 100, 0.0, 0.1, 13.37, None])))
            at += dt.timedelta(minutes=rng.choice([0, 1, 61, 2000]))
        for pause in (8, 40):
            at += dt.timedelta(days=pause)
            rows.append((f"u{u}", at, 5.0))
    rows += [("hot", start + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 50)), rng.randint(1, 9999) / 100) for _ in range(len(rows) // 2)]
    names = ["Swiggy", "Uber", "Amazon", "Electricity Board", "Netflix", None]
    data = [(str(i), u, rng.choice(names), a, t, rng.choice(["Food", "Bills", None])) for i, (u, t, a) in enumerate(rows)]
    return spark.createDataFrame(data, "transaction_id string, user_id string, merchant_name string, amount double, "
                                       "timestamp timestamp_ntz, category string")


@pytest.mark.parametrize("small", [0, 20, 512])
def test_frames_of_small_and_large_keys(spark, monkeypatch, small):
    """Keys read row by row, by hours, or both in one call: the same values,
    also for a key that is null, repeated rows, parts and items."""
    monkeypatch.setattr(W, "SMALL_KEY", small)
    t = _sparse(spark)
    t = t.unionByName(t.where("transaction_id < '3'").withColumn("user_id", F.lit(None).cast("string")).withColumn("transaction_id", F.concat(F.lit("n"), "transaction_id")))
    hour = F.date_format("timestamp", "yyyyMMddHH")  # items of no user count once an hour
    us = t.withColumn("_us", T.epoch_micros("timestamp")).withColumn(
        "_item", F.concat(F.when(F.col("user_id").isNull(), hour).otherwise(""), "merchant_name"))
    day = 86400
    own = Window.partitionBy("user_id").orderBy("_us")
    week, month = own.rangeBetween(-7 * day * 10**6, -1), own.rangeBetween(-30 * day * 10**6, -1)
    part = Window.partitionBy("user_id", "category").orderBy("_us").rangeBetween(-30 * day * 10**6, -1)
    ref = us.select("transaction_id", *[F.coalesce(F.sum("amount").over(w), F.lit(0.0)).alias(f"r{n}") for n, w in (("s7", week), ("s30", month), ("p30", part))],
                    F.max("amount").over(week).alias("rm7"), F.max("amount").over(month).alias("rm30"),
                    F.size(F.collect_set("_item").over(week)).alias("rd7"), F.size(F.collect_set("_item").over(month)).alias("rd30"))
    a, m = F.col("amount"), F.col("merchant_name")
    got = W.rolling_stats(t, ["user_id"], "timestamp", "transaction_id", {"s7": (a, 7 * day), "s30": (a, 30 * day), "p30": (a, 30 * day, 1)},
                          {"m7": (a, 7 * day), "m30": (a, 30 * day)}, {"d7": (m, 7 * day), "d30": (m, 30 * day)}, parts=[F.col("category")])
    both = ref.join(got, "transaction_id").cache()
    assert both.count() == t.count()
    near = F.lit(False)
    for c in ("s7", "s30", "p30"):
        near = near | (F.abs(F.col(c) - F.col(f"r{c}")) > 1e-4)  # sums of 1e8 and more
    for c in ("m7", "m30", "d7", "d30"):
        near = near | ~F.col(c).eqNullSafe(F.col(f"r{c}"))
    assert both.where(near).limit(3).collect() == []
    now = W.rolling_stats(t, ["user_id"], "timestamp", "transaction_id", {"n": (F.lit(1), 7 * day)}, include_current=True)
    want = us.select("transaction_id", F.count(F.lit(1)).over(own.rangeBetween(-7 * day * 10**6 + 1, 0)).alias("w"))
    assert want.join(now, "transaction_id").where("n != w").count() == 0
    twice = t.unionByName(t)
    n = W.rolling_stats(twice, ["user_id"], "timestamp", "transaction_id", {"n": (F.lit(1), 7 * day)}).join(
        us.select("transaction_id", F.count(F.lit(1)).over(week).alias("w")), "transaction_id")
    assert n.where("n != 2 * w").count() == 0 and n.count() == t.count()


def test_rows_of_small_keys_travel_once(spark):
    """A key with few rows makes no events and no hours."""
    t = _sparse(spark).where("user_id != 'hot'")
    got = W.rolling_stats(t, ["user_id"], "timestamp", "transaction_id", {"s": (F.col("amount"), 7 * 86400)})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_rolling_stats_match_range_windows(spark):
    for t, keys in ((_t(spark), ["merchant_name"]), (_sparse(spark), ["user_id"]), (_sparse(spark), ["merchant_name"])):
        us = t.withColumn("_us", T.epoch_micros("timestamp"))
        week = 7 * 86400 * 10**6
        w = Window.partitionBy(*keys).orderBy("_us")
        past, now = w.rangeBetween(-week, -1), w.rangeBetween(-(week - 1), 0)
        ref = us.select("transaction_id", F.coalesce(F.sum("amount").over(past), F.lit(0.0)).alias("rs"),
                        F.max("amount").over(past).alias("rm"), F.size(F.collect_set("merchant_name").over(past)).alias("rd"),
                        F.count(F.lit(1)).over(now).alias("rn"))
        got = W.rolling_stats(t, keys, "timestamp", "transaction_id", {"s": (F.col("amount"), 7 * 86400)},
                              {"m": (F.col("amount"), 7 * 86400)}, {"d": (F.col("merchant_name"), 7 * 86400)})
        incl = W.rolling_stats(t, keys, "timestamp", "transaction_id", {"n": (F.lit(1), 7 * 86400)}, include_current=True)
        both = ref.join(got, "transaction_id").join(incl, "transaction_id").cache()
        assert both.count() == t.count()
        bad = both.where((F.abs(F.col("rs") - F.col("s")) > 1e-6) | ~F.col("rm").eqNullSafe(F.col("m"))
                         | (F.col("rd") != F.col("d")) | (F.col("rn") != F.col("n")))
        assert bad.count() == 0, (keys, bad.limit(3).collect())


def test_rows_without_history_get_the_defaults(spark):
    """After a pause longer than the window every user feature is its default
    exactly, whatever was summed before."""
    from ledgerlens.operators import rolling as R
    rows = {r["transaction_id"]: r for r in R.user_rolling(_sparse(spark)).collect()}
    by_user = {}
    for r in rows.values():
        by_user.setdefault(r["user_id"], []).append(r)
    n = 0
    for user, own in by_user.items():
        if user == "hot":
            continue
        last = max(own, key=lambda r: r["timestamp"])
        assert all(last[c] == v for c, v in R.USER_DEFAULTS.items()), (user, last)
        n += 1
    assert n == 60


def test_zero_amounts_give_no_ratio(spark):
    from ledgerlens.operators import rolling as R
    day = dt.datetime(2024, 3, 1)
    data = [("0", "u", "Uber", 1e6 + 0.1, day - dt.timedelta(days=20), None), ("1", "u", "Uber", 0.0, day, None),
            ("2", "u", "Uber", 7.0, day + dt.timedelta(hours=2), None)]
    t = spark.createDataFrame(data, "transaction_id string, user_id string, merchant_name string, amount double, "
                                    "timestamp timestamp_ntz, category string")
    r = R.user_rolling(t).where("transaction_id = '2'").first()
    assert r["user_transport_ratio_7d"] == R.USER_DEFAULTS["user_transport_ratio_7d"]
    assert r["user_avg_transaction_amount_7d"] == 0.0 and r["user_transaction_frequency_7d"] == 1.0


def test_small_variance_of_large_amounts(spark):
    import numpy as np

    from ledgerlens.operators import rolling as R
    start = dt.datetime(2024, 1, 1)
    amounts = [1e8 + (i % 4) / 100 for i in range(400)]
    data = [(str(i), "u", "m", a, start + dt.timedelta(hours=3 * i), "c") for i, a in enumerate(amounts)]
    t = spark.createDataFrame(data, "transaction_id string, user_id string, merchant_name string, amount double, "
                                    "timestamp timestamp_ntz, category string")
    got = {int(r["transaction_id"]): r for r in R.merchant_rolling(t).collect()}
    for i in (5, 100, 399):
        own = np.array(amounts[max(0, i - 240): i])
        assert abs(got[i]["merchant_amount_variance"] - own.var()) < 1e-3 * own.var()
        assert abs(got[i]["merchant_avg_amount"] - own.mean()) < 1e-6
