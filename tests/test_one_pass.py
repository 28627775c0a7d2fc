"""Summaries that read their input once agree with plain Python."""
import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as A
from ledgerlens.operators import merchant as M

SCHEMA = ("transaction_id string, user_id string, vpa string, amount double, timestamp timestamp_ntz, category string, status string, "
          "disputed boolean, refunded boolean, rating double")


def _rows(n=600):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    return [(str(i), rng.choice(["u1", "u2", "u3"]), rng.choice(["a.food@x", "b.taxi@y", "c@z"]), rng.choice([0.0, None, rng.randint(1, 9**6) / 100]),
             rng.choice([None] + 9 * [start + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 200))]), rng.choice("pqrstvw"),
             rng.choice(["failed", "success", None]), rng.choice([True, False, None]), rng.choice([True, False]), None) for i in range(n)]


def test_profile_reads_its_input_once(spark):
    rows = _rows() + [("x", "u9", "once@z", 5.0, dt.datetime(2024, 5, 1), "p", None, None, None, None)]
    t = spark.createDataFrame(rows, SCHEMA)
    for key in (["vpa"], ["user_id", "vpa"]):
        p = M.profile(t, key=key)
        groups = {}
        for r in rows:
            groups.setdefault(tuple(r[1:3][-len(key):]), []).append(r)
        got = {tuple(r[k] for k in key): r for r in p.collect()}
        assert got.keys() == groups.keys()
        for k, own in groups.items():
            amounts = [r[3] or 0.0 for r in own]
            times = sorted(r[4] for r in own if r[4])
            gaps = [(b - a).days for a, b in zip(times, times[1:])]
            assert got[k]["transaction_count"] == len(own) and abs(got[k]["total_volume"] - sum(amounts)) < 1e-6
            assert abs(got[k]["_cv"] - np.std(amounts) / max(np.mean(amounts), 1.0)) < 1e-9
            assert (got[k]["mean_gap_days"] is None) if not gaps else abs(got[k]["mean_gap_days"] - np.mean(gaps)) < 1e-9
        growth = {tuple(r[k] for k in key): r["growth_trend"] for r in A.growth(t, key).collect()}
        assert all(abs(growth[k] - got[k]["growth_trend"]) < 1e-9 for k in growth)
        plan = p._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_spending_summary_counts_beyond_the_quantile(spark):
    rows = _rows()
    t = spark.createDataFrame(rows, SCHEMA)
    s = A.spending_summary(t)
    for r in s.collect():
        amounts = [x[3] for x in rows if x[1] == r["user_id"] and x[3] is not None]
        assert r["unusual_transactions"] == sum(a > np.quantile(amounts, 0.95) for a in amounts)
        spent = {}
        for x in rows:
            if x[1] == r["user_id"]:
                spent[x[5]] = spent.get(x[5], 0.0) + (x[3] or 0.0)
        assert r["top_categories"] == "|".join(sorted(spent, key=lambda c: (-spent[c], c))[:5])
        assert abs(r["average_transaction"] - np.mean(amounts)) < 1e-9 and r["transaction_count"] == sum(x[1] == r["user_id"] for x in rows)
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 3


def test_no_amounts_no_average(spark):
    t = spark.createDataFrame([("1", "u", "v", None, None, None, None, None, None, None)], SCHEMA)
    r = A.spending_summary(t).first()
    assert (r["total_spending"], r["average_transaction"], r["transaction_count"], r["unusual_transactions"], r["top_categories"]) == (
        None, None, 1, 0, "other")


def test_competition_reads_the_payments_once(spark, monkeypatch):
    from ledgerlens.plans import q_merchant as Q
    rows = _rows() + [("x", "u9", None, 5.0, None, "p", None, None, None, None), ("y", "u9", "once@z", None, None, "p", None, None, None, None)]
    seen = spark.sparkContext.accumulator(0)

    def value(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    t = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(Q, "pay", lambda spark, sf: t.mapInArrow(value, t.schema))
    got = sorted(map(tuple, Q.q_merchant_competition(spark, "").collect()), key=str)
    assert seen.value == len(rows)
    assert got == sorted(map(tuple, Q.finish(M.competition(M.profile(t, M.market_averages(t)))).collect()), key=str)


def test_market_of_merchants_is_that_of_payments(spark):
    t = spark.createDataFrame(_rows() + [("x", "u9", None, None, None, "p", None, None, None, None)], SCHEMA)
    for d in (t, t.where(F.col("amount").isNull())):
        want = {r[0]: r[1] for r in M.market_averages(d).collect()}
        got = {r[0]: r[1] for r in M.market_averages(M.profile(d)).collect()}
        assert got.keys() == want.keys() and all(got[k] == w if w is None else abs(got[k] - w) < 1e-9 * abs(w) for k, w in want.items())


def test_profile_without_series_has_the_same_columns(spark):
    t = spark.createDataFrame(_rows(), SCHEMA)
    whole, part = M.profile(t), M.profile(t, series=False)
    assert sorted({*whole.columns} - {*part.columns}) == ["frequency_score", "growth_trend", "mean_gap_days"]
    want = {r["vpa"]: r for r in whole.collect()}
    for r in part.collect():
        for c in part.columns:
            w = want[r["vpa"]][c]
            assert abs(r[c] - w) < 1e-9 * max(1, abs(w)) if isinstance(w, float) else r[c] == w, c
