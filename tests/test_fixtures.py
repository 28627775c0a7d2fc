"""Hand-computed fixture rows (tagger and merchant scenarios)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import merchant as M
from ledgerlens.operators import tagging as TG
from ledgerlens.sources.adapters import CANONICAL_COLUMNS

SCHEMA = ("transaction_id STRING, user_id STRING, merchant_name STRING, amount DOUBLE, timestamp TIMESTAMP_NTZ, "
          "category STRING, vpa STRING, source STRING, status STRING, disputed BOOLEAN, refunded BOOLEAN, "
          "rating DOUBLE, type STRING, memo STRING, direction STRING, caps_state STRING, payee_name STRING")


def _rows(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = dict.fromkeys(CANONICAL_COLUMNS)
        d.update(transaction_id=str(i), user_id="u1", source="fixture", status="success")
        d.update(r)
        full.append(tuple(d[c] for c in CANONICAL_COLUMNS))
    return spark.createDataFrame(full, SCHEMA)


def test_tagger_fixture(spark):
    cat = spark.createDataFrame(
        [(0, "Tea Point", "Food & Dining", ""), (1, "Chai Wala", "Food & Dining", ""),
         (2, "Starbucks", "Food & Dining", ""), (3, "Uber", "Transport", "")],
        "ord BIGINT, `Merchant Name` STRING, Category STRING, Subcategory STRING")
    ts = dt.datetime(2025, 1, 15, 14, 30)
    t = _rows(spark, [
        {"merchant_name": "Tea Point", "amount": 25.0, "timestamp": ts},
        {"merchant_name": "Starbucks", "amount": 120.0, "timestamp": ts},
        {"merchant_name": "Uber", "amount": 85.0, "timestamp": ts},
        {"merchant_name": "Tea Points", "amount": 30.0, "timestamp": ts},
        {"merchant_name": "Unknown Chai Shop", "amount": 15.0, "timestamp": ts},
        {"merchant_name": "Random New Service", "amount": 200.0, "timestamp": ts},
        {"merchant_name": None, "amount": 10.0, "timestamp": ts},
    ])
    got = {r.transaction_id: (r.category, round(r.confidence, 6), r.prediction_source, r.requires_review)
           for r in TG.tag(t, cat).collect()}
    assert got["0"] == ("Food & Dining", 0.9, "merchant_catalog", 0)
    assert got["1"] == ("Food & Dining", 0.9, "merchant_catalog", 0)
    assert got["2"] == ("Transport", 0.9, "merchant_catalog", 0)
    assert got["3"] == ("Food & Dining", 0.88, "fuzzy_match", 0)
    assert got["4"] == ("Food & Dining", 0.6, "keyword_rules", 1)
    assert got["5"] == ("Other", 0.4, "keyword_rules", 1)
    assert got["6"] == ("Other", 0.4, "keyword_rules", 1)


def test_merchant_fixture_swiggy(spark):
    rows = [(450, "2023-12-01 19:30"), (380, "2023-12-03 20:15"), (520, "2023-12-05 19:45"),
            (410, "2023-12-07 20:00"), (470, "2023-12-09 19:20")]
    t = _rows(spark, [{"vpa": "swiggy@paytm", "amount": float(a),
                       "timestamp": dt.datetime.strptime(s, "%Y-%m-%d %H:%M"), "disputed": False,
                       "refunded": False} for a, s in rows])
    p = M.profile(t).collect()[0]
    assert p.category == "food_delivery"
    assert p.risk_level == "low"
    assert p.trust_score == pytest.approx(0.9)
    assert p.frequency_score == pytest.approx(0.8)
    assert p.loyalty_score == pytest.approx(1.0)
    assert p.pricing_fairness == pytest.approx(0.945723, abs=1e-6)
    assert p.service_quality == pytest.approx(0.8)
    assert p.compliance_score == pytest.approx(0.8)
    assert p.user_sentiment == pytest.approx(0.7)
    assert p.growth_trend == pytest.approx(0.5)
    assert p.business_name == "Swiggy"


def test_merchant_fixture_expensive_store(spark):
    rows = [(2500, "2023-11-15 14:30", False), (1800, "2023-11-20 15:00", True), (3200, "2023-11-25 16:30", False)]
    t = _rows(spark, [{"vpa": "expensivestore@upi", "amount": float(a),
                       "timestamp": dt.datetime.strptime(s, "%Y-%m-%d %H:%M"), "disputed": d, "refunded": False}
                      for a, s, d in rows])
    market = spark.createDataFrame([("retail", 1500.0)], "category STRING, average_transaction DOUBLE")
    p = M.profile(t, market).collect()[0]
    assert p.category == "retail"
    assert p.pricing_fairness == pytest.approx(0.3)
    assert p.dispute_rate == pytest.approx(1 / 3)
    assert p.service_quality == pytest.approx(0.533333, abs=1e-6)
    assert p.user_sentiment == pytest.approx(0.5)
    ins = M.insights(p and M.profile(t, market)).collect()[0]
    assert ins.insights.split(",")[0] == "pricing_optimization"
    assert "service_warning" in ins.insights
    assert ins.estimated_savings == pytest.approx(375.0)
