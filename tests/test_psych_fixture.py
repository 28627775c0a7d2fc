"""Psychology profile of the first nudge scenario user (hand-computed)."""
import datetime as dt

import pytest

from ledgerlens.operators import nudges as N
from test_fixtures import _rows


def test_demo_user_1_profile(spark):
    hist = [(800.0, dt.datetime(2024, 1, 17, 13)), (1200.0, dt.datetime(2024, 1, 19, 20)),
            (600.0, dt.datetime(2024, 1, 21, 12))]
    t = _rows(spark, [{"amount": a, "timestamp": ts, "category": "food", "type": "purchase"} for a, ts in hist])
    p = N.psych_profile(t).collect()[0]
    assert p.commitment_tendency == pytest.approx(0.712180, abs=1e-6)
    assert p.temporal_preference == pytest.approx(1 / 3)
    assert p.spending_impulsiveness == 0.0
    assert p.loss_aversion_sensitivity == 0.5 and p.social_influence_susceptibility == 0.5
    assert p.anchoring_susceptibility == 0.5


def test_money_text_is_engine_stable(spark):
    from pyspark.sql import functions as F
    r = spark.range(1).select(N.money(F.lit(263.895)).alias("a"), N.money(F.lit(6.625)).alias("b"),
                              N.fixed(F.lit(-1.25), 1).alias("c")).collect()[0]
    assert (r.a, r.b, r.c) == ("263.90", "6.63", "-1.3")  # 263.895 * 100 is exactly 26389.5 in IEEE
