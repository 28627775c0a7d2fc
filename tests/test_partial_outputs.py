"""Outputs that the gate's tables cannot vary: per-user merchant profiles and
latency breaches."""
from pyspark.sql import functions as F

from conftest import SF
from ledgerlens.operators import merchant as M
from ledgerlens.operators import registry_tables as RT
from ledgerlens.sources.adapters import pay


def test_profile_by_user_equals_the_profile_of_the_users_rows(spark):
    t = pay(spark, SF).cache()
    market = M.market_averages(t)
    both = M.profile(t, market, ["user_id", "vpa"]).cache()
    assert both.count() == t.select("user_id", "vpa").distinct().count()
    user = t.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()["user_id"]
    own = M.profile(t.where(F.col("user_id") == user), market)
    got = both.where(F.col("user_id") == user).drop("user_id").select(*own.columns)
    assert own.exceptAll(got).count() == 0 and got.exceptAll(own).count() == 0


def test_latency_breach(spark):
    rows = [("auto_tagging", "m", 1, "Staging", {"accuracy": 0.95, "latency_ms": 250.0}),
            ("auto_tagging", "m", 2, "Staging", {"accuracy": 0.5, "latency_ms": 200.0}),
            ("trust_scoring", "m", 1, "Staging", {"accuracy": 0.9})]
    runs = spark.createDataFrame(rows, "component string, model string, version int, stage string, metrics map<string,double>")
    got = {(r["component"], r["version"]): (r["accuracy_breach"], r["latency_breach"], r["target_met"]) for r in
           RT.breaches(runs, RT.thresholds(spark)).collect()}
    assert got == {("auto_tagging", 1): (0, 1, 1), ("auto_tagging", 2): (1, 0, 0), ("trust_scoring", 1): (0, None, 1)}
