"""Group quantiles and ranks against Spark's exact aggregates."""
import random

from pyspark.sql import functions as F

from ledgerlens.operators import ranking as R


def test_quantiles_and_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, -1.5, rng.uniform(-1e9, 1e9), round(rng.uniform(0, 20), 2), 7.0, None])) for _ in range(2000)]
    rows += [("one", 3.0), ("none", None), ("tiny", 5e-324), ("tiny", -5e-324), ("two", 1.0), ("two", 2.0)] + [("hot", 4.2)] * 500
    t = spark.createDataFrame(rows, "g string, v double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r for r in R.group_quantiles(t, ["g"], "v", probs).collect()}
    want = {r["g"]: r for r in t.groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()]).collect()}
    assert set(got) == {g for g, r in want.items() if r["p50"] is not None}
    for g, r in got.items():
        assert all(abs(r[n] - want[g][n]) <= 1e-9 * max(1, abs(want[g][n])) for n in probs), (g, r, want[g])
    ranks = {(r["g"], r["v"]): (r["n_below"], r["n_equal"], r["n_group"]) for r in R.group_ranks(t, ["g"], "v").collect()}
    for (g, v), (below, equal, n) in list(ranks.items())[::17]:
        own = [x for k, x in rows if k == g and x is not None]
        assert (below, equal, n) == (sum(x < v for x in own), sum(x == v for x in own), len(own))


def test_empty(spark):
    t = spark.createDataFrame([], "g string, v double")
    assert R.group_quantiles(t, ["g"], "v", {"p": 0.5}).collect() == [] and R.group_ranks(t, ["g"], "v").collect() == []
