"""Fuzzy matches by q-grams against all pairs; the tagger's two forms; SQL functions; top k."""
import random

from pyspark.sql import functions as F

from conftest import SF
from ledgerlens.functions import sqlfn
from ledgerlens.functions import text as X
from ledgerlens.operators import aggregates as A
from ledgerlens.operators import tagging as TG
from ledgerlens.plans.registry import load_all


def _all_pairs(names, cat):
    out = {}
    for m in names:
        best = None
        for o, (c, k) in enumerate(cat):
            if m and c and (m in c or c in m):
                score = min(len(m), len(c)) / max(len(m), len(c))
                if score > 0.6 and (best is None or score > best[1]):
                    best = (c, score, k)
        if best:
            out[m] = best
    return out


def test_fuzzy_match_equals_all_pairs(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    cat = list(dict.fromkeys(word(rng.randint(1, 12)) for _ in range(120)))
    names = [n for n in dict.fromkeys(word(rng.randint(0, 14)) for _ in range(200)) if n not in cat]
    long = "x" + "shop and more " * 142 + "end"
    cat += [long[3:1900], "ü€𝄞 café", "a", "ab"]
    names += [long, long[:1300], "ü€𝄞 café!", "éa", "abz", "z"]
    names = [n for n in dict.fromkeys(names) if n not in cat]
    rows = [(c, o, f"k{o}") for o, c in enumerate(cat)]
    got = TG.fuzzy_match(spark.createDataFrame([(n,) for n in names], "m string"), spark.createDataFrame(rows, "c string, c_ord int, c_cat string"))
    got = {r["m"]: (r["match"], r["score"], r["category"]) for r in got.collect()}
    want = _all_pairs(names, [(c, f"k{o}") for o, c in enumerate(cat)])
    assert got == want and long in got and len(long) == 1992


def test_a_gram_that_all_names_share(spark):
    """Names of one pattern: the rarest gram keeps the candidates few."""
    names = spark.range(3000).select(F.format_string("Supplier#%09d x", F.col("id") * 2).alias("m"))
    cat = spark.range(3000).select(F.format_string("Supplier#%09d", F.col("id") * 3).alias("c"), F.col("id").alias("c_ord"), F.lit("k").alias("c_cat"))
    got = {r["m"]: r["match"] for r in TG.fuzzy_match(names, cat).collect()}
    assert got == {f"Supplier#{i:09d} x": f"Supplier#{i:09d}" for i in range(0, 6000, 6)}


def test_stream_and_batch_taggers_agree(spark):
    q = load_all()[0]
    a, b = (sorted(map(tuple, q[k](spark, SF).collect())) for k in ("catalog_tagger", "stream_tagging"))
    assert a == b


def test_sql_functions(spark):
    sqlfn.register(spark)
    rows = [(None, None), ("", ""), ("  Tea-Point  #9 ", "a@b@YBL"), ("É x", "none"), ("A\tB", "@")]
    df = spark.createDataFrame(rows, "name string, vpa string")
    want = df.select(X.normalize_name("name").alias("a"), X.vpa_handle("vpa").alias("b"), X.label_signature("name", X.vpa_handle("vpa")).alias("c")).collect()
    got = spark.sql("SELECT normalize_name(name) AS a, vpa_handle(vpa) AS b, label_signature(name, vpa_handle(vpa), NULL) AS c FROM {df}", df=df).collect()
    assert got == want


def test_top_k_cuts_before_the_shuffle(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    top = A.top_k(df, ["k"], [F.col("id").desc()], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert [r["id"] for r in top.where("k = 0").orderBy("rank").collect()][0] == 9998
