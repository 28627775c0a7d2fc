"""The steps of cross-validation read their rows once, with the same results."""
import hashlib
import math
import random

from conftest import SF
from pyspark.sql import functions as F

from ledgerlens.functions import text as X
from ledgerlens.operators import matrices as MX
from ledgerlens.operators import modelling as ML
from ledgerlens.operators import tagging as TG
from ledgerlens.plans.q_features import cap_states
from ledgerlens.sources.adapters import catalog, txn


def _counted(df, acc):
    def rows(it):
        for batch in it:
            acc.add(batch.num_rows)
            yield batch
    return df.mapInArrow(rows, df.schema)


def test_labels_are_split_in_one_pass(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(str(i), rng.choice("aaaabbc")) for i in range(700)] + [("x", "d"), ("y", None), ("7", "a"), ("7", "a")]
    labels = spark.createDataFrame(rows, "transaction_id string, label string").repartition(3)
    cuts = []
    monkeypatch.setattr(ML, "cut_lineage", lambda d, cut=ML.cut_lineage: cuts.append(d) or cut(d))
    ids, _ = ML.split_labels(labels)
    assert len(cuts) == 1
    want = []
    for y, c in enumerate(sorted({r[1] for r in rows if r[1]})):
        own = sorted((r[0] for r in rows if r[1] == c), key=lambda i: (int(hashlib.md5(i.encode()).hexdigest()[:15], 16), i))
        train = math.floor(len(own) * 0.8)
        want += [(i, c, float(y), "train" if k < math.floor(train * 0.75) else "calib" if k < train else "test") for k, i in enumerate(own)]
    assert sorted(map(tuple, ids.select("transaction_id", "label", "y", "split").collect())) == sorted(want)


def test_training_rows_are_joined_once(spark):
    t = txn(spark, SF)
    n = t.count()
    acc = spark.sparkContext.accumulator(0)
    ids = _counted(t.select("transaction_id"), acc)
    labels = TG.community_labels(TG.community_votes(t))
    rows = MX.parity(t, TG.catalog_dim(catalog(spark, SF)), labels, cap_states(spark, SF), ids)
    assert rows.count() == n and rows.agg(F.count_if(F.isnan("log_amount"))).first()[0] == 0
    assert acc.value == n


def test_ranks_of_the_folds_read_two_columns(spark, monkeypatch):
    rows = [(str(i), "ab"[i % 2], float(i % 2), "train", float(i)) for i in range(40)]
    parts = spark.createDataFrame(rows, "transaction_id string, label string, y double, split string, f double")
    seen = []
    monkeypatch.setattr(ML, "group_ranks", lambda d, *a, ranks=ML.group_ranks: seen.append(d) or ranks(d, *a))
    monkeypatch.setattr(ML, "RF_PARAMS", {**ML.RF_PARAMS, "numTrees": 2, "maxDepth": 2})
    mean, _ = ML.cross_validate(parts, ["f"], 2)
    assert 0 <= mean <= 1 and seen[0].columns == ["label", "_u"]


def test_one_pattern_normalises_as_two(spark):
    names = ["Tea  Point!", " A-B\t\nC ", "", "  ", "Ünï–cödé 7", "a b", "x\x0b\x0c\ry", "İstanbul & Co.", "😀b😀😀", None, "--", "a_b__c", " q"]
    d = spark.createDataFrame([(s,) for s in names], "s string")
    two = F.trim(F.regexp_replace(F.regexp_replace(F.lower("s"), r"[^a-z0-9\s]", " "), r"\s+", " "))
    for got, empty in ((X.normalize_name("s"), True), (X.normalize_label_name("s"), False)):
        want = F.when(F.col("s").isNull() | (F.lit(empty) & (F.col("s") == "")), F.lit("unknown")).otherwise(two)
        assert d.where(~got.eqNullSafe(want)).count() == 0
