"""Stored tables: snapshots, the label store, the advice log, catalog files."""
import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import advice as AD
from ledgerlens.operators import labelstore as LS
from ledgerlens.session import ensure_checkpoint_dir
from ledgerlens.sources import catalog_csv, fs
from ledgerlens.sources.snapshots import ConcurrentUpdate, Snapshots

VOTE = "transaction_id string, merchant_name string, vpa_handle string, geohash5 string, category_name string, confidence double, ts timestamp_ntz"


def _new(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _files(spark, path):
    rows = spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()
    return {r["f"] for r in rows}


def _vote(i, name, category, confidence, day):
    return (str(i), name, "ybl", "", category, confidence, dt.datetime(2024, 1, day))


def test_a_reader_sees_whole_versions_only(spark):
    store = Snapshots(spark, _new(spark, "snap"))
    assert store.current() == (0, None)
    first = store.commit(0, lambda p: spark.range(3).write.parquet(p))

    def half(path):
        spark.range(100).write.parquet(path)
        assert store.current() == (1, first)  # not yet switched
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        store.commit(1, half)
    assert spark.read.parquet(store.current()[1]).count() == 3
    second = store.commit(1, lambda p: spark.range(5).write.parquet(p))
    with pytest.raises(ConcurrentUpdate):
        store.commit(1, lambda p: spark.range(7).write.parquet(p))
    assert store.current() == (2, second) and spark.read.parquet(second).count() == 5
    store.prune(keep=1)
    assert fs.names(spark, f"{store.root}/data") == [second.rsplit("/", 1)[1]]
    assert store.current() == (2, second)


def test_label_store_rewrites(spark):
    store = Snapshots(spark, _new(spark, "labels"))
    assert LS.entries(store).count() == 0 and LS.rejected(store).count() == 0
    LS.add_votes(store, spark.createDataFrame([_vote(1, "A", "Food", 0.6, 1), _vote(2, "A", "Bills", 0.7, 2), _vote(3, "B", "Food", 0.8, 1)], VOTE))
    _, path = store.current()
    spark.createDataFrame([('{"signature": "x", "vot',), ('{"votes": 3}',), ("not json",)], "value string").write.mode("append").text(f"{path}/entries")
    LS.add_votes(store, spark.createDataFrame([_vote(4, "A", "Travel", 0.9, 3), _vote(5, "C", "Food", 0.6, 3)], VOTE))
    LS.add_votes(store, spark.createDataFrame([], VOTE))
    got = sorted((r["category_name"], r["confidence"], r["votes"]) for r in LS.entries(store).collect())
    assert got == [("Food", 0.6, 1), ("Food", 0.8, 1), ("Travel", 0.9, 3)]
    lines = sorted(r["value"] for r in LS.rejected(store).collect())
    assert len(lines) == 3 and lines[-1] == '{"votes":3}' or "not json" in lines
    assert store.current()[0] == 3


def test_advice_log_replaces_its_own_days(spark):
    path = _new(spark, "advice")
    req = spark.createDataFrame(
        [("u", 1, 1, "q1", "goal_setting", dt.datetime(2024, 1, 1, 9)), ("u", 1, 3, "q2", "x", dt.datetime(2024, 1, 1, 10)),
         ("v", 2, 1, "q3", "x", dt.datetime(2024, 1, 2))],
        "user_id string, conv_id bigint, turn bigint, query string, context_type string, asked_at timestamp_ntz")
    log = AD.interactions(req)
    AD.write_log(log, path)
    before, files = sorted(map(tuple, AD.latest_interactions(AD.read_log(spark, path)).collect())), _files(spark, path)
    AD.write_log(log.where("day = '2024-01-02'"), path)
    assert sorted(map(tuple, AD.latest_interactions(AD.read_log(spark, path)).collect())) == before
    kept = {f for f in files if "day=2024-01-01" in f}
    assert kept and kept == {f for f in _files(spark, path) if "day=2024-01-01" in f}
    assert [r[:4] for r in before] == [("advice_u_20240101", "u", "2024-01-01", 2), ("advice_v_20240102", "v", "2024-01-02", 1)]
    assert before[0][4] == "q2"


def test_catalog_files(spark):
    path = _new(spark, "catalog")
    rows = [(i, f'Shop "{i}", Ltd', "Food & Dining" if i % 2 else None, f"s,{i}") for i in range(500)]
    cat = spark.createDataFrame(rows, "ord bigint, `Merchant Name` string, Category string, Subcategory string").repartition(5)
    catalog_csv.write_csv(cat, path)
    spark.createDataFrame([("only a name",), ("another",)], "`Merchant Name` string").coalesce(1).write.mode("append").option("header", True).csv(path)
    got, bad = catalog_csv.read_csv(spark, path)
    got = got.orderBy("ord").collect()
    assert [tuple(r)[1:] for r in got] == [r[1:] for r in rows]
    assert len({r["ord"] for r in got} | {r["ord"] for r in bad.collect()}) == 502
    assert sorted(r["line"] for r in bad.collect()) == ["another", "only a name"]


def test_line_numbers_of_a_split_file(spark, tmp_path):
    text = "Merchant Name,Category,Subcategory\n" + "".join(f"m{i:06d},c,s\n" for i in range(20_000))
    (tmp_path / "c.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows, bad = catalog_csv.read_csv(spark, str(tmp_path / "c.csv"))
        assert rows.select("ord").distinct().count() == 20_000 and bad.count() == 0
        assert rows.where("`Merchant Name` <> format_string('m%06d', ord)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
