"""The stored feature table: appends, folders read, point lookups, counters."""
import datetime as dt
import uuid

from pyspark.sql import functions as F

from ledgerlens.operators import featurestore as FS
from ledgerlens.session import ensure_checkpoint_dir

SCHEMA = ("feature_set string, version string, entity_id string, features map<string,double>, stored_at timestamp_ntz, "
          "ttl_seconds int, transaction_id string")


def test_store_append_and_get(spark):
    path = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    at = dt.datetime(2024, 1, 1, 12)
    FS.store(spark.createDataFrame([("s", "v1", "a", {"x": 1.0}, at, 3600, "1"), ("s", "v2", "a", {"x": 9.0}, at, 3600, "2"),
                                    ("t", "v1", "b", {"y": 2.0}, at, 60, "3")], SCHEMA), path)
    FS.store(spark.createDataFrame([("s", "v1", "a", {"x": 5.0}, at + dt.timedelta(minutes=5), 3600, "4")], SCHEMA), path)
    one = FS.get(spark, path, "s", "v1", "a", "2024-01-01T12:30:00").collect()
    assert [r["features"] for r in one] == [{"x": 5.0}]
    assert FS.get(spark, path, "s", "v1", "a", "2024-01-01T14:00:00").count() == 0
    assert FS.get(spark, path, "t", "v1", "zz", "2024-01-01T12:00:10").count() == 0
    assert FS.stored(spark, path).count() == 4
    files = FS.stored(spark, path, "t").select(F.input_file_name().alias("f")).distinct().collect()
    assert all("feature_set=t" in r["f"] for r in files)


def test_access_counts(spark):
    acc = spark.createDataFrame([("s", "get", True), ("s", "get", False), ("s", "store", False), ("t", "batch_get", False)],
                                "feature_set string, kind string, hit boolean")
    got = {r["feature_set"]: tuple(r)[1:] for r in FS.access_counts(acc).collect()}
    assert got == {"s": (1, 2, 0, 0, 0.5), "t": (0, 0, 1, 0, None)}


def _log(spark, rows):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(s, "v1", e, {"x": float(n)}, at + dt.timedelta(hours=h), ttl, str(n)) for n, (s, e, h, ttl) in enumerate(rows)], SCHEMA)


def _files(spark, path):
    return {r["f"] for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}


def test_compaction_rewrites_only_what_it_must(spark):
    path = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    rows = [("s", f"e{i}", h, 10 * 3600) for i in range(40) for h in (0, 5)] + [("t", f"e{i}", 0, 3600) for i in range(10)]
    FS.store(_log(spark, rows), path)
    before = _files(spark, path)
    dead = spark.createDataFrame([("s", "v1", "e1"), ("s", "v1", "absent"), ("u", "v1", "e2")], "feature_set string, version string, entity_id string")
    touched = FS.compact(spark, path, dead)
    assert len(touched) == 1 and touched[0][0] == "s"
    assert {r["entity_id"] for r in FS.stored(spark, path, "s").collect()} == {f"e{i}" for i in range(40)} - {"e1"}
    assert FS.stored(spark, path).count() == len(rows) - 2
    after = _files(spark, path)
    same = f"feature_set=s/version=v1/bucket={touched[0][2]}/"
    assert {f for f in before if same not in f} == {f for f in after if same not in f}
    assert FS.compact(spark, path, dead) == []  # nothing left to do
    # everything of set t expires; its folders go, s is left as it is
    FS.compact(spark, path, as_of="2024-01-01T06:00:00")
    assert FS.stored(spark, path, "t").count() == 0 and FS.stored(spark, path, "s").count() == 78
    FS.compact(spark, path, history=False)
    left = FS.stored(spark, path).collect()
    assert len(left) == 39 and {r["stored_at"].hour for r in left} == {5}
    assert FS.get(spark, path, "s", "v1", "e7", "2024-01-01T06:00:00").count() == 1
    assert FS.compact(spark, path, as_of="2030-01-01T00:00:00") and not _rows_left(spark, path)


def _rows_left(spark, path):
    try:
        return spark.read.parquet(path).count()
    except Exception:  # no folder is left
        return 0


def test_a_replayed_epoch_changes_nothing(spark):
    path = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    one, two = _log(spark, [("s", f"e{i}", 0, 60) for i in range(30)]), _log(spark, [("s", f"e{i}", 1, 60) for i in range(20, 50)])
    FS.store(one, path, 0)
    FS.store(two, path, 1)
    before = sorted(map(str, FS.stored(spark, path).collect()))
    FS.store(two, path, 1)
    FS.store(one, path, 0)
    assert sorted(map(str, FS.stored(spark, path).collect())) == before and len(before) == 60
    assert FS.latest(FS.stored(spark, path)).count() == 50


def test_point_lookup_reads_one_bucket(spark):
    path = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    FS.store(_log(spark, [("s", f"e{i}", 0, 60) for i in range(64)]), path)
    bucket = spark.read.parquet(path).where("entity_id = 'e5'").first()["bucket"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        one = FS.stored(spark, path, "s", "v1", "e5")
        plan = one._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert one.count() == 1
    assert f"= {bucket})" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
