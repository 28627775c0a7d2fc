"""CSV scans by header, the payments fact on replaced files, shared folder."""
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF
from ledgerlens.operators import ingest as IN
from ledgerlens.sources.adapters import pay


def _csv(tmp_path, text):
    (tmp_path / "t.csv").write_text(text)
    return str(tmp_path / "t.csv")


def test_missing_column_is_refused(spark, tmp_path):
    path = _csv(tmp_path, "transaction_id,user_id,merchant_name,timestamp\n1,u,m,2024-01-01T00:00:00\n")
    with pytest.raises(ValueError, match="amount"):
        IN.read_csv(spark, path)


def test_columns_are_taken_by_name(spark, tmp_path):
    path = _csv(tmp_path, "vpa,extra,timestamp,amount,merchant_name,user_id\nv@x,9,2024-01-01T10:00:00.5,12.5,m,u\n"
                          ",,2024-01-02 11:00:00,abc,,w\nz,,bad,1,m,u\n")
    rows = IN.read_csv(spark, path).orderBy("user_id", F.col("amount").desc()).collect()
    assert [r["amount"] for r in rows] == [12.5, 1.0, None]
    assert rows[0]["vpa"] == "v@x" and rows[0]["transaction_id"] is None and rows[0]["timestamp"].hour == 10
    assert rows[1]["timestamp"] is None and rows[2]["timestamp"].hour == 11
    kept = IN.validate(IN.read_csv(spark, path)).collect()
    assert [r["amount"] for r in kept] == [12.5]


def test_training_gate(spark):
    t = spark.range(200).select((F.col("id") - 80).cast("double").alias("amount"))
    assert IN.training_rows(t, 100).count() == 119
    assert IN.training_rows(t, 120).count() == 0


def test_a_replaced_part_file_is_seen(spark, tmp_path):
    base = str(tmp_path)
    for name in ("orders", "supplier", "part"):
        os.symlink(f"{SF}/{name}.parquet", f"{base}/{name}.parquet")
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    for i in range(2):
        li.where(F.col("l_orderkey") % 2 == i).coalesce(1).write.mode("append").parquet(f"{base}/lineitem.parquet")
    before = pay(spark, base).agg(F.sum("amount")).first()[0]
    parts = sorted(f for f in os.listdir(f"{base}/lineitem.parquet") if f.startswith("part-"))
    other = str(tmp_path / "new")
    (spark.read.parquet(f"{base}/lineitem.parquet/{parts[0]}").withColumn("l_extendedprice", F.col("l_extendedprice") + 1)
     .coalesce(1).write.parquet(other))
    new = next(f for f in os.listdir(other) if f.startswith("part-"))
    os.replace(f"{other}/{new}", f"{base}/lineitem.parquet/{parts[0]}")
    crc = f"{base}/lineitem.parquet/.{parts[0]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    n = spark.read.parquet(f"{base}/lineitem.parquet/{parts[0]}").count()
    assert abs(pay(spark, base).agg(F.sum("amount")).first()[0] - before - n) < 1e-3


def test_cluster_without_shared_folder_is_refused():
    from ledgerlens import session

    class Ctx:
        master = "spark://h:1"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Ctx()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
