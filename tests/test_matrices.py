"""Model-input matrices on rows that the given tables lack."""
import datetime as dt
import math

from ledgerlens.operators import matrices as MX
from ledgerlens.operators import modelling as ML


def test_user_average_of_zero(spark):
    """After a month of zero amounts the deviation from their average is a
    float division by zero (infinity, NaN for 0 / 0), as in the oracle."""
    day = dt.datetime(2024, 3, 1)
    data = [("0", "u", 0.0, 0), ("1", "u", 7.0, 1), ("2", "u", 7.0, 2), ("3", "v", 0.0, 0), ("4", "v", 0.0, 1)]
    t = spark.createDataFrame(
        [(i, u, "Uber", a, day + dt.timedelta(hours=h), "c", "uber@ybl", None) for i, u, a, h in data],
        "transaction_id string, user_id string, merchant_name string, amount double, timestamp timestamp_ntz, category string, "
        "vpa string, memo string")
    catalog = spark.createDataFrame([(0, "Uber", "Transport", "x")], "ord BIGINT, `Merchant Name` STRING, Category STRING, Subcategory STRING")
    caps = spark.createDataFrame([("u", "c", "2024-03", 0)], "user_id string, category string, month string, caps_state_int int")
    rows = {r["transaction_id"]: r for r in MX.advanced(t, catalog, caps).collect()}
    dev = {k: r["amount_deviation_from_user_avg"] for k, r in rows.items()}
    assert dev["0"] == 1.0 and dev["1"] == math.inf and dev["2"] == 1.0 and math.isnan(dev["4"])
    assert [rows[k]["unusual_amount_flag"] for k in "0124"] == [0, 1, 0, 1]


def test_forest_takes_values_that_are_not_finite(spark):
    """Infinities, NaN and nulls of the advanced columns reach the forest as
    finite numbers in the same order."""
    d = spark.createDataFrame([(str(i), float(i), i) for i in range(40)]
                              + [("a", math.inf, 1), ("b", math.nan, 2), ("c", None, None), ("d", -math.inf, 3)],
                              "transaction_id string, x double, n int")
    m = ML.finite(d, ["x", "n"])
    got = {r["transaction_id"]: (r["x"], r["n"]) for r in m.collect()}
    assert got["7"] == (7.0, 7.0) and got["b"] == (0.0, 2.0) and got["c"] == (0.0, 0.0)
    assert got["d"][0] < 0 and 39 < got["a"][0] < math.inf and got["d"][0] > -math.inf
    parts = m.selectExpr("*", "n % 2 AS y", "'train' AS split")
    assert ML.fit(parts, ["x", "n"], numTrees=2, maxDepth=2).stages[-1].getNumTrees == 2


def _counted(spark, n):
    """Rows that count how often they are computed."""
    seen = spark.sparkContext.accumulator(0)

    def value(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    rows = spark.range(n).selectExpr("CAST(id AS STRING) AS transaction_id", "CAST(id % 2 AS DOUBLE) AS y", "CAST(id AS DOUBLE) AS x", "'test' AS split")
    return rows.mapInPandas(value, rows.schema), seen


def test_standardised_matrix_is_computed_once(spark):
    rows, seen = _counted(spark, 50)
    got = [r["x"] for r in MX.standardize(rows, ["x"]).collect()]
    assert abs(sum(got)) < 1e-9 and seen.value == 50


def test_rows_are_scored_once_for_all_metrics(spark):
    rows, seen = _counted(spark, 50)

    class Model:
        def transform(self, d):
            return d.selectExpr("*", "y AS prediction")
    assert set(ML.evaluate(Model(), rows).values()) == {1.0} and seen.value == 50


def test_matrix_is_one_table_without_copies(spark):
    """The matrix is read as packed columns; neither a persisted copy nor the
    shuffle files of its job are left beside it."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}
    seen = []

    def build(ids):
        seen.append(shuffled())
        return rows.repartition(5).select("transaction_id", "x", "z")
    rows = spark.range(300).selectExpr("CAST(id AS STRING) AS transaction_id", "CAST(id AS DOUBLE) AS x", "IF(id % 3 = 0, NULL, id % 2) AS z", "CAST(id % 2 AS STRING) AS label")
    persisted = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    parts, _ = ML.prepare(build, rows.select("transaction_id", "label"))
    assert shuffled() <= seen[0]
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() <= persisted
    assert parts.inputFiles() and all(f.endswith(".parquet") for f in parts.inputFiles())
    assert sorted(map(str, parts.select("transaction_id", "x", "z", "label").collect())) == sorted(
        map(str, rows.select("transaction_id", "x", "z", "label").collect())) and parts.where("split = 'train'").count() == 180


def test_training_reads_a_table_file_by_file(spark):
    """As many tasks as the job that wrote the table had, whatever the cores."""
    from ledgerlens.session import file_by_file, stored
    key = "spark.sql.files.minPartitionNum"
    old, n = spark.conf.get(key, None), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows = stored(spark.range(4000).selectExpr("id % 1000 AS id").groupBy("id").count(), "files")
        with file_by_file(spark):
            assert rows.where("id >= 0").rdd.getNumPartitions() == 23
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert spark.conf.get(key, None) == old and rows.count() == 1000
