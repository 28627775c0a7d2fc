"""Ingest and splitting operators (A2–A4, B1 via JSON, J1, K2)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session

RECORD_SCHEMA = ("array<struct<transaction_id:string,user_id:string,merchant_name:string,"
                 "amount:string,timestamp:string>>")
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # keep microseconds through CSV
REQUIRED = ["user_id", "merchant_name", "amount", "timestamp"]
CSV_SCHEMA = ("transaction_id STRING, user_id STRING, merchant_name STRING, amount DOUBLE, timestamp TIMESTAMP_NTZ, "
              "category STRING, vpa STRING, source STRING")


def scratch_path(spark, name: str) -> str:
    return session.scratch_path(spark, "tables", name)


def json_batches(t: DataFrame, batch_rows: int = 100) -> DataFrame:
    """Group records into request-sized JSON arrays (at most ``batch_rows``
    consecutive ids per batch: bounded by construction)."""
    rec = F.struct(F.col("transaction_id"), F.col("user_id"), F.col("merchant_name"),
                   F.col("amount").cast("string").alias("amount"),
                   F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"))
    bid = F.floor(F.col("transaction_id").cast("long") / batch_rows)
    return t.groupBy(bid.alias("batch_id")).agg(F.to_json(F.collect_list(rec)).alias("payload"))


def ingest_json(batches: DataFrame, as_of: str) -> DataFrame:
    """A3: JSON array per request -> one row per record; a missing
    timestamp becomes the request time ``as_of``."""
    recs = batches.select("batch_id", F.inline(F.from_json("payload", RECORD_SCHEMA)))
    return recs.withColumn("timestamp", F.coalesce(F.col("timestamp"), F.lit(as_of)))


def validate(raw: DataFrame, default_user: str = "default_user") -> DataFrame:
    """B1: require amount, timestamp, merchant_name; unparsable amount or
    timestamp -> null -> row dropped; merchant null -> "Unknown"."""
    missing = [c for c in ("amount", "timestamp", "merchant_name") if c not in raw.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    d = raw.select(*[c for c in raw.columns if c not in ("amount", "timestamp", "merchant_name")],
                   F.expr("try_cast(amount AS DOUBLE)").alias("amount"),
                   F.expr("try_to_timestamp(timestamp)").cast("timestamp_ntz").alias("timestamp"),
                   F.coalesce(F.col("merchant_name"), F.lit("Unknown")).alias("merchant_name"))
    if "user_id" not in d.columns:
        d = d.withColumn("user_id", F.lit(default_user))
    return d.na.drop(subset=["amount", "timestamp"])


def training_rows(t: DataFrame, least: int = 100) -> DataFrame:
    """Rows with a positive amount; fewer than ``least`` of them are not
    enough to train on and give an empty table."""
    ok = t.where(F.col("amount") > 0)
    return ok if ok.limit(least).count() == least else ok.limit(0)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", TS_FORMAT).csv(path)
    return path


def read_csv(spark, path: str, schema: str = CSV_SCHEMA, required=REQUIRED) -> DataFrame:
    """A2: CSV scan by header name, without type inference. The files' own
    header decides what each column is: columns may come in any order, columns
    outside ``schema`` are ignored, optional ones that are absent are null, a
    missing required one is an error. Unparsable values become null."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    out = []
    for item in schema.split(","):
        name, kind = item.split()
        if name not in raw.columns:
            col = F.lit(None).cast(kind)
        elif kind == "TIMESTAMP_NTZ":
            col = F.coalesce(F.try_to_timestamp(F.col(name), F.lit(TS_FORMAT)), F.try_to_timestamp(F.col(name))).cast(kind)
        else:
            col = F.expr(f"try_cast(`{name}` AS {kind})")
        out.append(col.alias(name))
    return raw.select(*out)


def delta_union(recent: DataFrame, replay: DataFrame) -> DataFrame:
    """Recent samples weight 2, replay weight 1."""
    return recent.withColumn("weight", F.lit(2.0)).unionByName(replay.withColumn("weight", F.lit(1.0)))


def stratified_split(t: DataFrame, label: str, id_col: str, train_frac: float = 0.8,
                     bits: int = 16, calib_frac: float | None = None) -> DataFrame:
    """K2: exact per-class split: within each class, rows ordered by
    (md5-derived u, id); the first floor(frac * n_class) are train. With
    ``calib_frac`` those are split once more, in the same order and pass: the
    first floor(calib_frac * n_train) stay train, the rest are calib.

    Skew-safe: a histogram of u over 2**bits buckets per class (partial
    aggregation) locates the boundary buckets of each class; only rows in
    those are ranked individually."""
    u = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 15), 16, 10).cast("long")
    d = t.withColumn("_u", u).withColumn("_bk", F.shiftright(F.col("_u"), 60 - bits))
    hist = d.groupBy(label, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    wc = Window.partitionBy(label).orderBy("_bk").rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(label)
    hist = hist.select(label, "_bk", "_c", F.sum("_c").over(wc).alias("_cum"), F.sum("_c").over(tot).alias("_n"))
    hist = hist.withColumn("_k", F.floor(F.col("_n") * train_frac)).withColumn("_before", F.col("_cum") - F.col("_c"))
    cuts = ["_k"]
    if calib_frac is not None:
        hist = hist.withColumn("_kt", F.floor(F.col("_k") * calib_frac))
        cuts = ["_kt", "_k"]
    d = d.join(hist.select(label, "_bk", *cuts, "_before", "_cum"), [label, "_bk"])
    boundary = F.lit(False)
    for k in cuts:
        boundary = boundary | ((F.col("_before") < F.col(k)) & (F.col(k) < F.col("_cum")))
    inner = Window.partitionBy(label, "_bk").orderBy("_u", id_col)
    rank = F.when(boundary, F.row_number().over(inner))
    d = d.withColumn("_r", rank)

    def first(k: str) -> Column:
        return (F.when(F.col("_cum") <= F.col(k), True).when(F.col("_before") >= F.col(k), False)
                 .otherwise(F.col("_before") + F.col("_r") <= F.col(k)))
    split = F.when(first(cuts[0]), "train")
    if calib_frac is not None:
        split = split.when(first("_k"), "calib")
    return d.withColumn("split", split.otherwise("test")).drop("_u", "_bk", *cuts, "_before", "_cum", "_r")
