"""The merchant catalog as CSV files (A1): header ``Merchant Name, Category,
Subcategory``, in this order; the order of the lines matters (first or last
line of a name wins).

Lines with too few or too many fields are kept apart and counted. The position
of a line, ``ord``, comes without a sort of the rows: inside a file split rows
are numbered as they are read, and splits are put in order by (file, offset),
one row per split."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

FIELDS = ["Merchant Name", "Category", "Subcategory"]
_LINE = "_corrupt_record"


def write_csv(catalog: DataFrame, path: str) -> str:
    """Files whose names and lines are in ``ord`` order."""
    catalog.orderBy("ord").select(*FIELDS).write.option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``ord``, rejected lines with ``ord``)."""
    schema = ", ".join(f"`{f}` STRING" for f in [*FIELDS, _LINE])
    raw = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", _LINE).csv(path))
    # read once: numbers follow from the reading order of one run
    read = cut_lineage(raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
                                  F.monotonically_increasing_id().alias("_n")))
    splits = read.groupBy("_file", "_at").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    lines = read.join(splits, ["_file", "_at"]).withColumn("ord", F.col("_before") + F.col("_n") - F.col("_first"))
    rows = lines.where(F.col(_LINE).isNull() & F.col("Merchant Name").isNotNull())
    rejected = lines.where(F.col(_LINE).isNotNull() | F.col("Merchant Name").isNull())
    return rows.select("ord", *FIELDS), rejected.select("ord", F.coalesce(_LINE, F.lit("")).alias("line"))
