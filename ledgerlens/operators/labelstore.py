"""Community labels as a stored JSON table (A5): one object per line and
signature, read, merged with new votes and rewritten as the next snapshot.

Lines that are no such object are kept apart (``rejected``) and carried over
from version to version; they never stop a rewrite. A signature that stands in
several lines counts with the line that has most votes."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots
from .tagging import community_labels

FIELDS = ["signature", "category_name", "confidence", "votes"]
SCHEMA = "signature STRING, category_name STRING, confidence DOUBLE, votes BIGINT"


def scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected lines) of a version's JSON files."""
    raw = (spark.read.schema(f"{SCHEMA}, _line STRING").option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_line").json(f"{path}/entries"))
    bad = F.col("_line").isNotNull() | F.col("signature").isNull()
    entries = raw.where(~bad).groupBy("signature").agg(
        F.max(F.struct(F.coalesce("votes", F.lit(0)).alias("votes"), "confidence", "category_name")).alias("_e"))
    entries = entries.select("signature", "_e.category_name", "_e.confidence", "_e.votes")
    return entries, raw.where(bad).select(F.coalesce("_line", F.to_json(F.struct(*FIELDS))).alias("value"))


def entries(store: Snapshots) -> DataFrame:
    """The current labels; an empty table before the first version."""
    _, path = store.current()
    return scan(store.spark, path)[0] if path else store.spark.createDataFrame([], SCHEMA)


def rejected(store: Snapshots) -> DataFrame:
    """Lines of the current version that are no entry, and those of earlier
    versions."""
    _, path = store.current()
    if path is None:
        return store.spark.createDataFrame([], "value STRING")
    return scan(store.spark, path)[1].unionByName(store.spark.read.schema("value STRING").text(f"{path}/rejected"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Votes add up; the newer votes' category and confidence win."""
    n = new.select("signature", *[F.col(c).alias(f"_{c}") for c in FIELDS[1:]])
    both = old.join(n, "signature", "full")
    return both.select("signature", F.coalesce("_category_name", "category_name").alias("category_name"),
                       F.coalesce("_confidence", "confidence").alias("confidence"),
                       (F.coalesce("votes", F.lit(0)) + F.coalesce("_votes", F.lit(0))).alias("votes"))


def add_votes(store: Snapshots, votes: DataFrame) -> str:
    """Read, merge, rewrite, switch. A concurrent writer makes it fail; the
    caller may start over from the version that won."""
    version, _ = store.current()
    merged, bad = merge(entries(store), community_labels(votes)), rejected(store)

    def write(path: str) -> None:
        merged.select(*FIELDS).write.json(f"{path}/entries")
        bad.write.text(f"{path}/rejected")
    return store.commit(version, write)
