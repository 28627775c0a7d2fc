"""Sharding by rendezvous hashing of a stable record key over weighted shards.

Every shard draws a pseudo-random number per key (from MD5 of key and shard)
and the shard with the best weighted draw wins, so a change of the shard list
moves only the rows whose winner changed: one more shard takes rows only into
itself. Built from DataFrame functions only.

Slots number the rows of a shard from 0 without gaps. They are dealt in two
steps, so that no shard is sorted in one task: rows fall into key-hash cells
of bounded size, cells get offsets from their counts (a running sum over one
row per cell), and rows are numbered inside their cell.

Edge cases: a null key is hashed as the empty string, so all its rows share
one shard; a null text has size ``overhead`` and the CRC of no bytes; repeated
rows share the shard and get slots of their own in an arbitrary but gapless
order; other columns are ignored; an empty table gives an empty result."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

CELL_ROWS = 20_000  # intended rows of a numbering cell
RUN_ROWS = 100_000  # equal rows unfolded at once


def draw(key: Column, shard: int) -> Column:
    """Uniform draw in (0, 1) of a key for a shard: 48 bits of MD5."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}"))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def score(key: Column, shard: int, weight: float) -> Column:
    """Weighted rendezvous score; the highest wins."""
    return -F.lit(float(weight)) / F.log(draw(key, shard))


def assign(df: DataFrame, weights: Sequence[float], key_col: str = "doc_id", out: str = "shard",
           grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Add ``out``: the shard (position in ``weights``) of each row; ties go
    to the smaller shard. ``grown`` names a column with the shard if one more
    shard of ``grown_weight`` joined."""
    if not len(weights) or min(weights) <= 0:
        raise ValueError("weights must be positive")
    key = F.col(key_col)
    scores = F.array(*[score(key, i, w) for i, w in enumerate(weights)])
    out_df = df.withColumn("_scores", scores).withColumn("_best", F.array_max("_scores"))
    out_df = out_df.withColumn(out, (F.array_position("_scores", F.col("_best")) - 1).cast("int"))
    if grown:
        last = len(weights)
        out_df = out_df.withColumn(grown, F.when(score(key, last, grown_weight) > F.col("_best"), F.lit(last))
                                   .otherwise(F.col(out)).cast("int"))
    return out_df.drop("_scores", "_best")


def number(rows: DataFrame, n_shards: int, n_rows: int, shard_col: str = "shard",
           out: str = "slot") -> DataFrame:
    """Add ``out``: a gapless number from 0 inside each shard. Equal rows are
    gathered with their count first, so a row repeated without end is one row
    of its cell; then each is numbered and unfolded again, in runs of at most
    ``RUN_ROWS``."""
    cols = rows.columns
    cells = max(1, math.ceil(n_rows / (n_shards * CELL_ROWS)))
    groups = (rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_cell", F.pmod(F.xxhash64(*cols), F.lit(cells)).cast("int")))
    counts = groups.groupBy(shard_col, "_cell").agg(F.sum("_n").alias("_in_cell"))
    before = Window.partitionBy(shard_col).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (counts.withColumn("_start", F.coalesce(F.sum("_in_cell").over(before), F.lit(0)))
              .drop("_in_cell"))
    order = (Window.partitionBy(shard_col, "_cell").orderBy(*[F.col(c).asc_nulls_first() for c in cols])
             .rowsBetween(Window.unboundedPreceding, -1))
    placed = (groups.withColumn("_pos", F.coalesce(F.sum("_n").over(order), F.lit(0)))
              .join(starts, [shard_col, "_cell"]).select(*cols, (F.col("_pos") + F.col("_start")).alias("_first"), "_n"))
    runs = placed.select(*cols, (F.col("_first") + F.col("_n") - 1).alias("_last"),
                         F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1, F.lit(RUN_ROWS))).alias("_from"))
    upto = F.least(F.col("_from") + RUN_ROWS - 1, F.col("_last"))
    return runs.select(*cols, F.explode(F.sequence(F.col("_from"), upto)).alias(out))


def shard(df: DataFrame, weights: Sequence[float], key_col: str = "doc_id", text_col: str = "text",
          overhead: int = 16) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(key_col), (F.length(text).cast("bigint") + overhead).alias("size"),
                     F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    # the slim rows are written once: the texts are read and hashed once
    rows = staged(assign(rows, weights, key_col, "shard", "grown_shard"), "shards")
    return number(rows, len(weights), rows.count())
