"""Connected components of an edge table by alternating star contraction.

Both steps use one aggregated minimum per node and one join against it, so a
hub of any degree is summed before the shuffle and its join can be split; no
neighbour list is ever gathered. Each round is written to the shared folder
and the one before is removed."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), bigint; the
    component is its smallest node. Loops and repeated edges are allowed."""
    spark = edges.sparkSession
    start = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = Stage(spark, start, "edges")
    mark = _mark(now.df)
    while mark[0]:
        large = Stage(spark, _large_star(now.df), "large")
        small = Stage(spark, _small_star(large.df), "small")
        large.drop()
        new = _mark(small.df)
        now.drop()
        now = small
        if new == mark:
            break
        mark = new
    # every edge now joins a node to the smallest of its component
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return (now.df.filter("u <> v").select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(roots))


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _large_star(df: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or it)."""
    both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    loops = df.filter("u = v")
    moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(loops).distinct()


def _small_star(df: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself move to the smallest one."""
    least = df.groupBy("u").agg(F.min("v").alias("m"))
    joined = df.join(least, "u")
    down = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return down.unionByName(own).distinct()
