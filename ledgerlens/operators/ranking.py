"""Exact ranks and quantiles without a single-partition window or a buffer
that holds a group.

``orderBy`` over a whole table in one window partition puts every row in one
task. Instead: range-partition the (pre-aggregated) rows, checkpoint so the
partition assignment is fixed (and survives executor loss), count per
partition, prefix-sum the counts (one row per partition: tiny), and add each
row's position inside its partition.

Ranks and quantiles inside groups work on counts of distinct values and a
histogram: a value's bucket follows from the value alone (``_bucket``), the
buckets of a group are summed in order (as many rows as buckets, whatever the
group's size), and only values of one bucket are ordered in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def with_global_position(df: DataFrame, order_col: str, weight_col: str | None = None,
                         partitions: int | None = None, out: str = "pos") -> DataFrame:
    """Adds ``out`` = sum of ``weight_col`` (or 1) over all rows strictly
    before the row in ``order_col`` order (``order_col`` must be unique),
    plus ``out + '_incl'`` including the row itself."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = F.col(weight_col) if weight_col else F.lit(1)
    ranged = (df.withColumn("_w", w.cast("long")).repartitionByRange(n, order_col)
                .withColumn("_pid", F.spark_partition_id()))
    ranged = cut_lineage(ranged)
    totals = ranged.groupBy("_pid").agg(F.sum("_w").alias("_tot"))
    wp = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the partition count, safe to broadcast
    offsets = totals.select("_pid", F.coalesce(F.sum("_tot").over(wp), F.lit(0)).alias("_off"))
    wi = Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_before", F.coalesce(F.sum("_w").over(wi), F.lit(0)))
    res = local.join(F.broadcast(offsets), "_pid")
    return (res.withColumn(out, F.col("_off") + F.col("_before"))
               .withColumn(out + "_incl", F.col(out) + F.col("_w"))
               .drop("_pid", "_off", "_before", "_w"))


def percentile_table(t: DataFrame, col: str = "amount", out: str = "amount_percentile") -> DataFrame:
    """pandas ``rank(pct=True)`` per distinct value: (#smaller + (#equal + 1)
    / 2) / n, from counts of distinct values and a distributed prefix sum."""
    d = t.groupBy(col).agg(F.count(F.lit(1)).alias("_eq"))
    pos = with_global_position(d, col, weight_col="_eq", out="_lt")
    n = t.agg(F.count(F.lit(1))).scalar()
    return pos.select(col, ((F.col("_lt") + (F.col("_eq") + 1) / 2.0) / n).alias(out))


def _bucket(v) -> Column:
    """Order-preserving bucket of a number: 1024 per power of e, by sign."""
    scale, zero = 1024.0, 1_000_000
    size = F.floor(F.ln(F.abs(v)) * scale).cast("long") + zero
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on null-safe equal keys; the keys are kept once."""
    names = {k: f"_same_{k}" for k in keys}
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(F.col(names[k]))
    return left.join(right.withColumnsRenamed(names), cond).drop(*names.values())


def _histogram(t: DataFrame, groups: list[str], value: str, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(distinct values with count ``_n`` and bucket ``_b``, buckets with the
    rows before them ``_off``, their rows ``_bn`` and the group's ``_tot``)."""
    counts = (t.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v"))
              .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n")).withColumn("_b", _bucket(F.col("_v"))))
    hist = counts.groupBy(*groups, "_b").agg(F.sum("_n").alias("_bn"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(*groups, "_b", "_bn", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"),
                       F.sum("_bn").over(Window.partitionBy(*groups)).alias("_tot"))
    return counts, hist


def group_ranks(t: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, value, n_below, n_equal, n_group) for each distinct non-null
    value of each group."""
    counts, hist = _histogram(t, groups, value)
    inner = Window.partitionBy(*groups, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    c = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    return _same(c, hist, [*groups, "_b"]).select(
        *groups, F.col("_v").alias(value), (F.col("_off") + F.col("_in")).alias("n_below"),
        F.col("_n").alias("n_equal"), F.col("_tot").alias("n_group"))


def group_quantiles(t: DataFrame, groups: list[str], value: str, probs: dict[str, float], weight: str | None = None,
                    above: dict[str, str] | None = None) -> DataFrame:
    """(groups, one column per entry of ``probs``): exact quantiles with
    linear interpolation. Only values in the buckets that hold a wanted rank
    are ordered. With ``weight`` a row stands for so many. ``above``
    names, for an entry of ``probs``, a column with the number of rows beyond
    that quantile. Groups without a non-null value have no row."""
    counts, hist = _histogram(t, groups, value, weight)
    place = {n: p * (F.col("_tot") - 1) for n, p in probs.items()}
    want = [f(x).cast("long") for x in place.values() for f in (F.floor, F.ceil)]
    hit = F.lit(False)
    for k in want:
        hit = hit | ((F.col("_off") <= k) & (k < F.col("_off") + F.col("_bn")))
    c = _same(counts, hist.where(hit), [*groups, "_b"])
    inner = Window.partitionBy(*groups, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_lo", F.col("_off") + F.coalesce(F.sum("_n").over(inner), F.lit(0)))

    def at(rank, what="_v"):
        return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_lo") + F.col("_n")), F.col(what)))

    aggs = [F.max("_tot").alias("_tot")]
    for i in range(len(probs)):
        aggs += [at(want[2 * i]).alias(f"_q{i}"), at(want[2 * i + 1]).alias(f"_r{i}")]
    above = above or {}
    if above:
        c = c.withColumn("_hi", F.col("_lo") + F.col("_n"))
    for i, n in enumerate(probs):
        if n in above:
            aggs += [at(want[2 * i], "_hi").alias(f"_qh{i}"), at(want[2 * i + 1], "_hi").alias(f"_rh{i}")]
    found = c.groupBy(*groups).agg(*aggs)
    out = [(F.col(f"_q{i}") + (F.col(f"_r{i}") - F.col(f"_q{i}")) * (x - F.floor(x))).alias(n)
           for i, (n, x) in enumerate(place.items())]
    # nothing lies between the two values that the quantile is taken from
    out += [(F.col("_tot") - F.when(v >= F.col(f"_r{i}"), F.col(f"_rh{i}")).otherwise(F.col(f"_qh{i}"))).alias(above[n])
            for i, (n, v) in enumerate(zip(probs, list(out))) if n in above]
    return found.select(*groups, *out)
