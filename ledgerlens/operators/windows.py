"""Ordered per-key operators that stay exact when one key holds a large share
of all rows.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends a whole key to one task.
Here every ordered computation is split by *time bucket* as well:

* within-bucket work uses ``partitionBy(key, bucket)``;
* what crosses a bucket boundary (the previous timestamp, the running count
  of earlier buckets) comes from a per-(key, bucket) summary whose size is
  the number of non-empty buckets of a key, not its number of rows;
* trailing range windows read running sums and maxima of one (key, hour) at
  probe events and add what the whole hours in between hold
  (``rolling_stats``).

All are exact; rows are multiplied by a constant, never paired.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as T

DEFAULT_BUCKET_SECONDS = 3600  # hour buckets: a hot key spreads over its hours
SMALL_KEY = 512  # rows of a key whose frames are read row by row: the most that a frame can hold
MOST_BROADCAST = 500_000  # larger keys that are broadcast as a list


def _bucket(ts: str, seconds: int) -> Column:
    return F.floor(T.epoch_seconds(ts) / F.lit(float(seconds))).cast("long")


def with_prev_ts(df: DataFrame, keys: list[str], ts: str, tiebreak: str,
                 out: str = "prev_ts", bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Adds ``out`` = timestamp of the previous row of the same key in
    (ts, tiebreak) order; null for the first row."""
    d = df.withColumn("_b", _bucket(ts, bucket_seconds))
    w = Window.partitionBy(*keys, "_b").orderBy(F.col(ts), F.col(tiebreak))
    d = d.withColumn("_p", F.lag(ts).over(w))
    bmax = d.groupBy(*keys, "_b").agg(F.max(ts).alias("_bmax"))
    wb = Window.partitionBy(*keys).orderBy("_b")
    bmax = bmax.select(*keys, "_b", F.lag("_bmax").over(wb).alias("_pb"))
    d = d.join(bmax, [*keys, "_b"], "left")
    return d.withColumn(out, F.coalesce("_p", "_pb")).drop("_b", "_p", "_pb")


def with_running_count(df: DataFrame, keys: list[str], ts: str, tiebreak: str,
                       out: str = "running_count",
                       bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Adds ``out`` = 1-based position of the row within its key in (ts,
    tiebreak) order (pandas ``cumcount() + 1`` on time-sorted input)."""
    d = df.withColumn("_b", _bucket(ts, bucket_seconds))
    w = Window.partitionBy(*keys, "_b").orderBy(F.col(ts), F.col(tiebreak))
    d = d.withColumn("_r", F.row_number().over(w))
    bc = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bc = bc.select(*keys, "_b", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_before"))
    d = d.join(bc, [*keys, "_b"], "left")
    return d.withColumn(out, (F.col("_r") + F.col("_before")).cast("long")).drop("_b", "_r", "_before")


def with_next_ts(df: DataFrame, keys: list[str], ts: str, tiebreak: str,
                 out: str = "next_ts", bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Mirror of ``with_prev_ts``: timestamp of the next row of the key."""
    d = df.withColumn("_b", _bucket(ts, bucket_seconds))
    w = Window.partitionBy(*keys, "_b").orderBy(F.col(ts), F.col(tiebreak))
    d = d.withColumn("_n", F.lead(ts).over(w))
    bmin = d.groupBy(*keys, "_b").agg(F.min(ts).alias("_bmin"))
    wb = Window.partitionBy(*keys).orderBy("_b")
    bmin = bmin.select(*keys, "_b", F.lead("_bmin").over(wb).alias("_nb"))
    d = d.join(bmin, [*keys, "_b"], "left")
    return d.withColumn(out, F.coalesce("_n", "_nb")).drop("_b", "_n", "_nb")


def rolling_stats(df: DataFrame, keys: list[str], ts: str, row_id: str, sums: dict | None = None,
                  maxes: dict | None = None, distincts: dict | None = None,
                  include_current: bool = False, parts: list[Column] | None = None) -> DataFrame:
    """Trailing-window statistics per row: ``(row_id, outputs)``.

    ``sums`` / ``maxes`` / ``distincts`` map an output name to (value Column,
    window seconds, a multiple of the hour); counts are sums of 1. Frames are
    ``[t - W, t)`` (history only) or, for sums, ``(t - W, t]`` with
    ``include_current``. Sums over no rows are 0.0, maxima null, distinct
    counts 0. A sum may name a third element i: it then runs over the key's
    rows that share the row's value of ``parts[i - 1]`` (0 or none: the whole
    key), so counts by key and by key and category come from one pass. Join the result to ``df`` by ``row_id``: it is already
    partitioned by it, so several results share one shuffle of ``df``.

    Only the id, key, time and values travel. A key with at most ``SMALL_KEY``
    rows is read as it stands, in range windows over its rows. Each row of a
    larger key becomes a value event and probe events at its frame bounds; all
    ordered work is inside one (key, hour) plus a prefix over one summary row
    per hour of a key, so a key with a third of all rows still spreads over
    its hours:

    * sum(frame) = S(upper) - S(lower), with S counted from the start of a
      block as wide as the widest window;
    * max(frame) = the greatest of the head of the row's hour, the whole hours
      in between, and the tail of the hour that holds t - W;
    * distinct(frame): an item seen at t_i counts for t in (t_i, e_i], where
      e_i is the earlier of its next occurrence and t_i + W; that is the
      number of arrivals before t less the departures before t."""
    sums, maxes, distincts = sums or {}, maxes or {}, distincts or {}
    sums = {name: (spec[0], int(spec[1]), spec[2] if len(spec) > 2 else 0) for name, spec in sums.items()}
    maxes = {name: (v, int(w)) for name, (v, w) in maxes.items()}
    widths = sorted({int(spec[1]) for d in (sums, maxes, distincts) for spec in d.values()})
    if include_current and (maxes or distincts):
        raise ValueError("include_current applies to sums only")
    if any(w % DEFAULT_BUCKET_SECONDS for w in widths) or (maxes and min(w for _, w in maxes.values()) <= DEFAULT_BUCKET_SECONDS):
        raise ValueError("window widths must be whole hours (more than one for maxima)")
    K = [f"_k{i}" for i in range(len(keys))]
    # a value that several statistics name as one Column travels once
    values = {id(v): v for v, *_ in sums.values()}
    at = {k: f"_v{i}" for i, k in enumerate(values)}
    items = list(dict.fromkeys(str(v) for v, _ in distincts.values()))
    first = {str(v): v for v, _ in distincts.values()}
    # of a key that is not known an item counts once an hour
    unknown = F.lit(False)
    for k in keys:
        unknown = unknown | F.col(k).isNull()
    first = {name: F.when(unknown, F.concat(_bucket(ts, DEFAULT_BUCKET_SECONDS).cast("string"), F.lit(" "), v.cast("string")))
             .otherwise(F.concat(F.lit("="), v.cast("string"))) for name, v in first.items()}
    base = df.where(F.col(ts).isNotNull()).select(
        F.col(row_id).alias("_rid"), *[_known(F.col(k)).alias(n) for k, n in zip(keys, K)], T.epoch_micros(ts).alias("_t"), F.col(ts).alias("_ts"),
        *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(at[k]) for k, v in values.items()],
        *[v.cast("double").alias(f"_x{i}") for i, (v, _) in enumerate(maxes.values())],
        *[first[name].alias(f"_i{i}") for i, name in enumerate(items)],
        *[_known(c).alias(f"_part{i}") for i, c in enumerate(parts or [])])
    sums = {name: (at[id(v)], w, level) for name, (v, w, level) in sums.items()}
    distincts = {name: (f"_i{items.index(str(v))}", int(w)) for name, (v, w) in distincts.items()}
    count = base.groupBy(*K).agg(F.count(F.lit(1)).alias("_n"))
    large = count.where(F.col("_n") > SMALL_KEY).select(*K)
    n = count.agg(F.count_if(F.col("_n") > SMALL_KEY).alias("large"), F.count(F.lit(1)).alias("all")).first()
    rows = []
    if not 0 < n["large"] < n["all"]:
        small = large = base
    else:
        named = F.broadcast(large) if n["large"] <= MOST_BROADCAST else large
        small, large = base.join(named, K, "left_anti"), base.join(named, K, "left_semi")
    if n["large"] < n["all"] or not n["all"]:
        rows.append(_frames_by_row(small, K, sums, maxes, distincts, include_current))
    if n["large"]:
        rows.append(_frames_by_hour(large, K, sums, maxes, distincts, include_current, widths, items, len(parts or [])))
    # each row of ``found`` holds its part of the outputs; rows that come
    # several times share an id and are averaged
    found = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    outs = [(F.col(f"_o_{name}") / F.col("_times")).alias(name) for name in sums] + [F.col(f"_o_{name}").alias(name) for name in maxes]
    outs += [F.round(F.col(f"_o_{name}") / F.col("_times")).cast("long").alias(name) for name in distincts]
    return found.groupBy(F.col("_rid").alias(row_id)).agg(
        F.sum("_times").alias("_times"), *[F.sum(f"_o_{name}").alias(f"_o_{name}") for name in [*sums, *distincts]],
        *[F.max(f"_o_{name}").alias(f"_o_{name}") for name in maxes]).select(row_id, *outs)


def _known(c: Column) -> Column:
    """The value as text that is never null, so rows join and windows form on
    the same columns."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _frames_by_row(base: DataFrame, K: list[str], sums: dict, maxes: dict, distincts: dict, include_current: bool) -> DataFrame:
    """Frames of keys with few rows, read row by row."""
    def frame(w: int, level: int = 0):
        own = Window.partitionBy(*K, *([f"_part{level - 1}"] if level else [])).orderBy("_t")
        return own.rangeBetween(-w * 1_000_000 + 1, 0) if include_current else own.rangeBetween(-w * 1_000_000, -1)
    return base.select(
        "_rid", F.lit(1).cast("long").alias("_times"),
        *[F.coalesce(F.sum(v).over(frame(w, level)), F.lit(0.0)).alias(f"_o_{name}") for name, (v, w, level) in sums.items()],
        *[F.max(f"_x{i}").over(frame(w)).alias(f"_o_{name}") for i, (name, (_, w)) in enumerate(maxes.items())],
        *[F.size(F.collect_set(item).over(frame(w))).cast("double").alias(f"_o_{name}") for name, (item, w) in distincts.items()])


def _frames_by_hour(base: DataFrame, K: list[str], sums: dict, maxes: dict, distincts: dict, include_current: bool,
                    widths: list[int], items: list[str], n_parts: int) -> DataFrame:
    """Frames of keys with many rows, from events and hours: a row per probe."""
    hour_us, block_us = DEFAULT_BUCKET_SECONDS * 1_000_000, max(widths) * 1_000_000
    for i in range(len(items)):
        base = with_next_ts(base, [*K, f"_i{i}"], "_ts", "_rid", out=f"_nx{i}")
    for i, (item, w) in enumerate(distincts.values()):
        leaves = F.least(F.coalesce(T.epoch_micros(f"_nx{item[2:]}"), F.lit(2**62)), F.col("_t") + F.lit(w * 1_000_000))
        base = base.withColumn(f"_e{i}", F.when(F.col(item).isNotNull(), leaves))
    # events: 0 the row's values and upper probe, 1 + j lower probe of window j,
    # 1 + len(widths) + i departure of distinct statistic i; level 0 is the
    # whole key, level i the rows with the same parts[i - 1]
    leave = 1 + len(widths)
    levels = sorted({level for *_, level in sums.values()} | ({0} if maxes or distincts else set()))
    kinds = [F.struct(F.lit(lv).alias("lv"), F.lit(k).alias("kind")) for lv in levels
             for k in [0, *[1 + widths.index(w) for w in widths if _probes(sums, maxes, lv, w)],
                       *[leave + i for i in range(len(distincts) if lv == 0 else 0)]]]
    wide = F.lit(0).cast("long")  # how far an event lies before its row
    for j, w in enumerate(widths):
        wide = F.when(F.col("_kind") == 1 + j, F.lit(w * 1_000_000)).otherwise(wide)
    pt = F.col("_t") - wide
    for i in range(len(distincts)):
        pt = F.when(F.col("_kind") == leave + i, F.col(f"_e{i}")).otherwise(pt)
    is_val = F.col("_kind") == 0
    ev = (base.select("*", F.explode(F.array(*kinds)).alias("_ev")).select("*", F.col("_ev.lv").alias("_lv"), F.col("_ev.kind").alias("_kind"))
          .withColumn("_pt", pt).where(F.col("_pt").isNotNull()))
    # an event has one level, so a value that several levels sum is one number
    summed = {}
    for v, _, lv in sums.values():
        summed.setdefault(v, set()).add(lv)
    adds = [F.when(is_val & F.col("_lv").isin(*lvs), F.col(v)).otherwise(0.0).alias(f"_a{v}") for v, lvs in summed.items()]
    adds += [F.when(is_val & (F.col("_lv") == 0) & F.col(item).isNotNull(), 1.0).when(F.col("_kind") == leave + i, -1.0).otherwise(0.0)
             .alias(f"_d{i}") for i, (item, _) in enumerate(distincts.values())]
    if n_parts:
        part = F.lit("")
        for i in range(n_parts):
            part = F.when(F.col("_lv") == i + 1, F.col(f"_part{i}")).otherwise(part)
        ev = ev.withColumn("_part", part)
    ev = ev.select("_rid", *K, "_lv", *(["_part"] if n_parts else []), "_kind", "_pt",
                   F.floor(F.col("_pt") / F.lit(hour_us)).cast("long").alias("_h"), *adds,
                   *[F.when(is_val & (F.col("_lv") == 0), F.col(f"_x{i}")).alias(f"_x{i}") for i in range(len(maxes))])
    if n_parts:
        K = [*K, "_lv", "_part"]
    S, D, X = [f"_a{v}" for v in summed], [f"_d{i}" for i in range(len(distincts))], [f"_x{i}" for i in range(len(maxes))]
    # a frame starts with its first instant and ends before its row, or starts
    # after it and ends with the row: both bounds before or both up to the probe
    up = Window.partitionBy(*K, "_h").orderBy("_pt").rangeBetween(Window.unboundedPreceding, 0 if include_current else -1)
    down = Window.partitionBy(*K, "_h").orderBy(F.col("_pt").desc()).rangeBetween(Window.unboundedPreceding, 0)
    ev = ev.select("*", *[F.coalesce(F.sum(c).over(up), F.lit(0.0)).alias(f"_r{c}") for c in S + D], *[F.max(c).over(up).alias(f"_r{c}") for c in X],
                   *[F.max(c).over(down).alias(f"_q{c}") for c in X])
    block = F.floor(F.col("_h") / F.lit(block_us // hour_us)).cast("long").alias("_c")
    hours = ev.groupBy(*K, "_h").agg(*[F.sum(c).alias(c) for c in S + D], *[F.max(c).alias(c) for c in X]).select("*", block)
    in_block = Window.partitionBy(*K, "_c").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    ever = Window.partitionBy(*K).orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(c).over(in_block), F.lit(0.0)).alias(f"_p{c}") for c in S]
    cols += [F.sum(c).over(Window.partitionBy(*K, "_c")).alias(f"_b{c}") for c in S]
    cols += [F.coalesce(F.sum(c).over(ever), F.lit(0.0)).alias(f"_p{c}") for c in D]
    for c, (_, w) in zip(X, maxes.values()):
        between = Window.partitionBy(*K).orderBy("_h").rangeBetween(-(w // DEFAULT_BUCKET_SECONDS - 1), -1)
        cols.append(F.max(c).over(between).alias(f"_m{c}"))
    hours = hours.select(*K, "_h", "_c", *cols)
    probes = ev.where(F.col("_kind") < leave).select(
        "_rid", *K, "_h", *([] if n_parts else ["_lv"]), "_kind", F.floor((F.col("_pt") + wide) / F.lit(block_us)).cast("long").alias("_cu"),
        *[f"_r{c}" for c in S + D + X], *[f"_q{c}" for c in X]).join(hours, [*K, "_h"])

    def of(kind: int, level: int = 0) -> Column:
        return (F.col("_kind") == kind) & (F.col("_lv") == level)

    outs = [F.when(of(0, levels[0]), 1).otherwise(0).cast("long").alias("_times")]
    for name, (v, w, lv) in sums.items():
        upto = F.col(f"_p_a{v}") + F.col(f"_r_a{v}")
        below = F.when(F.col("_c") < F.col("_cu"), F.col(f"_b_a{v}")).otherwise(0.0) - upto
        outs.append(F.when(of(0, lv), upto).when(of(1 + widths.index(w), lv), below).otherwise(0.0).alias(f"_o_{name}"))
    for c, (name, (_, w)) in zip(X, maxes.items()):
        outs.append(F.when(of(0), F.greatest(f"_r{c}", f"_m{c}")).when(of(1 + widths.index(w)), F.col(f"_q{c}")).alias(f"_o_{name}"))
    for c, name in zip(D, distincts):
        outs.append(F.when(of(0), F.col(f"_p{c}") + F.col(f"_r{c}")).otherwise(0.0).alias(f"_o_{name}"))
    return probes.select("_rid", *outs)


def _probes(sums: dict, maxes: dict, level: int, width: int) -> bool:
    """Whether a level has a statistic over this window."""
    return any(w == width and lv == level for _, w, lv in sums.values()) or (level == 0 and any(int(w) == width for _, w in maxes.values()))
