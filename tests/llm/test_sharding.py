"""Rendezvous sharding: law, weights, slots and movement."""
import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerlens.llm import queries, sharding


def best(key, weights):
    def score(s, w):
        h = int(hashlib.md5(f"{'' if key is None else key}:{s}".encode()).hexdigest()[:12], 16)
        return -w / math.log((h + 0.5) / 2 ** 48)
    return max(range(len(weights)), key=lambda s: (score(s, weights[s]), -s))


def slots_ok(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    return all(sorted(v) == list(range(len(v))) for v in by.values())


def test_awkward_rows(spark, awkward, awkward_docs):
    weights = [1.0] * 40
    rows = sharding.shard(awkward_docs, weights).collect()
    got = sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in rows)
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key",
                   best(i, weights), best(i, weights + [1.0])) for i, t, *_ in awkward)
    assert got == want
    assert slots_ok(rows)


def test_one_repeated_row_and_small_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 7)
    monkeypatch.setattr(sharding, "RUN_ROWS", 64)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard(df, [1.0] * 4).collect()
    assert len(rows) == 3000 and slots_ok(rows)


def test_weights_and_growth(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 2.0, 1.0]
    rows = sharding.assign(keys, weights, "doc_id", "shard", "grown", 4.0).collect()
    n = Counter(r["shard"] for r in rows)
    assert all(abs(n[s] / 20_000 - w / 4) < 0.02 for s, w in enumerate(weights))
    moved = [r for r in rows if r["shard"] != r["grown"]]
    assert {r["grown"] for r in moved} == {3} and abs(len(moved) / 20_000 - 0.5) < 0.02


def test_empty_table_and_plan(spark, no_docs):
    out = sharding.shard(no_docs, [1.0] * 3)
    assert out.collect() == []


def test_query_is_even(spark):
    from conftest import SF
    rows = queries.QUERIES["op8_rendezvous_shards"](spark, SF).collect()
    assert slots_ok(rows) and all(r["shard"] == best(r["doc_id"], [1.0] * 40) for r in rows)
