"""Importance resampling against a plain version, the radix sort against
sorting, array-combined CRCs against the library."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import queries, target_sampling as ts
from ledgerlens.llm.common import read

from .conftest import make_docs

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    w = WORD.findall((text or "").translate(ASCII))
    return w, [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def buckets(texts, n=10_000):
    out = {}
    for t in texts:
        for f in runs(t)[1]:
            b = zlib.crc32(f.encode()) % n
            out[b] = out.get(b, 0) + 1
    return out


def plain(docs, target, percent=5):
    s, t = buckets(x for _, x in docs), buckets(target)
    S, T = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t.get(b, 0) + 1.0) * (S + 10000.0) / ((s.get(b, 0) + 1.0) * (T + 10000.0))))
    rows = []
    for i, text in docs:
        words, feats = runs(text)
        weight = sum(gain(zlib.crc32(f.encode()) % 10_000) for f in feats)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in rows), key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def test_whole_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    target = [r["text"] for r in read(spark, SF, "benchmark").collect()]
    got = queries.op13_target_sampling(spark, SF)
    assert dict(got.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert result(got) == plain(docs, target)


def test_awkward_rows(spark, awkward, awkward_docs):
    target = make_docs(spark, [(1, "line line other two words", None, None, None), (2, None, None, None, None)])
    got = result(ts.resample(awkward_docs, target, percent=60))
    assert got == plain([r[:2] for r in awkward], ["line line other two words", None], 60)
    assert any(r[4] for r in got)


def test_empty_tables(spark, no_docs, awkward_docs, awkward):
    assert ts.resample(no_docs, awkward_docs).collect() == []
    assert result(ts.resample(awkward_docs, no_docs)) == plain([r[:2] for r in awkward], [])


def test_crc_of_runs_at_every_length():
    rng = random.Random(1)
    text = " ".join("é漢a1"[rng.randrange(4)] * rng.randint(1, 70) for _ in range(400)).encode()
    data, off = np.frombuffer(text, np.uint8), np.array([0, 1000, len(text)])
    start, end, doc = ts.word_spans(data, off)
    got = {(run, lo + k): int(b) for run, lo, _, found in ts.features(data, start, end, doc, 9973) for k, b in enumerate(found) if b >= 0}
    words = [text[s:e] for s, e in zip(start, end)]
    want = {(run, i): zlib.crc32(b" ".join(words[i:i + run])) % 9973 for run in (1, 2, 3) for i in range(len(words) - run + 1)
            if doc[i] == doc[i + run - 1]}
    assert got == want


@pytest.mark.parametrize("block_words", [1, 2, 5])
def test_blocks_of_words(monkeypatch, block_words):
    data = np.frombuffer(b"a bb ccc d a bb ccc d e f g", np.uint8)
    spans = ts.word_spans(data, np.array([0, 11, 11, len(data)]))
    whole = [sorted((r, lo + k, int(b)) for r, lo, _, f in ts.features(data, *spans, 1000) for k, b in enumerate(f) if b >= 0)]
    monkeypatch.setattr(ts, "BLOCK_WORDS", block_words)
    whole.append(sorted((r, lo + k, int(b)) for r, lo, _, f in ts.features(data, *spans, 1000) for k, b in enumerate(f) if b >= 0))
    assert whole[0] == whole[1]


@pytest.mark.parametrize("span", [3, 1 << 40, 1 << 62])
def test_radix_rank_is_a_sort(spark, span):
    rng = random.Random(span)
    rows = [(rng.randint(-span, span), rng.choice([None, rng.randint(-span, span)]), i) for i in range(3000)]
    rows += [(span, -span, -1), (-span, span, -2)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, i bigint").repartition(7)
    got = ts.radix_rank(df, [("a", True), ("b", False)], digit_bits=12, block_bits=8).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(len(rows)))
    want = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or 0))
    assert [(r["a"], r["b"]) for r in got] == [r[:2] for r in want]
    assert sorted(r["i"] for r in got) == sorted(r[2] for r in rows)


def test_one_key_throughout(spark):
    df = spark.range(500).select(F.lit(7).cast("bigint").alias("a"), "id").repartition(5)
    assert sorted(r["pos"] for r in ts.radix_rank(df, [("a", True)]).collect()) == list(range(500))
