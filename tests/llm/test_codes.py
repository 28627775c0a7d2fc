"""Vector codes against a plain version; the tree against all comparisons."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import queries, vector_codes as vc
from ledgerlens.llm.common import read

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>, label int, v string, code string, error string"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (id, vector, label) that are kept, all of one length."""
    data = [(i, [math.floor(x * scale) for x in v], label) for i, v, label in rows]
    width = len(data[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in data]
    order = sorted(range(len(data)), key=lambda k: (data[k][0] is None, data[k][0], data[k][1]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(books[p], c[p])[1] for c in cut]
            for e in set(of):
                mine = [c[p] for c, k in zip(cut, of) if k == e]
                books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [[nearest(books[p], c[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, label), e in zip(data, error):
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, total[label]) for (i, _, label), f, e in zip(data, found, error)), key=str), sha


def result(coded):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in coded.collect()), key=str)


def test_whole_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in read(spark, SF, "embeddings").collect()]
    got = queries.op11_vector_codes(spark, SF)
    assert dict(got.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
    want, sha = plain([r for r in rows if r[1] is not None])
    assert result(got) == want
    assert {r["codebooks_sha256"] for r in got.select("codebooks_sha256").collect()} == {sha}


def awkward_vectors():
    rng = random.Random(3)
    base = [[rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(16)] for _ in range(30)]
    good = [(i, rng.choice(base), rng.choice([None, 1, 2])) for i in range(60)]
    good += [(5, base[0], 1), (None, base[1], None), (None, base[1], None)]
    bad = [(100, None, 1), (101, [], 1), (102, [None] * 16, 1), (103, [float("nan")] + [0.0] * 15, 1),
           (104, [float("inf")] * 16, 2), (105, [1.0] * 8, 1)]
    return good, bad


def test_awkward_rows(spark):
    good, bad = awkward_vectors()
    df = spark.createDataFrame([r + ("x", "y", "z") for r in good + bad], SCHEMA)
    coded, books = vc.compress(df)
    want, sha = plain(good)
    assert result(coded) == want and vc.digest(books) == sha


def test_few_rows_padding_and_large_components(spark):
    rows = [(1, [1e30, -1e30] + [0.25] * 10, 1), (2, [0.5] * 12, 1)]
    coded, books = vc.compress(spark.createDataFrame([r + ("", "", "") for r in rows], SCHEMA))
    assert books.shape == (8, 2, 2)
    assert [(r["vec_id"], r["code"], r["error"]) for r in coded.orderBy("vec_id").collect()] == [
        (1, "00" * 8, 0), (2, "0101" + "01" * 4 + "0000", 0)]


def test_empty_table(spark):
    coded, books = vc.compress(spark.createDataFrame([], SCHEMA))
    assert coded.collect() == [] and vc.digest(books) == hashlib.sha256(b"").hexdigest()


def test_labels_beyond_the_broadcast_bound(spark):
    rows = [(i, i % 1500 if i % 3 else None, f"{i:x}", i) for i in range(4000)]
    coded = spark.createDataFrame(rows, "vec_id bigint, label int, code string, error bigint")
    by = lambda bound: result(vc.with_label_sums(coded, bound))
    assert by(100) == by(10_000) and len(by(100)) == 4000


def test_decode_gives_the_entries(spark):
    good, _ = awkward_vectors()
    coded, books = vc.compress(spark.createDataFrame([r + ("", "", "") for r in good], SCHEMA))
    for r in vc.decode(coded, books).collect():
        digits = [int(r["code"][2 * p:2 * p + 2], 16) for p in range(8)]
        assert r["v"] == [int(x) for p, d in enumerate(digits) for x in books[p, d]]


@pytest.mark.parametrize("n, width, spread", [(1, 3, 5), (16, 8, 3), (200, 2, 1000), (64, 8, 1 << 26), (40, 1, 2)])
def test_tree_equals_all_comparisons(n, width, spread):
    rng = np.random.default_rng(n)
    entries = rng.integers(-spread, spread, (n, width), endpoint=True)
    queries_ = np.concatenate([rng.integers(-spread, spread, (500, width), endpoint=True), entries])
    away = ((queries_[:, None] - entries[None]) ** 2).sum(axis=2)
    tree = vc.Gnat(entries)
    which, d = tree.nearest(queries_)
    assert np.array_equal(which, away.argmin(axis=1)) and np.array_equal(d, away.min(axis=1))
    if n == 200:
        assert tree.compared < 0.6 * away.size
