"""Vector near-duplicates against the full cosine matrix."""
import numpy as np
import pytest

from ledgerlens.llm import queries
from ledgerlens.llm import vector_graph as V
from ledgerlens.llm.common import ship_code

SCHEMA = "vec_id bigint, embedding array<float>, label int, rid string, size string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def brute(rows, threshold=0.98):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][2] is not None))
    n, comp = np.zeros(len(rows), int), list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    unit = []
    for i in order:
        v, la = rows[i][1], rows[i][2]
        ok = la is not None and v and not any(x is None or not np.isfinite(x) for x in v) and any(v)
        unit.append((la, np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))) if ok else None)
    for a in range(len(order)):
        for b in range(a):
            p, q = unit[a], unit[b]
            if p and q and p[0] == q[0] and len(p[1]) == len(q[1]) and p[1] @ q[1] >= threshold:
                n[a] += 1
                n[b] += 1
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return [rows[i][0] for i in order], n.tolist(), [root(i) for i in range(len(order))]


def run(spark, rows, **kw):
    ship_code(spark)
    out = sorted(V.near_duplicates(frame(spark, rows).repartition(3), **kw).collect(), key=lambda r: r["rid"])
    place = {r["rid"]: i for i, r in enumerate(out)}
    assert all(r["kept"] == (r["component_rid"] == r["rid"]) for r in out)
    return [r["vec_id"] for r in out], [r["n_links"] for r in out], [place[r["component_rid"]] for r in out]


def cloud(seed, n, dim=16, spread=0.03):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        kind = i % 4
        base = np.random.default_rng(seed * 1000 + (i % 25)).normal(size=dim)
        v = rng.normal(size=dim) if kind == 0 else base + spread * rng.normal(size=dim) if kind < 3 else base
        rows.append((i, v.astype(np.float32).tolist(), int(i % 25) % 3))
    return rows


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1),
            (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1),
            (None, [2.0, 0.0], 1), (None, None, None), (12, [1.0], 1), (13, [3.0], 1), (14, [-1.0, 0.0], 1), (200, [0.5, 0.0], 1)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    ship_code(spark)
    assert V.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("max_shard", [2048, 60])
def test_recall_and_precision(spark, max_shard):
    rows = cloud(3, 500)
    ids, n, comp = run(spark, rows, max_shard=max_shard)
    _, true_n, true_comp = brute(rows)
    assert all(a <= b for a, b in zip(n, true_n))
    assert sum(n) >= 0.99 * sum(true_n)
    if max_shard == 2048:
        assert (n, comp) == (true_n, true_comp)


def test_a_crowd_that_does_not_split(spark):
    """One dense crowd of different vectors, larger than a shard."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=32)
    rows = [(i, (centre + 0.02 * rng.normal(size=32)).astype(np.float32).tolist(), 1) for i in range(300)]
    assert run(spark, rows, max_shard=40)[1:] == brute(rows)[1:]


def test_many_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(400)] + [(1000, [1.0, 2.0, 3.01], 1)]
    ids, n, comp = run(spark, rows, max_shard=50)
    assert set(n) == {400} and set(comp) == {0}


def test_query_on_embeddings(spark):
    from conftest import SF
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows.sort()
    ids, n, comp = brute(rows)
    out = sorted(queries.QUERIES["op4_vector_graph"](spark, SF).collect(), key=lambda r: r["vec_id"])
    assert [r["n_links"] for r in out] == n and [r["component_id"] for r in out] == [ids[c] for c in comp]
    assert all(r["audit_recall"] >= 0.9 for r in out)


def test_several_dense_groups_in_one_cell(spark):
    """Dense groups larger than a shard: centres part no true pair."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(6, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(i, (base[i % 6] + 0.012 * rng.normal(size=32)).astype(np.float32).tolist(), 1) for i in range(600)]
    ship_code(spark)
    nodes = frame(spark, rows).selectExpr("vec_id AS rid", "7L AS cell", "embedding AS vec", "1L AS size")
    homes = {}
    for r in V.shards(nodes, 40, 2, 0.98).select("rid", "cell").collect():
        homes.setdefault(r["rid"], set()).add(r["cell"])
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = np.argwhere(np.triu(x @ x.T >= 0.98, 1))
    assert len(pairs) > 10_000 and all(homes[a] & homes[b] for a, b in pairs.tolist())


def test_pairs_that_meet_in_several_shards():
    """A pair belongs to its first shared shard, whichever shard looks."""
    rng = np.random.default_rng(5)
    homes = [frozenset(rng.choice(12, rng.integers(1, 6), replace=False).tolist()) for _ in range(60)]
    near = rng.random((60, 60)) < 0.5
    near = near | near.T
    got = {}
    for cell in range(12):
        here = [i for i, v in enumerate(homes) if cell in v]
        if len(here) < 2:
            continue
        i, j = V._meeting_again([homes[k] for k in here], cell, near[np.ix_(here, here)])
        for a, b in zip(i.tolist(), j.tolist()):
            got[here[a], here[b]] = got.get((here[a], here[b]), []) + [cell]
    want = {(a, b): [min(homes[a] & homes[b])] for a in range(60) for b in range(a + 1, 60) if near[a, b] and len(homes[a] & homes[b]) > 1}
    assert got == want and len(want) > 20


def test_audit_weighs_classes_alike(spark, monkeypatch):
    """Copies of one vector don't hide the lost link of another class."""
    ship_code(spark)
    rows = [(100 * i, [1.0, 0.0], 1) for i in range(50)] + [(10_000, [0.0, 1.0], 1), (10_001, [0.01, 1.0], 1)]
    vectors = spark.createDataFrame(rows, "id bigint, vec array<float>, label int")
    own = [(1, [1.0, 0.0], 0, 0), (1, [0.0, 1.0], 10_000, 0), (1, [0.01, 1.0], 10_001, 0)]
    schema = "label int, vec array<float>, first bigint, others bigint"
    assert V.audit(vectors, spark.createDataFrame(own, schema), 0.98) == 0.0
    alone = spark.createDataFrame([(1, [1.0, 0.0], 0, 0), (1, [0.0, 1.0], 10_000, 0)], schema)
    assert V.audit(vectors, alone, 0.98) == 1.0
    monkeypatch.setattr(V, "AUDIT_BLOCK", 1)
    assert V.audit(vectors, alone, 0.98) is None
