"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors of a label form a class; classes are the nodes.
2. Nodes are cut into overlapping cluster shards: a shard over ``max_shard``
   nodes is split by centres fitted on a bounded sample of it (``SAMPLE``
   rows), each node joining its ``overlap`` nearest centres, until all fit.
   Centres within ``threshold`` of each other are one, so a dense group is not
   parted by centres of its own. A shard that is one dense crowd around its
   mean (centres would part its pairs), or that the centres left don't split,
   is cut into blocks and every pair of blocks becomes a shard, so no pair is
   lost.
3. Each shard's graph is built by robust pruning; the adjacency lists of a
   node from all its shards are united.
4. Every node is a query in each of its shards: greedy search from the
   medoids of its clusters, then the found range grows along edges while nodes are within the
   threshold less ``SLACK``. Hits are verified by cosine in double precision. A pair counts
   in the first shard that both nodes share; pairs that meet in several shards
   are verified there whether the search found them or not, so what any shard
   finds counts, and counts once. Links are contracted where they are found
   and no pair is emitted.
5. Recall is audited by brute force over the classes of all rows whose id is
   divisible by 100, in blocks of ``AUDIT_BLOCK``: the mean over the audited
   classes of the found share of their true links to other classes. Without a
   true link among them, a hash sample of at most about ``AUDIT_BLOCK`` classes
   is audited; without one there either, the recall is null (1 if these were
   all classes). Below
   ``target_recall`` the overlap is doubled.

Edge cases: null labels, null or empty vectors, vectors with null or
non-finite components or length zero link with nothing; vectors of different
length never link; equal rows are one class and linked; null or repeated ids
get row ids first; other columns are ignored; empty tables give empty results."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, row_ids, staged
from .components import components

THRESHOLD = 0.98
MAX_SHARD = 512
SAMPLE = 2048
CENTRES = 64              # most parts of one split
MEDOIDS = 16
PROGRESS = 0.6            # largest part of a cell that a split may leave
CROWD = 0.5               # share of a cell near its mean that makes it a crowd
DEGREE = 24
CANDIDATES = 48
ALPHA = 1.2
BEAM = 32
SLACK = 0.03             # the range grows through nodes this far below the threshold
AUDIT_BLOCK = 4096       # audited classes a scan
GROUP_ROWS = 4096


def valid(vector: str, label: str):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    norm = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad & (norm > 0)


def matrix(column: pa.ListArray) -> np.ndarray:
    """Unit vectors in double precision (vectors of one length)."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from spread-out starting points."""
    pick, far = [0], x @ x[0]
    for _ in range(1, k):
        pick.append(int(far.argmin()))
        far = np.maximum(far, x @ x[pick[-1]])
    c = x[pick]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def apart(c: np.ndarray, threshold: float) -> np.ndarray:
    """The centres without those within ``threshold`` of an earlier one."""
    unit = c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    keep: list[int] = []
    for i in range(len(c)):
        if not keep or (unit[keep] @ unit[i]).max() < threshold:
            keep.append(i)
    return c[keep]


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each vector: from its nearest ones, the closest is kept
    and those ``alpha`` times closer to it than to the vector are dropped, and
    so on; edges run both ways."""
    m = len(x)
    k = min(candidates, m - 1)
    out: list[list[int]] = [[] for _ in range(m)]
    if k <= 0:
        return [np.zeros(0, np.int64) for _ in range(m)]
    for start in range(0, m, 512):
        sim = x[start: start + 512] @ x.T
        sim[np.arange(len(sim)), np.arange(start, start + len(sim))] = -2
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        for i, row in enumerate(near):
            cand = row[np.argsort(-sim[i, row], kind="stable")]
            dist = np.sqrt(np.maximum(2 - 2 * sim[i, cand], 0))
            among = np.sqrt(np.maximum(2 - 2 * (x[cand] @ x[cand].T), 0))
            alive = np.ones(len(cand), bool)
            for j in range(len(cand)):
                if alive[j]:
                    out[start + i].append(int(cand[j]))
                    if len(out[start + i]) >= degree:
                        break
                    alive &= alpha * among[j] > dist
    both = [set(v) for v in out]
    for i, v in enumerate(out):
        for j in v:
            both[j].add(i)
    return [np.array(sorted(v), np.int64) for v in both]


def medoids(x: np.ndarray, k: int = MEDOIDS) -> np.ndarray:
    """The nodes nearest to the centres of a shard's clusters."""
    return np.unique((x @ centres(x, min(k, len(x))).T).argmax(0))


def range_search(x: np.ndarray, graph: list[np.ndarray], starts: np.ndarray, query: int, threshold: float,
                 beam: int = BEAM) -> np.ndarray:
    """Nodes within ``threshold`` of a node, found along edges from ``starts``."""
    q = x[query]
    ids, sims = starts, x[starts] @ q
    seen, done = set(starts.tolist()), set()
    while True:
        order = np.argsort(-sims)[:beam]
        step = next((int(i) for i in ids[order] if int(i) not in done), None)
        if step is None:
            break
        done.add(step)
        new = np.array([j for j in graph[step].tolist() if j not in seen], np.int64)
        if len(new):
            seen.update(new.tolist())
            ids, sims = np.concatenate([ids, new]), np.concatenate([sims, x[new] @ q])
    found = set(ids[sims >= threshold].tolist())
    frontier = [i for i in ids[sims >= threshold - SLACK].tolist() if i not in done]
    while frontier:
        new = np.array(list({j for i in frontier for j in graph[i].tolist()} - seen), np.int64)
        if not len(new):
            break
        seen.update(new.tolist())
        sim = x[new] @ q
        found.update(new[sim >= threshold].tolist())
        frontier = new[sim >= threshold - SLACK].tolist()
    found.discard(query)
    return np.array(sorted(found), np.int64)


# -- shards -------------------------------------------------------------------

def _centre_table(cells: DataFrame, big: DataFrame, max_shard: int, threshold: float, overlap: int) -> DataFrame:
    """(cell, centres) of the cells to split; no centres for a crowd."""
    def run(batches):
        for table in by_group(batches, "cell", GROUP_ROWS):
            for part in _cells(table):
                x, n = matrix(part.column("vec").combine_chunks()), part.column("n")[0].as_py()
                mean = x.mean(0)
                near = (x @ mean >= threshold * np.sqrt(mean @ mean)).mean()
                k = int(min(CENTRES, math.ceil(4 * n / max_shard), len(x)))
                c = centres(x, k) if near <= CROWD and k > 1 else np.zeros((0, 0))
                c = apart(c, threshold)
                if len(c):
                    # a split that leaves a part about as large is no split
                    top = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :overlap]
                    if np.bincount(top.ravel(), minlength=len(c)).max() > PROGRESS * len(x):
                        c = c[:0]
                flat = c.ravel().tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("cell").combine_chunks().slice(0, 1), pa.array([flat], pa.list_(pa.float64()))], ["cell", "centres"])
    rows = (cells.join(big, "cell")
            .filter(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) <= F.lit(float(1 << 30)) * SAMPLE / F.col("n"))
            .select("cell", "n", "rid", "vec").repartition("cell").sortWithinPartitions("cell", "rid"))
    return rows.mapInArrow(run, "cell bigint, centres array<double>")


def _assign(cells: DataFrame, table: DataFrame, overlap: int) -> DataFrame:
    """Nearest centres of each node of a split cell; others stay (-1), and
    those of a crowd are marked (-2)."""
    def run(batches):
        for batch in batches:
            vecs, near = batch.column("vec"), []
            for i, c in enumerate(batch.column("centres")):
                if not c.is_valid or not len(c):
                    near.append([-2 if c.is_valid else -1])
                    continue
                x = np.array(vecs[i].as_py(), np.float64)
                sim = c.values.to_numpy().reshape(-1, len(x)) @ x
                near.append(np.argsort(-sim, kind="stable")[:overlap].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("rid", "cell", "vec", "size", "crowd")] + [pa.array(near, pa.list_(pa.int32()))],
                ["rid", "cell", "vec", "size", "crowd", "near"])
    kinds = dict(cells.dtypes)
    out = cells.join(table, "cell", "left").select("rid", "cell", "vec", "size", "crowd", "centres").mapInArrow(
        run, f"rid bigint, cell bigint, vec {kinds['vec']}, size bigint, crowd boolean, near array<int>")
    return (out.select("rid", "cell", "vec", "size", "crowd", F.explode("near").alias("child"))
            .withColumn("crowd", F.col("crowd") | (F.col("child") == -2))
            .withColumn("cell", F.when(F.col("child") < 0, F.col("cell")).otherwise(F.xxhash64("cell", "child")))
            .drop("child").dropDuplicates(["rid", "cell"]))


def shards(nodes: DataFrame, max_shard: int, overlap: int, threshold: float) -> DataFrame:
    """(rid, cell, vec, size): nodes in overlapping cells of bounded size."""
    cells = nodes.withColumn("crowd", F.lit(False))
    for _ in range(32):
        counts = cells.filter(~F.col("crowd")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        big = staged(counts.filter(F.col("n") > max_shard), "big")
        if not big.count():
            break
        table = staged(_centre_table(cells, big, max_shard, threshold, overlap), "centres")
        cells = staged(_assign(cells, table, overlap), "cells")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_shard)
    nb = F.coalesce(F.ceil(F.col("n") * 2 / max_shard).cast("int"), F.lit(1))
    blocks = (cells.join(sizes, "cell", "left").withColumn("nb", nb)
              .withColumn("block", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))))
    # a block with itself is part of its pairs with the others
    blocks = blocks.filter((F.col("nb") == 1) | (F.col("block") != F.col("other")))
    return blocks.select("rid", F.when(F.col("nb") == 1, F.col("cell")).otherwise(
        F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))).alias("cell"), "vec", "size")


# -- graph and search ---------------------------------------------------------

def _edges(members: DataFrame) -> DataFrame:
    def run(batches):
        for table in by_group(batches, "cell", GROUP_ROWS):
            for part in _cells(table):
                rid = part.column("rid").to_numpy()
                graph = robust_prune(matrix(part.column("vec").combine_chunks()))
                off = np.concatenate([[0], np.cumsum([len(v) for v in graph])]).astype(np.int32)
                flat = rid[np.concatenate(graph)] if off[-1] else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.ListArray.from_arrays(off, pa.array(flat))], ["rid", "near"])
    rows = members.select("cell", "rid", "vec").repartition("cell").sortWithinPartitions("cell", "rid")
    return rows.mapInArrow(run, "rid bigint, near array<bigint>")


def _cells(table: pa.Table):
    table = table.combine_chunks()
    cell = table.column("cell").to_numpy()
    edge = np.flatnonzero(np.diff(cell)) + 1
    for a, b in zip([0, *edge], [*edge, len(cell)]):
        yield table.slice(int(a), int(b - a)).combine_chunks()


def _meeting_again(homes: list, cell: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of the pairs in ``near`` whose nodes share another shard
    besides ``cell`` but none before it."""
    cells = sorted({c for v in homes for c in v})
    column = {c: k for k, c in enumerate(cells)}
    at = np.zeros((len(homes), len(cells)), np.float32)
    for i, v in enumerate(homes):
        at[i, [column[c] for c in v]] = 1
    i, j = np.nonzero(np.triu(near & (at @ at.T > 1), 1))
    before = at[:, :column[cell]] > 0
    first = np.ones(len(i), bool)
    for k in range(0, len(i), 4096):
        part = slice(k, k + 4096)
        first[part] = ~(before[i[part]] & before[j[part]]).any(1)
    return i[first], j[first]


def _search(members: DataFrame, threshold: float) -> DataFrame:
    """(rid, links, others, root) of each node in each of its shards: linked
    rows and linked nodes."""
    def run(batches):
        for table in by_group(batches, "cell", GROUP_ROWS):
            for part in _cells(table):
                m = part.num_rows
                if m < 2:
                    continue
                cell = part.column("cell")[0].as_py()
                rid, size = part.column("rid").to_numpy(), part.column("size").to_numpy()
                x = matrix(part.column("vec").combine_chunks())
                where = {r: i for i, r in enumerate(rid.tolist())}
                graph = [np.array([where[r] for r in v if r in where], np.int64) for v in part.column("near").to_pylist()]
                homes = [frozenset(v) for v in part.column("cells").to_pylist()]
                starts = medoids(x)
                link = [set() for _ in range(m)]
                for i in range(m):
                    for j in range_search(x, graph, starts, i, threshold).tolist():
                        if min(homes[i] & homes[j]) == cell:
                            link[i].add(j)
                            link[j].add(i)
                for i, j in zip(*(v.tolist() for v in _meeting_again(homes, cell, x @ x.T >= threshold))):
                    link[i].add(j)
                    link[j].add(i)
                label = np.arange(m)
                ends = np.array([(i, j) for i in range(m) for j in link[i]], np.int64).reshape(-1, 2)
                while len(ends):
                    new = label.copy()
                    np.minimum.at(new, ends[:, 0], label[ends[:, 1]])
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                some = np.array([i for i in range(m) if link[i]], np.int64)
                if len(some):
                    links = np.array([int(size[list(link[i])].sum()) for i in some])
                    others = pa.array([len(link[i]) for i in some], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(links), others, pa.array(rid[label[some]])],
                                                     ["rid", "links", "others", "root"])
    rows = members.select("cell", "rid", "size", "vec", "near", "cells").repartition("cell").sortWithinPartitions("cell", "rid")
    return rows.mapInArrow(run, "rid bigint, links bigint, others bigint, root bigint")


def audit(vectors: DataFrame, classes: DataFrame, threshold: float) -> float | None:
    """Mean found share of the true links of the audited classes; ``vectors``
    (id, label, vec) are all rows that may link, ``classes`` (label, vec,
    first, others) the classes with their found links to other classes."""
    marked = vectors.filter(F.col("id") % 100 == 0).select("label", "vec").distinct()
    recall = _recall(staged(classes.join(marked, ["label", "vec"], "left_semi"), "audited"), classes, threshold)
    if recall is None:
        n = classes.count()
        share = F.pmod(F.xxhash64("first"), F.lit(1 << 30)) <= F.lit(float(1 << 30)) * AUDIT_BLOCK / max(n, 1)
        recall = _recall(staged(classes.filter(share), "audited"), classes, threshold)
        if recall is None and n <= AUDIT_BLOCK:
            return 1.0  # all classes were audited: there is no link to lose
    return recall


def _recall(audited: DataFrame, classes: DataFrame, threshold: float) -> float | None:
    blocks, total, n = math.ceil(audited.count() / AUDIT_BLOCK), 0.0, 0
    for block in range(blocks):
        sample = audited.filter(F.pmod(F.xxhash64("first"), F.lit(blocks)) == block).collect()
        true = _true_links(sample, classes, threshold)
        shares = [min(1.0, r["others"] / t) for r, t in zip(sample, true) if t > 0]
        total, n = total + sum(shares), n + len(shares)
    return total / n if n else None


def _true_links(sample: list, classes: DataFrame, threshold: float) -> list[int]:
    by_kind: dict[tuple, list] = {}
    for i, r in enumerate(sample):
        by_kind.setdefault((r["label"], len(r["vec"])), []).append((i, np.array(r["vec"], float) / np.linalg.norm(np.array(r["vec"], float))))
    queries = {k: (np.array([i for i, _ in v]), np.array([x for _, x in v])) for k, v in by_kind.items()}

    def run(batches):
        count = np.zeros(len(sample_range), np.int64)
        for batch in batches:
            rows: dict[tuple, list] = {}
            for la, v in zip(batch.column("label").to_pylist(), batch.column("vec").to_pylist()):
                rows.setdefault((la, len(v)), []).append(v)
            for k, v in rows.items():
                if k in queries:
                    where, q = queries[k]
                    x = np.array(v, float)
                    x /= np.sqrt((x * x).sum(1, keepdims=True))
                    for at in range(0, len(x), 1024):
                        count[where] += (q @ x[at: at + 1024].T >= threshold).sum(1)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["q", "n"])
    sample_range = range(len(sample))
    found = classes.select("label", "vec").mapInArrow(run, "q bigint, n bigint").groupBy("q").agg(F.sum("n").alias("n"))
    true = dict.fromkeys(sample_range, 0) | {r["q"]: r["n"] for r in found.collect()}
    return [true[i] - 1 for i in sample_range]  # each query meets itself


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, max_shard: int = MAX_SHARD, overlap: int = 2,
                    target_recall: float = 0.95) -> DataFrame:
    """One row per input row: id, rid, n_links, component_rid, kept and
    audit_recall."""
    rows = row_ids(df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec")),
                   "id", ["label", "vec"])
    usable = rows.filter(valid("vec", "label"))
    classes = staged(usable.groupBy("label", "vec").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("size")), "classes")
    nodes = classes.select(F.col("first").alias("rid"), F.xxhash64("label", F.size("vec")).alias("cell"), "vec", "size")
    while True:
        members = staged(shards(nodes, max_shard, overlap, threshold), "members")
        homes = members.groupBy("rid").agg(F.collect_set("cell").alias("cells"))
        near = (_edges(members).groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
        graph = members.join(homes.join(near, "rid"), "rid")
        found = staged(_search(graph, threshold), "links")
        links = found.groupBy("rid").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))
        own = staged(classes.join(links.withColumnRenamed("rid", "first"), "first", "left")
                     .select("label", "vec", "first", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                             F.coalesce("others", F.lit(0)).alias("others")), "linked")
        member = usable.join(own.drop("others"), ["label", "vec"])
        recall = audit(usable, own, threshold)
        if recall is None or recall >= target_recall or overlap >= CENTRES:
            break
        overlap *= 2
    linked = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    member = (member.select("rid", "first", "links")
              .join(linked.withColumnRenamed("node", "first"), "first", "left").drop("id"))
    out = rows.select("id", "rid").join(member, "rid", "left")
    component = F.coalesce("component", "first", "rid")
    return out.select(F.col("id").alias(id_col), "rid", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_rid"), (component == F.col("rid")).alias("kept"),
                      F.lit(recall).cast("double").alias("audit_recall"))
