"""N-gram Jaccard self-join by MinHash banding with exact verification.

1. Every text becomes its set of word five-grams; texts with equal sets form a
   class (map-side aggregation by a 128-bit digest of the set).
2. Each class is signed by MinHash; bands and rows are chosen so that a pair
   at the threshold meets in at least one band with the target recall. Band
   hashes are shuffled; classes of a bucket are tied to its smallest class
   (as many ties as rows, never all pairs), and the ties' connected components
   are the candidate groups, so that every pair that shares a band is in one.
3. Texts of a candidate group are compared on their full n-gram sets. A group
   of more than a block that buckets hold together loosely (chance meetings
   chain unrelated texts) is compared bucket by bucket, a pair counting in the
   first band that it shares; any other group is compared as a whole, whatever
   costs fewer comparisons. Large groups and buckets are cut into blocks and
   the pairs of blocks become tasks of bounded size. Links are counted and contracted where they are found, so no pair is
   ever emitted; every link between different texts counts.

Edge cases: null and empty texts and texts without words link with nothing;
texts of one to four words have one gram of all their words; repeated rows and
equal texts are members of one class and linked with each other; null or
repeated ids are given row ids first (see ``row_ids``); other columns are
ignored; an empty table gives an empty result."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, drop_or_keep, row_ids, small_batches, staged, utf8
from .components import components
from .words import grams, mix, words

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 160
BLOCK_ROWS = 512          # texts of a block of a large candidate group
BLOCK_CHARS = 16 << 20    # and their characters
BATCH_BYTES = 1 << 20


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding within ``max_hashes`` hashes
    whose miss rate at ``threshold`` is at most 1 - ``recall``."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def text_grams(column: pa.Array, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text and the rows' offsets."""
    h, off = grams(*words(column), n, short=True)
    sets = [np.unique(h[a:b]) for a, b in zip(off[:-1], off[1:])]
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def signatures(flat: np.ndarray, off: np.ndarray, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """Band hashes (texts x bands) of non-empty sets."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    out = np.zeros((len(off) - 1, bands), np.uint64)
    h = mix(flat)
    for b in range(bands):
        for r in range(rows):
            low = np.minimum.reduceat(h * mult[b * rows + r] + add[b * rows + r], off[:-1])
            out[:, b] = mix(out[:, b] * np.uint64(0x9E3779B97F4A7C15) + (low >> np.uint64(20)))
    return out


def _signed(rows: DataFrame, bands: int, rows_per_band: int, n: int) -> DataFrame:
    """(rid, d1, d2, chars, bands array<bigint>) of the rows that have n-grams."""
    def run(batches):
        for batch in small_batches(batches, "text", BATCH_BYTES):
            flat, off = text_grams(batch.column("text"), n)
            some = np.flatnonzero(np.diff(off) > 0)
            size = np.diff(utf8(batch.column("text"))[1])
            if not len(some):
                continue
            off = np.concatenate([off[some], off[-1:]])
            d1 = np.add.reduceat(mix(flat), off[:-1])
            d2 = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), off[:-1])
            sig = signatures(flat, off, bands, rows_per_band)
            lists = pa.ListArray.from_arrays(
                np.arange(0, sig.size + 1, bands, dtype=np.int32), pa.array(sig.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid").take(pa.array(some)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                 pa.array(size[some]), lists], ["rid", "d1", "d2", "chars", "bands"])
    return rows.select("rid", "text").mapInArrow(
        run, "rid bigint, d1 bigint, d2 bigint, chars bigint, bands array<bigint>")


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix left x right: Jaccard of the full sets >= threshold."""
    size = np.array([len(s) for s in sets], float)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams_, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # a gram of one text is in no intersection
    new = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], new[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inter = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        inter += dense[left] @ dense[right].T
    union = size[left][:, None] + size[right][None, :] - inter
    return inter >= threshold * union - 1e-6


def _roots(n: int, left: np.ndarray, right: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Smallest position reachable by links for each of n positions."""
    label = np.arange(n)
    while True:
        new = label.copy()
        if link.size:
            new[left] = np.minimum(new[left], np.where(link, label[right][None, :], n).min(1))
            new[right] = np.minimum(new[right], np.where(link, label[left][:, None], n).min(0))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(rows: DataFrame, threshold: float, n: int) -> DataFrame:
    """(rid, links, root) per tile from (grp, unit, band, bands, bi, bj, block,
    rid, size, text): the linked documents in other classes and the smallest
    linked rid. A unit is a group (band -1) or a bucket of a band."""
    def run(batches):
        for table in by_group((b for batch in batches for b in small_batches(iter([batch]), "text", BATCH_BYTES)),
                              "grp", 2048, "text", 4 * BATCH_BYTES):
            table = table.combine_chunks()
            text = table.column("text").combine_chunks() if table.num_rows else None
            flat, off = text_grams(text, n)
            cols = {c: table.column(c).to_numpy() for c in ("unit", "band", "bi", "bj", "block", "rid", "size")}
            lists = table.column("bands").combine_chunks()
            sig, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            tile = np.stack([cols["unit"], cols["band"], cols["bi"], cols["bj"]], 1)
            order = np.lexsort((cols["rid"], cols["bj"], cols["bi"], cols["band"], cols["unit"]))
            cut = np.flatnonzero((tile[order][1:] != tile[order][:-1]).any(1)) + 1
            rid, links, root = [], [], []
            for member in np.split(order, cut):
                if len(member) < 2:
                    continue
                block = cols["block"][member]
                bi, bj = cols["bi"][member[0]], cols["bj"][member[0]]
                left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
                if not len(left) or not len(right):
                    continue
                sets = [flat[off[i]: off[i + 1]] for i in member]
                link = _links(sets, left, right, threshold)
                if bi == bj:
                    np.fill_diagonal(link, False)
                band = int(cols["band"][member[0]])
                if band > 0:  # pairs that met in an earlier band count there
                    own = sig[starts[member][:, None] + np.arange(band)]
                    i, j = np.nonzero(link)
                    early = (own[left[i]] == own[right[j]]).any(1)
                    link[i[early], j[early]] = False
                size = cols["size"][member].astype(np.int64)
                n_links = np.zeros(len(member), np.int64)
                n_links[left] += link @ size[right]
                if bi != bj:
                    n_links[right] += link.T @ size[left]
                linked = np.flatnonzero(n_links)
                rid.append(cols["rid"][member][linked])
                links.append(n_links[linked])
                root.append(cols["rid"][member][_roots(len(member), left, right, link)[linked]])
            if rid:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (rid, links, root)], ["rid", "links", "root"])
    return rows.mapInArrow(run, "rid bigint, links bigint, root bigint")


def _banded(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, band, hash) of the classes, and the buckets with several."""
    banded = reps.select("rid", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return banded, buckets


def candidate_groups(reps: DataFrame) -> DataFrame:
    """(node, component) of the classes that share a band with another."""
    banded, buckets = _banded(reps)
    ties = (banded.join(buckets, ["band", "hash"]).filter("rid <> first")
            .select(F.col("rid").alias("a"), F.col("first").alias("b")))
    return components(ties)


def _units(groups: DataFrame, classes: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """(rid, unit, band, bands, size, nb): what is compared with what, and in
    how many blocks. ``groups``: (rid, comp, size, chars)."""
    def blocks(n, chars):
        return F.greatest(F.ceil(n / block_rows), F.ceil(chars / block_chars)).cast("int").alias("nb")

    stats = staged(groups.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("chars").alias("chars")), "sizes")
    none = F.lit(None).cast("array<bigint>").alias("bands")
    loose = None
    if stats.filter(F.col("m") > block_rows).limit(1).count():
        banded, buckets = _banded(classes)
        cost = (buckets.join(groups.select(F.col("rid").alias("first"), "comp"), "first").groupBy("comp")
                .agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs")))
        large = stats.filter(F.col("m") > block_rows)
        loose = staged(large.join(cost, "comp").filter(F.col("pairs") < F.col("m").cast("double") * F.col("m")).select("comp"), "loose")
    if loose is None or not loose.limit(1).count():
        return (groups.select("rid", "comp", "size").join(stats.select("comp", blocks(F.col("m"), F.col("chars"))), "comp")
                .select("rid", F.col("comp").alias("unit"), F.lit(-1).alias("band"), none, "size", "nb"))
    whole = (groups.join(loose, "comp", "left_anti").select("rid", "comp", "size")
             .join(stats.select("comp", blocks(F.col("m"), F.col("chars"))), "comp")
             .select("rid", F.col("comp").alias("unit"), F.lit(-1).alias("band"), none, "size", "nb"))
    members = (groups.join(loose, "comp", "left_semi").join(classes.select("rid", "bands"), "rid")
               .select("rid", "size", "chars", "bands", F.posexplode("bands").alias("band", "hash"))
               .withColumn("unit", F.xxhash64("band", "hash")))
    units = (members.groupBy("unit", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).filter("n > 1")
             .select("unit", "band", blocks(F.col("n"), F.col("chars"))))
    return whole.unionByName(members.join(units, ["unit", "band"]).select("rid", "unit", "band", "bands", "size", "nb"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    n: int = GRAM, recall: float = RECALL, block_rows: int = BLOCK_ROWS,
                    block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: id, rid, class_rid (smallest row with the same
    n-gram set), n_links (other rows at ``threshold`` or more), component_rid
    (smallest row reachable by links), kept (is that row)."""
    bands, per_band = choose_bands(threshold, recall)
    rows = row_ids(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", ["text"])
    signed = staged(_signed(rows, bands, per_band, n), "signed")
    classes = staged(signed.groupBy("d1", "d2").agg(
        F.min(F.struct("rid", "bands", "chars")).alias("first"), F.count(F.lit(1)).alias("size"))
        .select("d1", "d2", "first.rid", "first.bands", "first.chars", "size"), "classes")
    groups = staged(candidate_groups(classes).select(F.col("node").alias("rid"), F.col("component").alias("comp"))
                    .join(classes.select("rid", "size", "chars"), "rid"), "groups")
    plan = staged(_units(groups, classes, block_rows, block_chars), "plan")
    spread = (drop_or_keep(rows.select("rid", "text"), plan, "rid", "inner")
              .withColumn("block", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
              .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
              .withColumn("grp", F.xxhash64("unit", "band", "bi", "bj")))
    tiles = (spread.select("grp", "unit", "band", "bands", "bi", "bj", "block", "rid", "size", "text")
             .repartition("grp").sortWithinPartitions("grp"))
    found = staged(_verified(tiles, threshold, n), "links")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    per_class = (classes.select("d1", "d2", F.col("rid").alias("class_rid"), "size")
                 .join(links.withColumnRenamed("rid", "class_rid"), "class_rid", "left")
                 .join(linked.withColumnRenamed("node", "class_rid"), "class_rid", "left")
                 .select("d1", "d2", "class_rid",
                         (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                         F.coalesce("component", "class_rid").alias("component_rid")))
    member = signed.select("rid", "d1", "d2").join(per_class, ["d1", "d2"]).drop("d1", "d2")
    out = rows.select("id", "rid").join(member, "rid", "left")
    return out.select(
        F.col("id").alias(id_col), "rid", F.coalesce("class_rid", "rid").alias("class_rid"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_rid", "rid").alias("component_rid"),
        (F.coalesce("component_rid", "rid") == F.col("rid")).alias("kept"))
