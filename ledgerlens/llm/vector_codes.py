"""Vector code compression: product quantisation in integers. Vectors become
scaled integers, are cut into equal parts, and each part is replaced by the
number of its nearest codebook entry.

The nearest entry comes from a GNAT (geometric near-neighbour access tree)
built over the entries of a part: split points store, for each child, the
range of distances from the split point to everything below that child. A
query's distance to a split point rules out every child whose range lies
strictly beyond the best distance so far; distances are rounded outwards, so
rounding never rules out a tie. What is left is compared by exact integer
squared distances, ties to the lower entry.

Codebooks are refined by Lloyd rounds: each task adds up its parts per entry
(at most parts x entries sums a task), the driver sees those sums only.

Rows: vectors that are null, empty or hold null or non-finite components are
dropped, and so are vectors of another length than that of the smallest kept
id. A length that is not a multiple of the number of parts is padded with
zeros. Scaled components beyond +-2**26 count as +-2**26, so that squared
distances stay within 64 bits. Rows with equal ids each count; the initial
codebook takes ids in order, null ids last, equal ids by their components.
With fewer kept rows than entries the codebook is as short. An empty table
gives an empty result. Other columns are not read."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, release_memory, staged

LIMIT = 1 << 26
DEGREE = 4
HOT_SHARE = 1000


# -- the tree ------------------------------------------------------------------

def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = a - b
    return np.einsum("ij,ij->i", diff, diff)


def _below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - 2.0 ** -48)


def _above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + 2.0 ** -48)


class Gnat:
    """Exact nearest neighbours, vectorised over queries."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE):
        self.entries = np.asarray(entries, np.int64)
        self.degree = degree
        self.compared = 0
        self.root = self._build(np.arange(len(self.entries)))

    def _from(self, i: int, items: np.ndarray) -> np.ndarray:
        return _squared(self.entries[items], self.entries[i][None])

    def _build(self, items: np.ndarray):
        """(split points, children, lo, hi): child j holds what is nearest to
        split point j; lo[i, j] and hi[i, j] bound the distances from split
        point i to split point j and all below it."""
        splits = [int(items[0])] if len(items) else []
        near = self._from(splits[0], items) if splits else None
        while len(splits) < min(self.degree, len(items)):   # each next split point is far from those before
            near[np.isin(items, splits)] = -1
            splits.append(int(items[int(np.argmax(near))]))
            near = np.minimum(near, self._from(splits[-1], items))
        rest = items[~np.isin(items, splits)]
        owner = np.argmin(np.stack([self._from(s, rest) for s in splits]), axis=0) if len(rest) else np.zeros(0, int)
        groups = [rest[owner == j] for j in range(len(splits))]
        lo, hi = np.zeros((2, len(splits), len(splits)))
        for i, s in enumerate(splits):
            for j, group in enumerate(groups):
                away = self._from(s, np.append(group, splits[j]))
                lo[i, j], hi[i, j] = _below(away.min()), _above(away.max())
        return splits, [self._build(g) if len(g) else None for g in groups], lo, hi

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry number and squared distance of each query's nearest entry."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        which = np.zeros(len(queries), np.int64)
        if len(queries) and len(self.entries):
            self._search(self.root, np.asarray(queries, np.int64), np.arange(len(queries)), best, which)
        return which, best

    def _search(self, node, queries, rows, best, which) -> None:
        splits, children, lo, hi = node
        alive = np.ones((len(splits), len(rows)), bool)
        for i, entry in enumerate(splits):
            on = np.flatnonzero(alive[i])
            if not len(on):
                continue
            at = rows[on]
            away = _squared(queries[at], self.entries[entry][None])
            self.compared += len(at)
            wins = (away < best[at]) | ((away == best[at]) & (entry < which[at]))
            best[at[wins]], which[at[wins]] = away[wins], entry
            reach = _above(best[at])
            for j in range(len(splits)):   # strictly out of reach, seen from split point i
                alive[j, on] &= (_below(away) - hi[i, j] <= reach) & (lo[i, j] - _above(away) <= reach)
        for j, child in enumerate(children):
            if child is not None and alive[j].any():
                self._search(child, queries, rows[alive[j]], best, which)


# -- tables --------------------------------------------------------------------

def quantised(df: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """``vec_id, label, v``: kept rows with integer components, padded."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~bad)
    whole = F.transform(vec_col, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    kept = kept.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), whole.alias("v"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    if first is None:
        return kept
    pad = -first["n"] % parts
    padded = F.concat("v", F.array_repeat(F.lit(0), pad)) if pad else F.col("v")
    return kept.filter(F.size("v") == first["n"]).withColumn("v", padded)


def _matrix(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """All vectors of a batch as (rows, parts, width)."""
    column = batch.column("v")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), parts, -1)


def _round(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One Lloyd round: the books with every used entry at the floor of the
    mean of its parts."""
    parts, entries, width = books.shape

    def add(batches):
        trees = [Gnat(b) for b in books]
        total, used = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            m = _matrix(batch, parts)
            for p, tree in enumerate(trees):
                which, _ = tree.nearest(m[:, p])
                used[p] += np.bincount(which, minlength=entries)
                for e in np.unique(which):
                    total[p, e] += m[which == e, p].sum(axis=0)
        p, e = np.nonzero(used)
        release_memory()
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(used[p, e], pa.int64()), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "total"])

    found = vectors.select("v").mapInArrow(add, "part int, entry int, n bigint, total array<bigint>")
    sums = [F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width)]
    out = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*sums).alias("total")).collect():
        out[r["part"], r["entry"]] = [t // r["n"] for t in r["total"]]
    return out


def _encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    parts = len(books)

    def code(batches):
        trees = [Gnat(b) for b in books]
        for batch in batches:
            m = _matrix(batch, parts)
            if not len(m):
                continue
            found = [tree.nearest(m[:, p]) for p, tree in enumerate(trees)]
            digits = np.stack([which for which, _ in found], axis=1)
            codes = ["".join(f"{d:02x}" for d in row) for row in digits.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes), pa.array(sum(d for _, d in found), pa.int64())],
                names=["vec_id", "label", "code", "error"])
        release_memory()

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(code, f"vec_id bigint, label {kind}, code string, error bigint")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_sums(coded: DataFrame, bound: int = 200_000) -> DataFrame:
    """``label_error`` beside every row: errors added up over equal labels,
    nulls together. The sums are pre-aggregated; up to ``bound`` labels they
    are broadcast. Beyond, labels that hold over 1/1000 of the rows (at most
    1,000 labels) are broadcast and only the others meet by shuffle."""
    sums = staged(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    size = sums.agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows")).first()

    def joined(rows: DataFrame, totals: DataFrame, how: str) -> DataFrame:
        totals = totals.select(F.col("label").alias("_label"), "label_error")
        return rows.join(totals, F.col("label").eqNullSafe(F.col("_label")), how).drop("_label")

    if size["labels"] <= bound:
        return joined(coded, F.broadcast(sums), "inner")
    hot: Column = F.col("n") * HOT_SHARE > size["rows"]
    near = joined(coded, F.broadcast(sums.filter(hot)), "left")
    rest = joined(near.filter(F.col("label_error").isNull()).drop("label_error"), sums.filter(~hot), "inner")
    return near.filter(F.col("label_error").isNotNull()).unionByName(rest)


def compress(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
             id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, label, code, error, label_error``, codebooks). The codebooks
    (parts, entries, width) are the decoder: a part's entry is its row."""
    spark = df.sparkSession
    vectors = Stage(spark, quantised(df, id_col, vec_col, label_col, parts, scale), "vectors")
    first = vectors.df.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1 if first else 0).swapaxes(0, 1)
    if first:
        for _ in range(rounds):
            books = _round(vectors.df, books)
    coded = Stage(spark, _encode(vectors.df, books), "coded").df
    vectors.drop()
    return with_label_sums(coded), books


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``v``: the integer vector that each ``code`` stands for."""
    parts = len(books)
    table = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in part]) for part in books])
    digit = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in range(parts)]
    return codes.withColumn("v", F.concat(*[table[p][digit[p]] for p in range(parts)]))
