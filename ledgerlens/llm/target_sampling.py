"""Target-distribution importance resampling: documents whose hashed word
n-grams are likelier under a target corpus are drawn with higher probability.

A feature is a run of 1 to ``MAX_RUN`` consecutive words joined by one space;
its bucket is the CRC-32 of its UTF-8 bytes modulo ``n_buckets``. Two passes
read the texts where they lie: one counts buckets (each task sends at most
``n_buckets`` counts), one scores each document from an array of bucket gains.
Only those counts reach the driver. CRCs of runs are combined from the CRCs of
their words, array-wise, so no run is ever built as a string.

The draw adds Gumbel noise from a hash of the id and keeps the highest scores.
Ranks come from ``radix_rank``, a distributed LSD radix sort.

Rows: a null or empty text has no words, no features and weight 0; a null id is
hashed as the word ``null`` and comes before all other ids among equal scores;
rows with equal ids stay rows of their own (equal ones are interchangeable);
an empty table gives an empty result, an empty target only noise and gains
from the smoothing. Only the id and text columns are read, so extra columns
and clashing names do not matter."""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, release_memory, small_batches, utf8

BUCKETS = 10_000
MAX_RUN = 3
BATCH_BYTES = 2 << 20
BLOCK_WORDS = 1 << 18
LONG_WORD = 48
DIGIT_BITS = 10
MAX_BLOCK_BITS = 20
MIN_BLOCK_BITS = 12

# -- words and features of a batch ---------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[ord("0"): ord("9") + 1] = _IS_WORD[ord("a"): ord("z") + 1] = _IS_WORD[128:] = True


def _crc_tables(longest: int) -> np.ndarray:
    """``[n, j, b]``: the CRC register that n zero bytes make of byte value b
    at byte j of the register; n up to ``longest``."""
    one = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, longest + 1):
        out[n] = one[out[n - 1] & 0xFF] ^ (out[n - 1] >> 8)
    return out


_SHIFT = _crc_tables(LONG_WORD + 1)
_FRESH = np.uint32(0xFFFFFFFF)


def _shifted(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (_SHIFT[n, 0, register & 0xFF] ^ _SHIFT[n, 1, (register >> 8) & 0xFF]
            ^ _SHIFT[n, 2, (register >> 16) & 0xFF] ^ _SHIFT[n, 3, register >> 24])


def _word_registers(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers of the words from a zero register, byte by byte over all
    words that are still going on."""
    order = np.argsort(-length, kind="stable")
    first, size = start[order], length[order]
    crc = np.zeros(len(start), np.uint32)
    left = len(start)
    for k in range(int(size[0]) if len(size) else 0):
        left = int(np.searchsorted(-size[:left], -k, "left"))
        live = crc[:left]
        crc[:left] = _SHIFT[1, 0, (live ^ data[first[:left] + k]) & 0xFF] ^ (live >> 8)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word in lower-cased UTF-8 bytes."""
    word = _IS_WORD[data]
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    cuts = off[:-1][off[:-1] < len(data)]
    before[cuts] = False
    start = np.flatnonzero(word & ~before)
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    ends = off[1:][off[1:] > 0] - 1
    after[ends] = False
    end = np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, n_buckets: int
             ) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(run, first, last, buckets): the buckets of the runs of ``run`` words
    that start at words first..last-1; runs that would leave their text have
    bucket -1. Words are taken in blocks, so memory follows the block."""
    n = len(start)
    for lo in range(0, n, BLOCK_WORDS):
        hi = min(n, lo + BLOCK_WORDS)
        top = min(n, hi + MAX_RUN - 1)
        s, e, t = start[lo:top], end[lo:top], text[lo:top]
        long = (e - s) > LONG_WORD
        size = np.where(long, 0, e - s)
        own = _word_registers(data, s, size)
        spaced = _shifted(np.full(len(s), _SHIFT[1, 0, 0x20], np.uint32), size) ^ own
        crc = _shifted(np.full(len(s), _FRESH, np.uint32), size) ^ own
        far = long
        for run in range(1, MAX_RUN + 1):
            if run > 1:
                crc = _shifted(crc[:-1], size[run - 1:] + 1) ^ spaced[run - 1:]
                far = far[:-1] | long[run - 1:]
            buckets = ((crc ^ _FRESH) % np.uint32(n_buckets)).astype(np.int32)
            inside = t[: len(crc)] == t[run - 1:]
            for i in np.flatnonzero(far & inside):
                joined = b" ".join(data[s[j]: e[j]].tobytes() for j in range(i, i + run))
                buckets[i] = zlib.crc32(joined) % n_buckets
            buckets[~inside] = -1
            count = min(hi - lo, len(crc))
            yield run, lo, lo + count, buckets[:count]
            if len(crc) < 2:
                break


def _batches(batches, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in small_batches(batches, text, BATCH_BYTES):
        raw, off = utf8(batch.column(text))
        yield batch, _LOWER[raw], off


# -- bucket counts and gains ---------------------------------------------------

def bucket_counts(docs: DataFrame, text_col: str = "text", n_buckets: int = BUCKETS) -> dict[int, int]:
    """Features per bucket over all texts. Each task adds up its own array
    first; the result has at most ``n_buckets`` entries."""
    def count(batches):
        total = np.zeros(n_buckets, np.int64)
        for _, data, off in _batches(batches, "text"):
            for *_, buckets in features(data, *word_spans(data, off), n_buckets):
                total += np.bincount(buckets[buckets >= 0], minlength=n_buckets)
        found = np.flatnonzero(total)
        release_memory()
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(found, pa.int32()), "n": pa.array(total[found], pa.int64())})

    parts = docs.select(F.col(text_col).alias("text")).filter(F.length("text") > 0).mapInArrow(count, "bucket int, n bigint")
    return {r["bucket"]: r["n"] for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], n_buckets: int = BUCKETS) -> np.ndarray:
    """Smoothed log ratio of target to source per bucket, in thousandths."""
    s_all, t_all = sum(source.values()), sum(target.values())
    out = np.empty(n_buckets, np.int64)
    for b in range(n_buckets):
        ratio = ((target.get(b, 0) + 1.0) * (s_all + float(n_buckets))) / ((source.get(b, 0) + 1.0) * (t_all + float(n_buckets)))
        out[b] = math.floor(1000 * math.log(ratio))
    return out


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    n_buckets = len(gain)
    padded = np.append(gain, 0)   # bucket -1, a run that leaves its text, adds nothing

    def score(batches):
        for batch, data, off in _batches(batches, "text"):
            start, end, text = word_spans(data, off)
            per_word = np.zeros(len(start), np.int64)
            for _, lo, hi, buckets in features(data, start, end, text, n_buckets):
                per_word[lo:hi] += padded[buckets]
            edge = np.searchsorted(text, np.arange(len(off)))
            words = np.diff(edge)
            runs = sum(np.maximum(words - k, 0) for k in range(MAX_RUN))
            total = np.diff(np.concatenate([[0], np.cumsum(per_word)])[edge])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(words, pa.int64()),
                                              "n_features": pa.array(runs, pa.int64()), "weight": pa.array(total, pa.int64())})

    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(score, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


# -- LSD radix sort ------------------------------------------------------------

def _key_words(rows: DataFrame, keys: list[tuple[str, bool]]) -> list[tuple[Column, int]]:
    """The sort keys as unsigned words (column, bits), least significant
    first. A key (name, descending) becomes its distance from its first value;
    narrow keys are packed into one word, so digits run across them."""
    ask = [f(F.col(c)).alias(f"{f.__name__}{i}") for i, (c, _) in enumerate(keys) for f in (F.min, F.max)]
    ask += [F.max(F.col(c).isNull()).alias(f"null{i}") for i, (c, _) in enumerate(keys)]
    seen = rows.agg(*ask).first()
    parts: list[tuple[Column, int]] = []
    for i, (c, down) in reversed(list(enumerate(keys))):
        lo, hi = seen[f"min{i}"], seen[f"max{i}"]
        if lo is None:
            continue
        if hi - lo < 1 << 61:
            away = (F.lit(hi) - F.col(c)) if down else (F.col(c) - F.lit(lo))
            parts.append((F.coalesce(away + 1, F.lit(0)), (hi - lo + 1).bit_length()))
        else:   # a span beyond 61 bits: the value's own bits, sign turned, behind a digit for nulls
            plain = F.coalesce(F.col(c), F.lit(0)).bitwiseXOR(F.lit(-1 << 63))
            parts.append((F.bitwise_not(plain) if down else plain, 64))
            if seen[f"null{i}"]:
                parts.append((F.col(c).isNotNull().cast("bigint"), 1))
    words: list[tuple[Column, int]] = []
    for column, bits in parts:
        if words and words[-1][1] + bits <= 62:
            low, used = words[-1]
            words[-1] = (F.shiftleft(column, used).bitwiseOR(low), used + bits)
        else:
            words.append((column, bits))
    return words


def _place(rows: pa.Table, starts: pa.Table) -> pa.Table:
    """Counting-sort step of one block: rows in their present order, stably by
    digit, get the block's next free places of their digit."""
    pos, digit = rows.column("pos").to_numpy(), rows.column("digit").to_numpy()
    order = np.lexsort((pos, digit))
    digit = digit[order]
    slot = np.empty(int(digit.max()) + 1 if len(digit) else 1, np.int64)
    slot[starts.column("digit").to_numpy()] = starts.column("start").to_numpy()
    rank = np.arange(len(digit)) - np.searchsorted(digit, digit, "left")
    out = rows.take(pa.array(order)).drop_columns(["block", "digit"])
    return out.set_column(out.schema.get_field_index("pos"), "pos", pa.array(slot[digit] + rank, pa.int64()))


def radix_rank(rows: DataFrame, keys: list[tuple[str, bool]], digit_bits: int = DIGIT_BITS,
               block_bits: int | None = None) -> DataFrame:
    """``rows`` with ``pos``: 0, 1, 2... in the order of the bigint columns
    ``keys`` ((name, descending), most significant first; nulls first).

    Every pass is one stable counting sort by the next digit. Rows stand in
    blocks of at most 2**block_bits consecutive places; (digit, block) counts
    give each block its first place for each digit, as a prefix sum over the
    blocks beside the total of all smaller digits, and one shuffle by block
    moves the rows. No task holds more than a block, whatever the keys; the
    driver sees 2**digit_bits totals. A digit that all rows share needs no
    pass. Each pass is written to the shared folder, so a lost executor
    repeats one pass at most. Equal keys keep some fixed order."""
    spark = rows.sparkSession
    stage = Stage(spark, rows.withColumn("pos", F.monotonically_increasing_id()), "radix")
    n = stage.df.count()
    if not n:
        return stage.df
    if block_bits is None:
        block_bits = min(MAX_BLOCK_BITS, max(MIN_BLOCK_BITS, (n // 512).bit_length()))
    schema = stage.df.schema
    moved = False
    passes = [(word, shift) for word, bits in _key_words(stage.df, keys) for shift in range(0, bits, digit_bits)]
    for word, shift in passes:
        digit = F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << digit_bits) - 1)).cast("int")
        dealt = stage.df.withColumn("digit", digit).withColumn("block", F.shiftright("pos", block_bits))
        counts = dealt.groupBy("digit", "block").agg(F.count(F.lit(1)).alias("n"))
        totals = sorted((r["digit"], r["n"]) for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect())
        if len(totals) == 1:
            continue
        ends = np.cumsum([t for _, t in totals]).tolist()
        bases = spark.createDataFrame([(d, e - t) for (d, t), e in zip(totals, ends)], "digit int, base bigint")
        earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("digit", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        starts = starts.join(F.broadcast(bases), "digit").select(
            F.col("digit").alias("digit"), F.col("block").alias("block"), (F.col("base") + F.col("before")).alias("start"))
        out = dealt.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(_place, schema)
        after = Stage(spark, out, "radix")
        stage.drop()
        stage, moved = after, True
    if not moved:   # one key throughout: any gapless numbering is the order
        return radix_rank_by_place(stage.df)
    return stage.df


def radix_rank_by_place(rows: DataFrame) -> DataFrame:
    """``pos`` without its gaps, from the rows per written partition."""
    part = F.shiftright("pos", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.col("base") + F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("part", part).join(sizes, "part").withColumn("pos", place).drop("part", "base")


# -- the operator --------------------------------------------------------------

def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42,
             n_buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank``
    (1, 2, ...) for the drawn ``percent`` of those with ``min_words`` words."""
    gain = gains(bucket_counts(docs, text_col, n_buckets), bucket_counts(target, text_col, n_buckets), n_buckets)
    weighed = weigh(docs, gain, id_col, text_col)
    scored = Stage(docs.sparkSession, weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored").df
    ranked = radix_rank(scored.filter(F.col("n_words") >= min_words), [("score", True), ("doc_id", False)])
    wanted = percent * ranked.count() // 100
    rank = F.when(F.col("pos") < wanted, F.col("pos") + 1)
    cols = ["doc_id", "n_features", "weight", "score"]
    short = scored.filter(F.col("n_words") < min_words).select(*cols, F.lit(None).cast("bigint").alias("rank"))
    return reduce(DataFrame.unionByName, [ranked.select(*cols, rank.alias("rank")), short])
