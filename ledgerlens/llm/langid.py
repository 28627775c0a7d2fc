"""Language identification with error-correcting output codes.

Each language gets a codeword of +1/-1 bits. One binary classifier per bit
(logistic regression over hashed byte n-grams) predicts whether a text's
language has that bit; loss-weighted decoding picks the codeword with the
least total logistic loss, where a bit weighs as much as its classifier is
right on the training sample. A text whose two nearest codewords are about
equally far is flagged ambiguous.

Training uses a bounded sample: the ``per_lang`` labelled texts of each
language with the smallest hash of id and text (and at most ``max_sample`` in
all, shared out evenly). Their n-gram vectors are made where the texts lie and
meet in one task, which fits the classifiers (``max_sample`` x ``DIMS``
floats); the driver gets the fitted model alone. Prediction runs over all rows
in one narrow pass.

Edge cases: null texts and texts without a letter are ``und`` with score 0;
null labels are never learned from; with no labelled text at all every row is
``und``; one single language is always predicted with score 1; repeated rows
are predicted each; other columns are ignored; very long texts are featurised
in slices of ``SLICE`` bytes."""
from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release_memory, small_batches, utf8

DIMS = 8192               # hashed n-gram buckets
ORDERS = (1, 2, 3, 4)     # n-gram lengths in bytes
SLICE = 1 << 20           # bytes featurised at once
ROWS_AT_ONCE = 256        # texts featurised at once
UND = "und"

# spread n-grams over the buckets (odd multipliers)
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a"): ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray      # languages x bits, +1 / -1
    weights: np.ndarray   # DIMS x bits
    bias: np.ndarray
    trust: np.ndarray     # weight of each bit's loss


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of ``n`` languages. Up to five: the exhaustive code (every
    split of the languages once). More: the best of many random codes by
    smallest row distance, then by distinct columns."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        cols = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, float).T
    rng = np.random.default_rng(seed)
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    best, best_gap = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        code[:, np.abs(code.sum(0)) == n] *= rng.choice([-1.0, 1.0], size=(n, 1))
        gap = min(int((code[i] != code[j]).sum()) for i in range(min(n, 64)) for j in range(i))
        if gap > best_gap:
            best, best_gap = code, gap
    return best


def _count_slice(raw: np.ndarray, row: np.ndarray, n_rows: int, out: np.ndarray) -> None:
    """Add the n-gram counts of folded bytes ``raw`` (of rows ``row``)."""
    value = np.zeros(len(raw), np.uint64)
    for n in ORDERS:
        if len(raw) < n:
            break
        value = (value[: len(raw) - n + 1] << np.uint64(8)) | raw[n - 1:].astype(np.uint64)
        ok = row[: len(raw) - n + 1] == row[n - 1:]
        bucket = (((value + np.uint64(n)) * _MULT[n - 1]) >> np.uint64(51)).astype(np.int64)
        flat = row[: len(bucket)][ok] * DIMS + bucket[ok]
        out += np.bincount(flat, minlength=n_rows * DIMS).reshape(n_rows, DIMS)


def features(column: pa.Array) -> np.ndarray:
    """Unit-length vectors of square-rooted n-gram counts, one row per text."""
    raw, off = utf8(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    n_rows = len(off) - 1
    out = np.zeros((n_rows, DIMS), np.float32)
    lap = max(ORDERS) - 1
    for start in range(0, len(raw), SLICE):
        part = _FOLD[raw[start: start + SLICE]]
        row = np.searchsorted(off, np.arange(start, start + len(part)), "right") - 1
        keep = np.ones(len(part), bool)
        keep[1:] = (part[1:] != 32) | (part[:-1] != 32) | (row[1:] != row[:-1])
        _count_slice(part[keep], row[keep], n_rows, out)
        if start + SLICE < len(raw):  # n-grams that cross into the next slice
            edge = _FOLD[raw[start + SLICE - lap: start + SLICE + lap]]
            erow = np.searchsorted(off, np.arange(start + SLICE - lap, start + SLICE - lap + len(edge)), "right") - 1
            inner, outer = (np.zeros((n_rows, DIMS), np.float32) for _ in range(2))
            _count_slice(edge, erow, n_rows, outer)
            _count_slice(edge[:lap], erow[:lap], n_rows, inner)
            _count_slice(edge[lap:], erow[lap:], n_rows, inner)
            out += outer - inner
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-12)


def has_letter(column: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(column.cast(pa.large_string()).fill_null(""), r"\pL").to_numpy(zero_copy_only=False)


def _sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, max_sample: int) -> DataFrame:
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    want = max(1, min(per_lang, max_sample // len(counts)))
    # a uniform cut by key hash keeps about 4 x want rows a language, so the
    # exact ranking below sorts a bounded number of rows
    cut = F.lit(1.0)
    for lang, n in counts.items():
        if n > 8 * want:
            cut = F.when(F.col("lang") == lang, F.lit(4.0 * want / n)).otherwise(cut)
    near = rows.filter((F.col("key") / float(1 << 64) + 0.5) <= cut)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= want).select("lang", "text")


def _sample_vectors(sample: DataFrame) -> DataFrame:
    """(lang, x): the vector of each sampled text, as 32-bit floats."""
    def run(batches):
        for big in batches:
            for batch in small_batches(iter([big]), "text", SLICE):
                for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(i, ROWS_AT_ONCE)
                    x = features(part.column("text"))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("lang"), pa.array([v.astype(np.float32).tobytes() for v in x], pa.binary())],
                        ["lang", "x"])
    return sample.mapInArrow(run, "lang string, x binary")


def fit(x: np.ndarray, labels: list[str], steps: int = 120, l2: float = 1e-5) -> Model:
    """The bit classifiers of labelled vectors."""
    langs = sorted(set(labels))
    code = codewords(len(langs))
    y = code[[langs.index(v) for v in labels]].astype(np.float32)
    bits = code.shape[1]
    w, b = np.zeros((DIMS, bits), np.float32), np.zeros(bits, np.float32)
    # languages weigh alike whatever their share of the sample
    share = np.array([1.0 / labels.count(v) for v in labels], np.float32)[:, None]
    share /= share.sum()
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        margin = np.clip(y * (x @ w + b), -30, 30)
        g = -y / (1 + np.exp(margin)) * share
        gw, gb = x.T @ g + l2 * w, g.sum(0)
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9 ** t, 1 - 0.999 ** t
        w -= 0.3 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.3 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    right = ((y * (x @ w + b)) > 0).mean(0) if bits else np.zeros(0)
    trust = np.maximum(right - 0.5, 0.05)
    return Model(langs, code, w, b, trust / trust.sum() if bits else trust)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_lang: int = 400, max_sample: int = 3000, steps: int = 120, l2: float = 1e-5) -> Model | None:
    """Fit the bit classifiers on the bounded sample of the labelled rows of
    ``df``; None when there is none."""
    def run(batches):
        rows = sorted((lang, x) for batch in batches
                      for lang, x in zip(batch.column("lang").to_pylist(), batch.column("x").to_pylist()))
        if rows:
            matrix = np.empty((len(rows), DIMS), np.float32)
            for i, (_, x) in enumerate(rows):
                matrix[i] = np.frombuffer(x, np.float32)
            model = fit(matrix, [lang for lang, _ in rows], steps, l2)
            arrays = [model.code.astype(np.float64), model.weights.astype(np.float32), model.bias.astype(np.float32), model.trust.astype(np.float64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.langs], pa.list_(pa.string())), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]],
                ["langs", "code", "weights", "bias", "trust"])
            del matrix, model, arrays
        del rows
        release_memory()

    vectors = _sample_vectors(_sample(df, id_col, text_col, lang_col, per_lang, max_sample))
    found = vectors.repartition(1).mapInArrow(run, "langs array<string>, code binary, weights binary, bias binary, trust binary").first()
    if found is None:
        return None
    n = len(found["langs"])
    return Model(list(found["langs"]), np.frombuffer(found["code"], np.float64).reshape(n, -1),
                 np.frombuffer(found["weights"], np.float32).reshape(DIMS, -1), np.frombuffer(found["bias"], np.float32),
                 np.frombuffer(found["trust"], np.float64))


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, ambiguous) of feature rows."""
    n = len(x)
    if len(model.langs) == 1:
        return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
    margin = (x @ model.weights + model.bias).astype(float)
    loss = np.stack([(np.logaddexp(0, -margin * word) * model.trust).sum(1) for word in model.code], 1)
    order = np.sort(loss, 1)
    p = np.exp(-(loss - order[:, :1]) * model.code.shape[1])
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return best, p.max(1), (order[:, 1] - order[:, 0]) * model.code.shape[1] < 0.1


def predict(df: DataFrame, model: Model | None, text_col: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all; a column named like an output is
    replaced) plus lang_pred, score, ambiguous."""
    out = ["lang_pred", "score", "ambiguous"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in out]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col, SLICE):
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                text, n = part.column(text_col), part.num_rows
                known = has_letter(text) if model else np.zeros(n, bool)
                best, score, unsure = (decode(model, features(text)) if model
                                       else (np.zeros(n, int), np.zeros(n), np.zeros(n, bool)))
                names = [model.langs[b] if k else UND for b, k in zip(best, known)] if model else [UND] * n
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep]
                    + [pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(unsure & known)],
                    [*keep, *out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep]
    src = df.select(*dict.fromkeys([*keep, text_col]))
    return src.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "ambiguous boolean"]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: CRC-32 of the id's decimal text is 1 mod 3
    (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
