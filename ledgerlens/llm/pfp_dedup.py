"""Exact-substring deduplication by prefix-free parsing.

Every ``length``-byte string that also starts earlier in the corpus (smaller
document id, or earlier in the same document) is removed.

1. Parsing. A rolling hash over ``trigger`` bytes picks the triggers: a place
   is one if its hash is the smallest (leftmost on ties) of some
   ``length``-byte window. Triggers depend on the bytes around them alone, so
   equal windows have equal triggers at the same offset, and no window is
   without one. The windows with one trigger form a phrase with its context:
   all bytes those windows cover.
2. Dictionary. Phrases are grouped by trigger and content digest. All but the
   first occurrence of a phrase are repeats as a whole (most of the work in
   repetitive text); a phrase whose trigger string occurs nowhere else is
   unique. Phrases repeated within a batch are settled there, so a passage
   that fills the corpus reaches the shuffle once a batch.
3. Suffix order. The remaining dictionary phrases of one trigger are sorted
   twice: their parts before the trigger from the trigger leftwards (the
   order of the dictionary's phrase ends) and the text that follows the
   trigger (the order of the parse from there on), each with the common
   prefix lengths of neighbours. Two windows with the trigger at offset t are
   equal when they agree on t bytes in the first order and on the other
   ``length`` - t in the second; the earliest in corpus order stays.
4. The spans found meet their documents by row id.

Departures from the textbook: the trigger rule (there the hash must be 0 modulo
p, which leaves windows without any trigger); phrases are windows round a
trigger, so there are no phrase ranks, no suffix array of dictionary or parse
and no combination into corpus order (see README).

A trigger with more than ``HOT`` different phrases isn't gathered: its windows
are hashed one by one, and equal windows meet by digest as phrases do in 2.

Edge cases: null text counts as empty; texts shorter than ``length`` lose
nothing; repeated or null ids get row ids first, so a repeated row is a later
document; other columns are ignored; an empty table gives an empty result."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, row_ids, small_batches, staged, utf8
from .words import mix

LENGTH = 100
TRIGGER = 20
HOT = 50_000             # phrases of one trigger that one task may gather
SLICE = 1 << 20          # bytes parsed at once
BATCH_BYTES = 16 << 20   # bytes whose phrases are settled together
GROUP_ROWS = 16_384      # dictionary phrases sorted at once

_rng = np.random.default_rng(100)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def rolling(raw: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes from every place."""
    width, h = 1, _BYTE[raw]
    out, done = None, 0
    step = 0
    while done < n:
        if n & width:
            if out is None:
                out = h
            else:
                m = len(raw) - done - width + 1
                out = out[:m] * _MULT[step] + h[done: done + m]
            done += width
        if done < n:
            m = len(raw) - 2 * width + 1
            if m <= 0:
                return np.zeros(0, np.uint64)
            h = h[:m] * _MULT[step + 1] + h[width: width + m]
            width *= 2
        step += 2
    return mix(out)


def sliding_first_min(h: np.ndarray, n: int) -> np.ndarray:
    """Place of the smallest (leftmost on ties) of every ``n`` values."""
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= n:
        v = np.minimum(v[: len(v) - width], v[width:])
        width *= 2
    rest = n - width
    if rest:
        v = np.minimum(v[: len(v) - rest], v[rest:])
    return (v & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(raw: np.ndarray, off: np.ndarray, length: int, trigger: int) -> tuple[np.ndarray, ...]:
    """(row, pos, n, a, key, fp) of the phrases of texts: the place of the
    first window in its text, how many windows, the trigger's offset in the
    first, and the digests of trigger and content."""
    parts = []
    at = 0
    while at < len(raw):
        stop = min(at + SLICE, len(raw))
        part = raw[at: stop + length - 1]
        if len(part) < length:
            break
        h = rolling(part, trigger)
        anchor = sliding_first_min(h, length - trigger + 1)
        m = len(anchor)
        r0, r1 = np.searchsorted(off, [at, at + m], "right") - 1
        r1 = min(int(r1), len(off) - 2)
        bounds = np.clip(off[r0: r1 + 2] - at, 0, m)
        row = np.repeat(np.arange(r0, r1 + 1), np.diff(bounds))
        valid = np.arange(at, at + len(row)) + length <= off[row + 1]
        place = np.flatnonzero(valid)
        if len(place):
            own = anchor[place]
            new = np.ones(len(place), bool)
            new[1:] = own[1:] != own[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(place)) - 1
            p0, p1, g = place[first], place[last], own[first]
            content = _window_digest(h, p0, length, trigger) * _MULT[60] + _window_digest(h, p1, length, trigger)
            n = p1 - p0 + 1
            rows = row[p0]
            parts.append((rows, p0 + at - off[rows], n, g - p0, mix(h[g]), mix(content + n.astype(np.uint64) * _MULT[61])))
        at = stop
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _window_digest(h: np.ndarray, p: np.ndarray, length: int, trigger: int) -> np.ndarray:
    out = np.zeros(len(p), np.uint64)
    for j in range(-(-length // trigger)):
        out = mix(out * _MULT[30 + j % 20] + h[p + min(j * trigger, length - trigger)])
    return out


def merge_spans(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open spans per row."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((stop, start, row))
    row, start, stop = row[order], start[order], stop[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    # running maximum of the ends inside each row
    base = (np.cumsum(fresh) - 1) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + base) - base
    new = fresh.copy()
    new[1:] |= start[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(row)) - 1
    return row[heads], start[heads], reach[tails]


_PARSED = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("rid", pa.int64()), ("pos", pa.int64()), ("info", pa.int64())])
_FOUND = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("rid", pa.int64()), ("pos", pa.int64()), ("info", pa.int64())])
_SPAN = pa.schema([("rid", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
SPAN, SUSPECT, SUSPECT_HOT = 0, 1, 2
_SHIFT = 20  # info of a phrase: a << _SHIFT | n; of a settled span: -bytes


def _sql(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int8(): "tinyint", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _settled(rid, pos, n, info, key, fp, length) -> pa.RecordBatch:
    """Rows for the shuffle: the first phrase of each content in the batch,
    and the spans of the others (repeats already)."""
    order = np.lexsort((pos, rid))
    order = order[np.argsort((key[order] * _MULT[62]) ^ fp[order], kind="stable")]
    again = np.zeros(len(order), bool)
    again[1:] = (key[order][1:] == key[order][:-1]) & (fp[order][1:] == fp[order][:-1])
    first, rest = order[~again], order[again]
    r, s, e = merge_spans(rid[rest], pos[rest], pos[rest] + n[rest] + length - 1)
    spread = mix(r.view(np.uint64) * _MULT[63] + s.view(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (
        (key[first].view(np.int64), spread.view(np.int64)), (fp[first].view(np.int64), np.zeros(len(r), np.int64)),
        (rid[first], r), (pos[first], s), (info[first], s - e))], schema=_PARSED)


def _parse(rows: DataFrame, length: int, trigger: int) -> DataFrame:
    def run(batches):
        for batch in small_batches(batches, "text", BATCH_BYTES):
            raw, off = utf8(batch.column("text"))
            row, pos, n, a, key, fp = phrases(raw, off, length, trigger)
            if len(row):
                rid = batch.column("rid").to_numpy()[row]
                yield _settled(rid, pos, n, (a << _SHIFT) | n, key, fp, length)
    return rows.select("rid", "text").mapInArrow(run, _sql(_PARSED))


def _meet(parsed: DataFrame, length: int, hot: int) -> DataFrame:
    """Phrases by trigger and content: the repeats' spans, and the different
    phrases of triggers that have several. Streams over sorted rows and holds
    at most ``hot`` phrases of one trigger."""
    def run(batches):
        last_key = last_fp = None
        held: list[tuple] = []      # phrases of the trigger that may go on
        n_held, flooded = 0, False

        def flush(kind):
            nonlocal held, n_held
            out, held, n_held = held, [], 0
            return [(np.full(len(x[0]), kind, np.int8), *x) for x in out]

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, rid, pos, info = (batch.column(c).to_numpy() for c in _PARSED.names)
            done = info < 0
            out = [(np.full(int(done.sum()), SPAN, np.int8), key[done], rid[done], pos[done], info[done])]
            key, fp, rid, pos, info = (x[~done] for x in (key, fp, rid, pos, info))
            if len(key):
                again = np.zeros(len(key), bool)
                again[1:] = (key[1:] == key[:-1]) & (fp[1:] == fp[:-1])
                again[0] = key[0] == last_key and fp[0] == last_fp
                size = (info[again] & ((1 << _SHIFT) - 1)) + length - 1
                out.append((np.full(int(again.sum()), SPAN, np.int8), key[again], rid[again], pos[again], -size))
                last_fp = fp[-1]
                key_, rid, pos, info = (x[~again] for x in (key, rid, pos, info))
                cuts = np.flatnonzero(key_[1:] != key_[:-1]) + 1
                edges = [0, *cuts.tolist(), len(key_)]
                # inner triggers are whole: keep those with several phrases
                if len(edges) > 3:
                    a, b = edges[1], edges[-2]
                    counts = np.diff(edges[1:-1])
                    several = np.repeat(counts > 1, counts)
                    kind = np.repeat(np.where(counts > hot, SUSPECT_HOT, SUSPECT).astype(np.int8), counts)
                    out.append((kind[several], *(x[a:b][several] for x in (key_, rid, pos, info))))
                for a, b in ([(edges[0], edges[1])] if len(edges) == 2 else [(edges[0], edges[1]), (edges[-2], edges[-1])]):
                    if a == b:
                        continue
                    if key_[a] != last_key:
                        out += flush(SUSPECT_HOT if flooded else SUSPECT) if n_held > 1 or flooded else []
                        held, n_held, flooded = [], 0, False
                    last_key = key_[a]
                    held.append(tuple(x[a:b] for x in (key_, rid, pos, info)))
                    n_held += b - a
                    if n_held > hot or flooded:
                        flooded = True
                        out += flush(SUSPECT_HOT)
            yield _batch(out, _FOUND)
        if held and (n_held > 1 or flooded):
            yield _batch(flush(SUSPECT_HOT if flooded else SUSPECT), _FOUND)

    rows = parsed.repartition("key").sortWithinPartitions("key", "fp", "rid", "pos")
    return rows.mapInArrow(run, _sql(_FOUND))


def _batch(parts: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=schema)


def _with_text(rows: DataFrame, found: DataFrame, kind: int) -> DataFrame:
    """(rid, text, marks) of the documents with suspects of a kind; the marks
    of a document are no more than its phrases."""
    marks = (found.filter(F.col("kind") == kind).groupBy("rid")
             .agg(F.collect_list(F.struct("key", "pos", "info")).alias("marks")))
    return rows.select("rid", "text").join(marks, "rid")


def _marks(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    lists = batch.column("marks")
    flat = lists.flatten()
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    return row, *(flat.field(c).to_numpy() for c in ("key", "pos", "info"))


def _phrase_text(with_text: DataFrame, length: int) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("pos", pa.int64()), ("info", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        for batch in small_batches(batches, "text", BATCH_BYTES):
            raw, off = utf8(batch.column("text"))
            row, key, pos, info = _marks(batch)
            start = off[row] + pos
            size = (info & ((1 << _SHIFT) - 1)) + length - 1
            to = np.concatenate([[0], np.cumsum(size)])
            data = raw[np.arange(int(to[-1])) + np.repeat(start - to[:-1], size)]
            values = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(to.astype(np.int32).tobytes()),
                                                                         pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(batch.column("rid").to_numpy()[row]), pa.array(pos),
                                              pa.array(info), values], schema=schema)
    return with_text.mapInArrow(run, _sql(schema))


def _order(key: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows inside each key, and how many bytes each
    shares with the one before it (-1 where the key is new)."""
    named = np.concatenate([key.astype(">i8").view(np.uint8).reshape(len(key), 8), side], 1)
    order = np.argsort(np.ascontiguousarray(named).view(f"S{named.shape[1]}").ravel(), kind="stable")
    a = named[order]
    common = np.full(len(key), -1)
    differ = a[1:] != a[:-1]
    same = ~differ.any(1)
    upto = np.where(same, a.shape[1], differ.argmax(1)) - 8
    common[1:] = np.where(upto < 0, -1, upto)
    return order, common


def repeated_windows(key, rid, pos, info, raw, off, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (rid, start, stop) of the windows of dictionary phrases that also
    start earlier in another phrase of the same trigger."""
    order = np.lexsort((pos, rid))  # corpus order
    key, rid, pos, info, off0 = key[order], rid[order], pos[order], info[order], off[:-1][order]
    n, a = info & ((1 << _SHIFT) - 1), info >> _SHIFT
    low = a - n + 1                      # offsets of the trigger: low .. a
    centre, end = off0 + a, off[1:][order]
    deep = int(a.max())
    left = centre[:, None] - 1 - np.arange(max(deep, 1))
    left = np.where(left >= off0[:, None], raw[np.maximum(left, 0)], 0).astype(np.uint8)
    right = centre[:, None] + np.arange(length)
    right = np.where(right < end[:, None], raw[np.minimum(right, len(raw) - 1)], 0).astype(np.uint8)
    by_left, common_left = _order(key, left)
    by_right, common_right = _order(key, right)
    m = len(key)
    index = np.arange(m)
    repeat = np.zeros((m, deep + 2), bool)
    left_class, right_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for t in range(int(low.min()), deep + 1):
        here = np.flatnonzero((low <= t) & (t <= a))
        if len(here) < 2:
            continue
        left_class[by_left] = np.maximum.accumulate(np.where(common_left < t, index, 0))
        right_class[by_right] = np.maximum.accumulate(np.where(common_right < length - t, index, 0))
        pair = left_class[here] * m + right_class[here]
        o = np.argsort(pair, kind="stable")
        later = np.zeros(len(here), bool)
        later[1:] = pair[o][1:] == pair[o][:-1]
        repeat[here[o[later]], t] = True
    # runs of neighbouring offsets are one span
    edge = np.diff(repeat.astype(np.int8), axis=1, prepend=0)
    row, first = np.nonzero(edge == 1)
    _, past = np.nonzero(edge == -1)
    trigger = pos[row] + a[row]
    return rid[row], trigger - (past - 1), trigger - first + length


def _sorted_phrases(texts: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for table in by_group(batches, "key", GROUP_ROWS):
            table = table.combine_chunks()
            key, rid, pos, info = (table.column(c).to_numpy() for c in ("key", "rid", "pos", "info"))
            data = table.column("bytes").combine_chunks().cast(pa.large_binary())
            _, offsets, values = data.buffers()
            off = np.frombuffer(offsets, np.int64)[data.offset: data.offset + len(data) + 1]
            raw = np.frombuffer(values, np.uint8)
            r, s, e = repeated_windows(key, rid, pos, info, raw, off, length)
            if len(r):
                yield _batch([merge_spans(r, s, e)], _SPAN)
    rows = texts.repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, _sql(_SPAN))


def _single_windows(with_text: DataFrame, length: int, trigger: int) -> DataFrame:
    """The windows of hot triggers, each a phrase of its own."""
    def run(batches):
        for batch in small_batches(batches, "text", BATCH_BYTES):
            raw, off = utf8(batch.column("text"))
            row, _, pos, info = _marks(batch)
            n = info & ((1 << _SHIFT) - 1)
            row, inner = np.repeat(row, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            pos = np.repeat(pos, n) + inner
            for i in range(0, len(row), SLICE):
                part = slice(i, i + SLICE)
                start = off[row[part]] + pos[part]
                first, last = int(start.min()), int(start.max()) + length
                h = rolling(raw[first:last], trigger)
                d = _window_digest(h, start - first, length, trigger)
                one = np.ones(len(start), np.int64)
                yield _settled(batch.column("rid").to_numpy()[row[part]], pos[part], one, one,
                               mix(d), mix(d * _MULT[59] + h[start - first]), length)
    return with_text.mapInArrow(run, _sql(_PARSED))


def repeated_spans(rows: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, hot: int = HOT) -> DataFrame:
    """(rid, start, stop): byte spans of (rid, text) rows to remove; spans of
    one text may overlap."""
    found = staged(_meet(_parse(rows, length, trigger), length, hot), "phrases")
    spans = found.filter(F.col("kind") == SPAN).select(
        "rid", F.col("pos").alias("start"), (F.col("pos") - F.col("info")).alias("stop"))
    texts = _phrase_text(_with_text(rows, found, SUSPECT), length)
    spans = spans.unionByName(staged(_sorted_phrases(texts, length), "spans"))
    if found.filter(F.col("kind") == SUSPECT_HOT).limit(1).count():
        windows = _single_windows(_with_text(rows, found, SUSPECT_HOT), length, trigger)
        met = staged(_meet(windows, length, hot).filter(F.col("kind") == SPAN), "hot")
        spans = spans.unionByName(met.select("rid", F.col("pos").alias("start"), (F.col("pos") - F.col("info")).alias("stop")))
    return spans


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   trigger: int = TRIGGER, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) for every row."""
    rows = row_ids(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", ["text"])
    spans = (repeated_spans(rows, length, trigger, hot).groupBy("rid")
             .agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    kind = dict(rows.dtypes)["id"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            raw, off = utf8(batch.column("text"))
            lists = batch.column("spans")
            flat = lists.flatten()
            counts = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], np.int64)
            row, start, stop = merge_spans(np.repeat(np.arange(batch.num_rows), counts),
                                           flat.field("start").to_numpy(), flat.field("stop").to_numpy())
            keep = np.zeros(len(raw) + 1, np.int32)
            np.add.at(keep, off[row] + start, 1)
            np.add.at(keep, off[row] + stop, -1)
            keep = np.cumsum(keep[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(keep)])[off]
            n_bytes = np.diff(off)
            data = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [
                None, pa.py_buffer(left.astype(np.int32).tobytes()), pa.py_buffer(raw[keep].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_bytes), pa.array(n_bytes - np.diff(left)),
                 pa.array(np.bincount(row, minlength=batch.num_rows).astype(np.int64)), data],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = rows.join(spans, "rid", "left").select("id", "text", "spans").mapInArrow(
        run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("id", id_col)
