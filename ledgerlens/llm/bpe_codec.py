"""Byte-level BPE encoding and decoding with the tiktoken library and a local
rank file.

Every whole text is encoded without special tokens. Texts over ``CHUNK``
characters are cut at boundaries where the split pattern always ends a match,
so the pieces encode exactly as the whole would and the library's matcher
never runs over an unbounded text.

Edge cases: a null text counts as empty (no tokens); the empty text gives an
empty id list; repeated rows are encoded each; columns other than the id and
the text are ignored, so their names cannot clash; an empty table gives an
empty result; null ids are kept as null ids."""
from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import local_file, small_batches, strings

CHUNK = 1 << 16          # characters handed to the library at once
BATCH_BYTES = 2 << 20    # text bytes held as Python objects at once

# A match never continues from a non-space character into white space, so the
# place before white space that follows a non-space character is a boundary
# whatever stands around it. White-space runs are looked at apart (see pieces).
_SPACE_RUN = regex.compile(r"\s{256,}")
_BOUNDARY = regex.compile(r"(?<=\S)(?=\s)")


def pieces(text: str, chunk: int = CHUNK) -> Iterator[tuple[str, bool]]:
    """Consecutive parts of ``text`` as (part, is_single_match); parts marked
    True are one match of the split pattern already (long white space)."""
    start = 0
    if len(text) > chunk:
        for run in _SPACE_RUN.finditer(text):
            # the pattern gives a run's last character to what follows it
            stop = run.end() if run.end() == len(text) else run.end() - 1
            yield from ((p, False) for p in _cut(text[start: run.start()], chunk))
            yield text[run.start(): stop], True
            start = stop
    elif (run := _SPACE_RUN.search(text)) is not None:
        yield from pieces_of_short(text)
        return
    yield from ((p, False) for p in _cut(text[start:], chunk))


def pieces_of_short(text: str) -> Iterator[tuple[str, bool]]:
    start = 0
    for run in _SPACE_RUN.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > start:
            yield text[start: run.start()], False
        yield text[run.start(): stop], True
        start = stop
    if start < len(text):
        yield text[start:], False


def _cut(text: str, chunk: int) -> Iterator[str]:
    start = 0
    while len(text) - start > chunk:
        m = _BOUNDARY.search(text, start + chunk)
        if m is None:
            break
        yield text[start: m.start()]
        start = m.start()
    if start < len(text):
        yield text[start:]


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The library's encoder for a rank file (cached per worker)."""
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name=path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(enc, text: str, chunk: int = CHUNK) -> np.ndarray:
    """Token ids of one whole text."""
    if len(text) <= chunk and _SPACE_RUN.search(text) is None:
        return enc.encode_to_numpy(text, disallowed_special=())
    parts = [np.asarray(enc._encode_single_piece(p), np.uint32) if single
             else enc.encode_to_numpy(p, disallowed_special=()) for p, single in pieces(text, chunk)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>) for every row; one narrow pass, no shuffle."""
    path = local_file(df.sparkSession, rank_file)

    def run(batches):
        enc = encoding(path, pattern)
        for batch in small_batches(batches, text_col, BATCH_BYTES):
            ids = [encode_text(enc, t) for t in strings(batch.column(text_col))]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.ListArray.from_arrays(offsets, values)], [id_col, "token_ids"])

    src = df.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {dict(src.dtypes)[id_col]}, token_ids array<int>")


def round_trip(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(id, token_ids, decoded binary): encoding, and the raw bytes that the
    ids alone decode to, in one pass through one worker a task."""
    path = local_file(df.sparkSession, rank_file)

    def run(batches):
        enc = encoding(path, pattern)
        for batch in small_batches(batches, text_col, BATCH_BYTES):
            offsets, ids, data = [0], [], []
            for text in strings(batch.column(text_col)):
                own = encode_text(enc, text)
                offsets.append(offsets[-1] + len(own))
                ids.append(own.astype(np.int32))
                data.append(enc.decode_bytes(own.tolist()))
            lists = pa.ListArray.from_arrays(np.array(offsets, np.int32), np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), lists, pa.array(data, pa.binary())],
                                             [id_col, "token_ids", "decoded"])

    src = df.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {dict(src.dtypes)[id_col]}, token_ids array<int>, decoded binary")


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "token_ids",
           out_col: str = "decoded") -> DataFrame:
    """All columns of ``df`` but ``ids_col`` plus ``out_col``: the raw bytes of
    the ids (not forced into valid UTF-8). Null ids give null."""
    path = local_file(df.sparkSession, rank_file)
    keep = [c for c in df.columns if c not in (ids_col, out_col)]

    def run(batches):
        table = encoding(path, pattern)
        for batch in batches:
            out = [None if ids is None else table.decode_bytes(ids)
                   for ids in (x.as_py() for x in batch.column(ids_col))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(out, pa.binary())], [*keep, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    src = df.select(*keep, ids_col)
    return src.mapInArrow(run, f"{schema}{', ' if keep else ''}`{out_col}` binary")
