"""Token counts with the whole-token shortcut.

A byte-level BPE library splits a text into pre-tokens and merges the bytes of
each. Offline, once per worker, every vocabulary string is encoded alone; the
strings that give exactly one token are proven whole. A pre-token found there
counts 1 without merging; only the other distinct pre-tokens of a batch are
merged, each once, by the library.

Strings of added special tokens inside a text count one token each, as the
library's default does. Characters on which the two regular expression engines' Unicode
tables may differ (``AGREED`` matches them) send the text to the library's own
pre-tokenizer.

Edge cases: null text counts as empty (0 bytes, 0 tokens); repeated rows are
counted each; other columns are ignored; null ids stay null; an empty table
gives an empty result; long texts are cut where no pre-token can cross."""
from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe_codec import CHUNK, pieces
from .common import local_file, small_batches, strings, utf8

BATCH_BYTES = 8 << 20
MERGE_AT_ONCE = 8192      # pre-tokens handed to the library at once
CACHE_ENTRIES = 400_000   # merged counts kept per worker

# Matches a character outside the ranges in which the pre-token classes of both engines were compared one
# by one (tests/llm/test_tokens.py): up to Cyrillic Supplement, general
# punctuation, kana and the basic CJK block.
AGREED = r"[^\x00-\u052f\u2000-\u206f\u3040-\u30ff\u4e00-\u9fa5]"
_ODD = regex.compile(AGREED)


def byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that byte-level vocabularies use."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    others = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + i) for i, b in enumerate(others)}


class Counter:
    """Counts the tokens of texts for one tokenizer file."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.find = regex.compile(pattern).findall
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.whole = self._prove(spec["model"]["vocab"], set(special))
        self.merged: dict[str, int] = {}

    def _prove(self, vocab: dict, special: set) -> dict[str, int]:
        """Vocabulary strings that are one pre-token and one token alone."""
        back = {c: b for b, c in byte_alphabet().items()}
        found: dict[str, int] = {}
        texts = []
        for name in vocab:
            if name in special:
                continue
            try:
                texts.append(bytes(back[c] for c in name).decode("utf-8"))
            except (KeyError, UnicodeDecodeError):
                continue
        for i in range(0, len(texts), MERGE_AT_ONCE):
            part = texts[i: i + MERGE_AT_ONCE]
            for text, enc in zip(part, self.library.encode_batch(part, add_special_tokens=False)):
                if len(enc) == 1 and self.find(text) == [text]:
                    found[text] = 1
        return found

    def pre_tokens(self, text: str) -> list[str]:
        if _ODD.search(text) is None:
            out: list[str] = []
            for part, single in pieces(text, CHUNK):
                out += [part] if single else self.find(part)
            return out
        spans = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in spans]

    def counts(self, texts: list[str]) -> list[int]:
        split, base = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            if self.special is not None and (n := len(self.special.findall(text))):
                base[i], parts = n, self.special.split(text)
            split.append([t for p in parts for t in self.pre_tokens(p)])
        whole, merged = self.whole, self.merged
        if len(merged) > CACHE_ENTRIES:
            merged.clear()
        rest = list({t for ts in split for t in ts if t not in whole and t not in merged})
        for i in range(0, len(rest), MERGE_AT_ONCE):
            part = rest[i: i + MERGE_AT_ONCE]
            for t, enc in zip(part, self.library.encode_batch(part, add_special_tokens=False)):
                merged[t] = len(enc)
        return [int(b) + sum([1 if t in whole else merged[t] for t in ts]) for b, ts in zip(base, split)]


@functools.lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def count_tokens(df: DataFrame, tokenizer_file: str, pattern: str, limit: int = 512,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; no shuffle."""
    path = local_file(df.sparkSession, tokenizer_file)

    def run(batches):
        c = counter(path, pattern)
        for batch in small_batches(batches, text_col, BATCH_BYTES):
            _, off = utf8(batch.column(text_col))
            n = np.asarray(c.counts(strings(batch.column(text_col))), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)],
                [id_col, "n_bytes", "n_tokens", "over_limit"])

    src = df.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {dict(src.dtypes)[id_col]}, n_bytes bigint, n_tokens bigint, over_limit boolean")
