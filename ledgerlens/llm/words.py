"""Words and word n-grams of whole texts as 64-bit hashes, computed on the
UTF-8 bytes of a batch at once.

A word is a run of ASCII letters or digits, underscores and bytes above 127 in
the lower-cased text, so punctuation, blanks and letter case do not matter. A
run of more than ``LONGEST`` bytes counts as several words."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import utf8

SLICE = 1 << 19  # bytes hashed at once
LONGEST = 4096   # bytes of a word
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, LONGEST, np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = np.zeros(256, bool)
for _a, _b in (("a", "z"), ("A", "Z"), ("0", "9"), ("_", "_")):
    _WORD[ord(_a): ord(_b) + 1] = True
_WORD[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the rows' words, n + 1)."""
    raw, off = utf8(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    hashes, starts = [], []
    at = 0
    while at < len(raw):
        stop = min(at + SLICE, len(raw))
        part = raw[at:stop]
        inside = _WORD[part]
        first = inside & ~np.concatenate([[False], inside[:-1]])
        cuts = off[(off >= at) & (off < stop)] - at
        first[cuts[inside[cuts]]] = True
        heads = np.flatnonzero(first)
        if len(heads):
            pos = np.arange(len(part)) - heads[np.maximum(np.cumsum(first) - 1, 0)]
            pos &= LONGEST - 1
            where = np.flatnonzero(inside & (pos == 0))
            if stop < len(raw) and where[-1] > 0:
                # the last word may go on: the next slice starts with it
                stop = at + int(where[-1])
                where = where[:-1]
            end = stop - at
            value = np.where(inside[:end], _BYTE[part[:end]] * _PLACE[pos[:end]], np.uint64(0))
            if len(where):
                hashes.append(mix(np.add.reduceat(value, where)))
                starts.append(where + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    all_starts = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(all_starts, off, "left").astype(np.int64)


def grams(word: np.ndarray, off: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams inside each row and the rows' offsets. With
    ``short``, a row of 1 to n - 1 words gives one gram of all its words."""
    size = np.diff(off)
    count = np.maximum(size - n + 1, 0)
    if len(word) >= n:
        h = np.zeros(len(word) - n + 1, np.uint64)
        for i in range(n):
            h += word[i: len(word) - n + 1 + i] * _GRAM[i]
        ok = np.arange(len(h)) + n <= np.repeat(off[1:], size)[: len(h)]
        h = mix(h[ok])
    else:
        h = np.zeros(0, np.uint64)
    if not short or not ((size > 0) & (count == 0)).any():
        return h, np.concatenate([[0], np.cumsum(count)])
    few = np.flatnonzero((size > 0) & (count == 0))
    extra = mix(np.array([np.append(word[off[i]: off[i + 1]] * _GRAM[:size[i]], _GRAM[size[i] + 32])
                          .sum(dtype=np.uint64) for i in few], np.uint64))
    before = np.concatenate([[0], np.cumsum(count)])
    h = np.insert(h, before[few], extra)
    count[few] = 1
    return h, np.concatenate([[0], np.cumsum(count)])


def skip_pairs(word: np.ndarray, off: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first) of the words ``step`` apart inside each row;
    hashed as the 2-gram of these words."""
    at = np.arange(max(len(word) - step, 0))
    at = at[at + step < np.repeat(off[1:], np.diff(off))[: len(at)]]
    return mix(word[at] * _GRAM[0] + word[at + step] * _GRAM[1]), at
