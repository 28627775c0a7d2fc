"""Benchmark decontamination: rare n-gram seeds, then local alignment.

1. The word n-grams of the benchmark items are counted over all documents: in
   how many documents each occurs by chance, that is, apart from documents
   that hold a good part of the item. An n-gram is a seed of an item if it is
   rare (in at most ``rare_share`` of the documents) or among the rarer half
   of the item's own n-grams.
2. Word pairs are the seeds of heavily edited copies, which may hold no whole
   n-gram. An alignment with M matches and E edits leaves at least M - E - 1
   neighbouring pairs of the item whole, so a score at the threshold implies
   a least number of pairs (``least_pairs``; 7 of 37 for 38 words) close to
   one diagonal. A place with that many is a candidate. Pairs that many items
   share are left out as long as the least number leaves room for it; items
   too short for a whole pair also meet with one word between (at 0.6, up to
   5 words). At thresholds from 0.6 no copy is without a seed.
3. A document that holds a seed is aligned with the item around the seed's
   place by Smith-Waterman over words (match 1, mismatch and gap -0.5). The
   score is divided by the item's length; at ``threshold`` or more the
   document holds an exact, edited or paraphrased copy.

Documents stay where they are: the items travel to them, in blocks of at most
``BLOCK_WORDS`` words; a larger benchmark makes more blocks, each scanned in
turn, so what is broadcast is bounded.

Edge cases: null, empty and wordless documents and items match nothing; items
shorter than ``n`` words must occur word for word; an item that occurs several
times in a document gives its best place (the first of equals); repeated items
and documents give a hit each; result columns replace input columns of the
same name; empty tables give empty results."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .words import grams, skip_pairs, words

N = 3
THRESHOLD = 0.6
RARE_SHARE = 1e-4
RARE_LEAST = 20           # documents in which a rare n-gram may always occur
LEAK_SHARE = 0.2          # share of an item's n-grams that makes a likely copy
BLOCK_WORDS = 2_000_000
MISMATCH = GAP = 0.5
COMMON_ITEMS = 32         # places of the items a pair may have and always be a seed
PAIR_MEETINGS = 4_000_000  # meetings of pairs held at once
BATCH_BYTES = 1 << 20
HIT = "array<struct<item_id:bigint,score:double,first_word:int,last_word:int>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()),
                           ("first_word", pa.int32()), ("last_word", pa.int32())]))


@dataclass
class Items:
    """Items of one block: words, and (gram, item, place) sorted by gram."""
    ids: list
    word: np.ndarray
    off: np.ndarray
    gram: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def seeds(self, keep: np.ndarray) -> Items:
        return Items(self.ids, self.word, self.off, self.gram[keep], self.item[keep], self.place[keep])


@dataclass
class Pairs:
    """Word pairs of the items, (gram, item, place) sorted by gram: how many
    each item must meet (``need``, 0: none of its pairs is here) on begins at
    most ``drift`` apart; ``gap``: with one word between."""
    gram: np.ndarray
    item: np.ndarray
    place: np.ndarray
    need: np.ndarray
    drift: np.ndarray
    gap: bool

    def seeds(self, keep: np.ndarray) -> Pairs:
        return Pairs(self.gram[keep], self.item[keep], self.place[keep], self.need, self.drift, self.gap)


def load_items(ids: list, texts: list[str | None], n: int) -> Items:
    word, off = words(pa.array(texts, pa.large_string()))
    gram, goff = grams(word, off, n, short=True)
    item = np.repeat(np.arange(len(ids)), np.diff(goff))
    place = np.arange(len(gram)) - goff[item]
    order = np.lexsort((place, item, gram))
    return Items(ids, word, off, gram[order], item[order], place[order])


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of two word sequences: (score, first, last word
    of it in ``text``); the earliest end wins ties."""
    m = len(text)
    steps = GAP * np.arange(1, m + 1)
    above, origin = np.zeros(m + 1), np.arange(m + 1)
    best, span = 0.0, (0, 0)
    for w in item:
        diag = above[:-1] + np.where(text == w, 1.0, -MISMATCH)
        up = above[1:] - GAP
        cell = np.maximum(np.maximum(diag, up), 0.0)
        start = np.where(cell == 0, np.arange(1, m + 1), np.where(diag >= up, origin[:-1], origin[1:]))
        # a gap in the item: the best cell to the left, less GAP per step
        run = np.maximum.accumulate(cell + steps)
        from_left = run - steps > cell + 1e-12
        if from_left.any():
            source = np.maximum.accumulate(np.where(cell + steps >= run, np.arange(m), 0))
            start = np.where(from_left, start[source], start)
            cell = np.where(from_left, run - steps, cell)
        above = np.concatenate([[0.0], cell])
        origin = np.concatenate([[0], start])
        top = int(cell.argmax())
        if cell[top] > best + 1e-12:
            best, span = float(cell[top]), (int(start[top]), top)
    return best, span[0], span[1]


def _text_grams(word: np.ndarray, off: np.ndarray, items: Items, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, place in ``word``) of the n-grams of texts, and of the shorter
    grams that short items need."""
    short = {int(s) for s in np.diff(items.off) if 0 < s < n}
    for size in sorted(short | {n}):
        h, goff = grams(word, off, size, short=False)
        if size < n and len(h):  # hashed as an item of that many words
            h = _short_hash(word, off, size)
        row = np.repeat(np.arange(len(off) - 1), np.diff(goff))
        yield h, np.arange(len(h)) - goff[row] + off[row]


def _short_hash(word: np.ndarray, off: np.ndarray, size: int) -> np.ndarray:
    ends = np.concatenate([np.arange(a, max(a, b - size + 1)) for a, b in zip(off[:-1], off[1:])])
    parts = word[ends[:, None] + np.arange(size)].ravel()
    return grams(parts, np.arange(0, len(parts) + 1, size), size + 1, short=True)[0]


def _matches(items: Items, word, off, n) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``word``, index of a gram in ``items``) of all meetings."""
    at, hit = [], []
    uniq = np.unique(items.gram)
    for h, place in _text_grams(word, off, items, n):
        if not len(uniq) or not len(h):
            continue
        i = np.minimum(np.searchsorted(uniq, h), len(uniq) - 1)
        found = np.flatnonzero(uniq[i] == h)
        lo = np.searchsorted(items.gram, h[found], "left")
        hi = np.searchsorted(items.gram, h[found], "right")
        count = hi - lo
        at.append(np.repeat(place[found], count))
        first = np.repeat(np.cumsum(count) - count, count)
        hit.append(np.repeat(lo, count) + np.arange(int(count.sum())) - first)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(at), np.concatenate(hit)


def _background(docs: DataFrame, items: Items, n: int, text_col: str) -> np.ndarray:
    """For each (gram, item) of one bounded block, in how many documents the
    gram occurs by chance: documents that hold more than ``LEAK_SHARE`` of the
    item's grams are likely copies and don't count, so that a passage which
    leaked into many documents still looks rare."""
    own = np.bincount(items.item, minlength=len(items.ids))

    def run(batches):
        for batch in batches:
            total = np.zeros(len(items.gram), np.int64)
            for part in small_batches(iter([batch]), text_col, BATCH_BYTES):
                word, off = words(part.column(text_col))
                at, hit = _matches(items, word, off, n)
                row = np.searchsorted(off, at, "right") - 1
                pairs = np.unique(np.stack([row.astype(np.int64), items.item[hit], hit], 1), axis=0)
                _, which, held = np.unique(pairs[:, :2], axis=0, return_inverse=True, return_counts=True)
                chance = held[which.ravel()] <= np.maximum(1, LEAK_SHARE * own[pairs[:, 1]])
                total += np.bincount(pairs[chance, 2], minlength=len(total))
            some = np.flatnonzero(total)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["entry", "n"])

    counts = docs.select(text_col).mapInArrow(run, "entry bigint, n bigint")
    out = np.zeros(len(items.gram), np.int64)
    for r in counts.groupBy("entry").agg(F.sum("n").alias("n")).collect():
        out[r["entry"]] = r["n"]
    return out


def choose_seeds(items: Items, background: np.ndarray, limit: float) -> Items:
    """Grams in at most ``limit`` documents and each item's rarer half."""
    order = np.lexsort((background, items.item))
    ranked = background[order]
    edge = np.searchsorted(items.item[order], np.arange(len(items.ids) + 1))
    size = np.diff(edge)
    middle = np.zeros(len(size))
    some = size > 0
    low, high = (edge[:-1] + (size - 1) // 2)[some], (edge[:-1] + size // 2)[some]
    middle[some] = (ranked[low] + ranked[high]) / 2
    return items.seeds((background <= limit) | (background <= middle[items.item]))


def least_pairs(size: int, threshold: float) -> int:
    """How many neighbouring word pairs of an item of ``size`` words any copy
    at the threshold leaves whole: with E edits it has at least threshold *
    size + E / 2 matches, in at most E + 1 runs."""
    most = int((1 - threshold) * size / GAP + 1e-9)
    return min(int(np.ceil(threshold * size + GAP * e - 1e-9)) - e - 1 for e in range(most + 1))


def pair_seeds(items: Items, n: int, threshold: float) -> list[Pairs]:
    """The pairs of items of ``n`` words and more: as neighbours, and for the
    items that may keep none whole also with a word between."""
    size = np.diff(items.off)
    least = {int(m): least_pairs(int(m), threshold) for m in np.unique(size)}
    need = np.array([least[int(m)] if m >= n else 0 for m in size], np.int64)
    drift = ((1 - threshold) * size / GAP + 1e-9).astype(np.int64)
    gram, goff = grams(items.word, items.off, 2, short=False)
    item = np.repeat(np.arange(len(size)), np.diff(goff))
    place = np.arange(len(gram)) - goff[item]
    _, which, shared = np.unique(gram, return_inverse=True, return_counts=True)
    shared = shared[which]
    by_share = np.lexsort((-shared, item))
    rank = np.empty(len(gram), np.int64)
    rank[by_share] = place
    drop = (shared > COMMON_ITEMS) & (rank < need[item] - 1)
    loose = (need < 1) & (size >= n)
    need = np.where(size < n, 0, np.maximum(need - np.bincount(item[drop], minlength=len(size)), 1))
    order = np.lexsort((place, item, gram))
    near = Pairs(gram[order], item[order], place[order], need, drift, False)
    near = near.seeds(((need[item] > 0) & ~drop)[order])
    far = Pairs(near.gram, near.item, near.place, need, drift, True).seeds(loose[near.item])
    return [near, far] if len(far.gram) else [near]


def _pair_places(pairs: Pairs, word: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, item, begin) of the meetings of pairs that stand with enough
    others of their item on begins that a copy's edits can part."""
    h, place = skip_pairs(word, off, 2 if pairs.gap else 1)
    lo = np.searchsorted(pairs.gram, h, "left")
    count = np.searchsorted(pairs.gram, h, "right") - lo
    total = int(count.sum())
    if not total:
        return []
    low, high = int(pairs.item.min()), int(pairs.item.max())
    if total > PAIR_MEETINGS and low < high:
        first = pairs.item <= (low + high) // 2
        return _pair_places(pairs.seeds(first), word, off) + _pair_places(pairs.seeds(~first), word, off)
    at = np.repeat(place, count)
    hit = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(total)
    row = np.searchsorted(off, at, "right") - 1
    item, begin = pairs.item[hit], at - pairs.place[hit]
    order = np.lexsort((begin, item, row))
    row, item, begin = row[order], item[order], begin[order]
    k = np.arange(total)
    end = k + pairs.need[item] - 1
    full = end < total
    stop = np.minimum(end, total - 1)
    full &= (row[stop] == row) & (item[stop] == item) & (begin[stop] - begin <= pairs.drift[item])
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, k[full], 1)
    np.add.at(edge, stop[full] + 1, -1)
    live = np.cumsum(edge[:-1]) > 0
    return [(row[live], item[live], begin[live])]


def hits_of(items: Items, word: np.ndarray, off: np.ndarray, n: int, threshold: float,
            pairs: list[Pairs] | None = None) -> list[list[tuple]]:
    """For every text of a batch, the items it holds. ``pairs``: the seeds of
    copies without a whole seed n-gram."""
    out: list[list[tuple]] = [[] for _ in range(len(off) - 1)]
    at, hit = _matches(items, word, off, n)
    # (row, item, where the item would start)
    found = [(np.searchsorted(off, at, "right") - 1, items.item[hit], at - items.place[hit])] if len(at) else []
    for p in pairs or []:
        found += _pair_places(p, word, off)
    if not found:
        return out
    row, item, begin = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((begin, item, row))
    row, item, begin = row[order], item[order], begin[order]
    size = np.diff(items.off)[item]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > size[1:])
    heads = np.flatnonzero(new)
    best: dict[tuple[int, int], tuple] = {}
    for a, b in zip(heads, np.append(heads[1:], len(row))):
        r, i, m = int(row[a]), int(item[a]), int(size[a])
        own = items.word[items.off[i]: items.off[i + 1]]
        # with m matches at best, the threshold leaves room for this many gaps
        reach = int(np.ceil(m * (1 - threshold) / GAP)) + 1
        lo, hi = max(int(off[r]), int(begin[a]) - reach), min(int(off[r + 1]), int(begin[b - 1]) + m + reach)
        text = word[lo:hi]
        if np.isin(own, text).sum() < threshold * m - 1e-9:
            continue  # the score is at most the number of words found
        score, first, last = align(own, text)
        score /= m
        if score >= (threshold if m >= n else 1.0) - 1e-9 and ((r, i) not in best or score > best[r, i][0] + 1e-12):
            best[r, i] = (score, lo + first - int(off[r]), lo + last - int(off[r]))
    for (r, i), (score, first, last) in sorted(best.items()):
        out[r].append((items.ids[i], score, first, last))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[tuple[list, list]]:
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    size = F.size(F.split("text", r"\s+"))
    total = rows.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // block_words))
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).collect() if n > 1 else rows.collect()
        part.sort(key=lambda r: (r["id"] is not None, r["id"] or 0, r["text"] or ""))
        yield [r["id"] for r in part], [r["text"] for r in part]


def find_copies(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                item_text: str = "text", n: int = N, threshold: float = THRESHOLD, rare_share: float = RARE_SHARE,
                out: str = "hits", block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of ``docs`` plus ``out``: the benchmark items a document
    holds, with score and word span (an empty array for clean ones)."""
    keep = [c for c in docs.columns if c != out]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != out)
    total = docs.count()
    result = docs.select(*keep).withColumn(out, F.array().cast(HIT))
    for ids, texts in _blocks(benchmark, item_id, item_text, block_words):
        items = load_items(ids, texts, n)
        seeds = choose_seeds(items, _background(docs, items, n, text_col), max(RARE_LEAST, rare_share * total))
        shared = docs.sparkSession.sparkContext.broadcast((seeds, pair_seeds(items, n, threshold)))
        result = result.mapInArrow(_scan(shared, keep, text_col, out, n, threshold), f"{fields}, `{out}` {HIT}")
    return result


def _scan(shared, keep, text_col, out, n, threshold):
    def run(batches):
        for batch in small_batches(batches, text_col, BATCH_BYTES):
            word, off = words(batch.column(text_col))
            seeds, pairs = shared.value
            found = hits_of(seeds, word, off, n, threshold, pairs)
            before = batch.column(out).to_pylist()
            rows = [old + [dict(zip(("item_id", "score", "first_word", "last_word"), h)) for h in new]
                    for old, new in zip(before, found)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(rows, _HIT)], [*keep, out])
    return run
