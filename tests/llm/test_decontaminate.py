"""Decontamination against full alignment of every pair."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import decontaminate as D
from ledgerlens.llm import queries
from ledgerlens.llm.common import ship_code
from ledgerlens.llm.words import words as hashed
from llm.conftest import make_docs, words


def split(text):
    return re.findall(rb"[a-z0-9_\x80-\xff]+", (text or "").lower().encode())


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if x == y else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
    return h.max()


def contains(item, text):
    return any(text[i: i + len(item)] == item for i in range(len(text) - len(item) + 1))


def brute(items, docs, threshold=D.THRESHOLD, n=D.N):
    out = {}
    for i, t in items:
        item = split(t)
        for d, text in docs:
            doc = split(text)
            if not item or len(set(item) & set(doc)) < threshold * len(set(item)) / 2:
                continue
            if len(item) < n:
                if contains(item, doc):
                    out[d, i] = 1.0
            elif (s := smith_waterman(item, doc) / len(item)) >= threshold - 1e-9:
                out[d, i] = round(s, 9)
    return out


def run(spark, items, docs, **kw):
    ship_code(spark)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, hits string")
    rows = D.find_copies(docs, bench, **kw).collect()
    return rows, {(r["doc_id"], h["item_id"]): round(h["score"], 9) for r in rows for h in r["hits"]}


def test_alignment_equals_the_recurrence():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        score, first, last = D.align(a.astype(np.uint64), b.astype(np.uint64))
        assert abs(score - smith_waterman(a, b)) < 1e-9
        if score > 0:
            # the span alone gives the same score
            assert 0 <= first <= last < len(b) and abs(smith_waterman(a, b[first: last + 1]) - score) < 1e-9


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(6)
    items = [(i, words(rng, rng.randint(12, 40))) for i in range(20)] + [(90, None), (91, ""), (92, "rare pair"), (93, words(rng, 5))]
    docs = []
    for k in range(120):
        body = words(rng, rng.randint(0, 80)).split()
        if k % 3 == 0:
            copy = rng.choice(items[:20])[1].split()
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(copy))
                copy[at: at + rng.choice([0, 1, 1])] = [words(rng, 1)] * rng.choice([0, 1, 1])
            at = rng.randint(0, len(body))
            body[at:at] = copy
        docs.append((k, " ".join(body)))
    docs.append((500, "a Rare, pair here"))
    docs.append((501, items[3][1] + " x " + items[3][1] + " " + items[4][1].upper()))
    docs += [(1000 + i, words(rng, 10) + " " + items[5][1]) for i in range(150)]
    return items, docs


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 100])
def test_planted_copies(spark, planted, block_words):
    items, docs = planted
    df = make_docs(spark, [(i, t, "en", "s", 1) for i, t in docs]).repartition(3)
    rows, got = run(spark, items, df, block_words=block_words)
    assert rows[0].asDict().keys() == {*df.columns}
    assert got == brute(items, docs)


def test_awkward_rows_and_empty_tables(spark, awkward, awkward_docs, no_docs):
    items = [(1, " ".join(awkward[3][1].split()[50:90])), (1, "two words"), (None, "漢字かな 🙂"), (3, None)]
    rows, _ = run(spark, items, awkward_docs)
    assert len(rows) == len(awkward)
    full = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in rows if r["doc_id"] is not None}
    assert full[4] == full[5] == full[6] == [1] and full[7] == full[8] == [1] and full[10] == [] and full[1] == []
    assert run(spark, items, no_docs)[0] == []
    assert all(r["hits"] == [] for r in run(spark, [], awkward_docs)[0])


def test_query_on_documents(spark):
    from conftest import SF
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = [(d, t) for d, t in docs if any(len(set(split(i)) & set(split(t))) >= 0.5 * len(set(split(i))) for _, i in items)]
    near = [(d, t) for d, t in near if len(t) < 6000]
    got = {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in queries.QUERIES["op10_decontaminate"](spark, SF).collect()}
    want = brute(items, near)
    assert want and {k: v for k, v in got.items() if k[0] in dict(near)} == want


def test_seeds_of_many_items(spark):
    """Each item's rarer half, against a scan of all grams for every item."""
    rng = np.random.default_rng(3)
    n = 500
    item = np.sort(rng.integers(0, 60, n))
    items = D.Items(list(range(61)), np.zeros(0), np.zeros(62, int), np.arange(n).astype(np.uint64), item[rng.permutation(n)], np.zeros(n, int))
    background = rng.integers(0, 40, n)
    got = set(D.choose_seeds(items, background, 5).gram.tolist())
    want = set()
    for i in range(61):
        own = np.flatnonzero(items.item == i)
        if len(own):
            want |= set(own[(background[own] <= np.median(background[own])) | (background[own] <= 5)].tolist())
    assert got == want


@pytest.mark.parametrize("size", [3, 4, 5, 6, 7, 9, 15, 38])
def test_copies_edited_down_to_the_threshold_have_seeds(size):
    """Random edits of an item, few different words: whatever full alignment
    puts at the threshold or above is found, and by pairs alone."""
    rng = random.Random(size)
    seen = missed_by_grams = 0
    vocab = [f"w{i}" for i in range(60)]
    for _ in range(150):
        item = [rng.choice(vocab) for _ in range(size)]
        copy = []
        rate = rng.random() * 0.8
        for w in item:
            copy += [w] if rng.random() > rate / 4 else [rng.choice(vocab)] * rng.randint(0, 1)
            copy += [rng.choice(vocab)] * (rng.random() < rate)
        doc = [rng.choice(vocab) for _ in range(30)] + copy + [rng.choice(vocab) for _ in range(30)]
        items = D.load_items([0], [" ".join(item)], D.N)
        word, off = hashed(pa.array(["", " ".join(doc), "w1"]))
        pairs = D.pair_seeds(items, D.N, D.THRESHOLD)
        score = smith_waterman(item, doc) / size
        none = items.seeds(np.zeros(len(items.gram), bool))
        got = D.hits_of(none, word, off, D.N, D.THRESHOLD, pairs)
        assert got[0] == got[2] == []
        if score >= D.THRESHOLD - 1e-9:
            seen += 1
            assert [(i, round(x, 9)) for i, x, _, _ in got[1]] == [(0, round(score, 9))]
            missed_by_grams += not D.hits_of(items, word, off, D.N, D.THRESHOLD)[1]
        else:
            assert got[1] == []
    assert seen > 20 and (missed_by_grams > 0 or size > 15)


def test_a_word_after_every_second_word(spark):
    rng = random.Random(8)
    item = words(rng, 40).split()
    copy = [w for i in range(0, 40, 2) for w in (item[i], item[i + 1], f"x{i}")]
    spread = [w for i, x in enumerate(item) for w in ([x, "y"] if i % 5 < 4 else [x])]
    docs = [(1, " ".join(copy)), (2, " ".join(spread)), (3, " ".join(sorted(item)))]
    df = make_docs(spark, [(i, t, "en", "s", 1) for i, t in docs])
    _, got = run(spark, [(7, " ".join(item))], df)
    assert got == brute([(7, " ".join(item))], docs) and (1, 7) in got and (2, 7) in got


def test_pairs_shared_by_many_items(monkeypatch):
    """Common pairs are left out and meetings are split by items: same hits."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 30))) for _ in range(40)]
    docs = [" ".join(rng.choice(vocab) for _ in range(30)) + " " + rng.choice(texts) for _ in range(30)]
    items = D.load_items(list(range(40)), texts, D.N)
    word, off = hashed(pa.array(docs))

    def hits():
        return D.hits_of(items, word, off, D.N, D.THRESHOLD, D.pair_seeds(items, D.N, D.THRESHOLD))
    monkeypatch.setattr(D, "COMMON_ITEMS", 10**9)
    whole = hits()
    monkeypatch.setattr(D, "COMMON_ITEMS", 2)
    monkeypatch.setattr(D, "PAIR_MEETINGS", 50)
    assert hits() == whole and any(whole)
    want = {(d, i) for d, doc in enumerate(docs) for i, t in enumerate(texts)
            if smith_waterman(t.split(), doc.split()) / len(t.split()) >= D.THRESHOLD - 1e-9}
    assert {(d, h[0]) for d, hs in enumerate(whole) for h in hs} == want
