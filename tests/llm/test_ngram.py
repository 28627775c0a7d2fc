"""N-gram Jaccard join against all pairs; components; word hashing."""
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import common, ngram_join, queries
from ledgerlens.llm import words as W
from ledgerlens.llm.common import ship_code
from ledgerlens.llm.components import components
from llm.conftest import words


def gram_set(text, n=5):
    w = re.findall(rb"[a-z0-9_\x80-\xff]+", (text or "").lower().encode())
    return frozenset(tuple(w[i: i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(texts, threshold=0.8):
    """(n_links, component position, class position) of every text."""
    sets = [gram_set(t) for t in texts]
    n = len(texts)
    links, comp = Counter(), list(range(n))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    cls = [min([i] + [j for j in range(n) if sets[j] == sets[i] and sets[i]]) for i in range(n)]
    return [(links[i], root(i), cls[i]) for i in range(n)]


def run(spark, texts, **kw):
    ship_code(spark)
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, rid string, size int").repartition(3)
    rows = sorted(ngram_join.near_duplicates(df, **kw).collect(), key=lambda r: r["doc_id"])
    assert all(r["kept"] == (r["component_rid"] == r["doc_id"]) for r in rows)
    return [(r["n_links"], r["component_rid"], r["class_rid"]) for r in rows]


@pytest.fixture(scope="module")
def crowd():
    """Copies, edited copies of one text and of others, chains, unrelated."""
    rng = random.Random(1)
    texts = [None, "", "...", "one two", "One, two!", "one two three"]
    base = words(rng, 150).split()
    for _ in range(120):
        copy = base[:]
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = "edit" + str(rng.random())[2:6]
        texts.append(" ".join(copy))
    chain = words(rng, 200).split()
    for i in range(12):
        texts.append(" ".join(chain[i * 8: i * 8 + 100]))
    texts += [words(rng, rng.randint(1, 60)) for _ in range(60)]
    texts += [texts[10]] * 20 + [texts[10].upper()]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block_rows,block_chars", [(512, 1 << 24), (16, 1 << 24), (512, 4000)])
def test_all_links_and_groups(spark, crowd, block_rows, block_chars):
    assert run(spark, crowd, block_rows=block_rows, block_chars=block_chars) == brute(crowd)


def test_a_long_chain_is_compared_by_bucket(spark, monkeypatch):
    """A group held together by neighbours alone: its buckets are small."""
    rng = random.Random(9)
    chain = words(rng, 2000).split()
    texts = [" ".join(chain[i * 4: i * 4 + 90]) for i in range(300)] + [words(rng, 30) for _ in range(20)]
    rng.shuffle(texts)
    units = []
    plan = ngram_join._units

    def watch(*args):
        units.append(plan(*args))
        return units[-1]

    monkeypatch.setattr(ngram_join, "_units", watch)
    assert run(spark, texts, block_rows=32, recall=0.99999) == brute(texts)
    seen = units[0].groupBy("band").count().collect()
    assert max(r["band"] for r in seen) > 0


def test_shuffled_join_path(spark, crowd, monkeypatch):
    monkeypatch.setattr(common.drop_or_keep, "__defaults__", (0,))
    assert run(spark, crowd[:80]) == brute(crowd[:80])


def test_awkward_rows(spark, awkward, awkward_docs):
    ship_code(spark)
    order = sorted(awkward, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    rows = sorted(ngram_join.near_duplicates(awkward_docs).collect(), key=lambda r: r["rid"])
    place = {r["rid"]: i for i, r in enumerate(rows)}
    got = [(r["n_links"], place[r["component_rid"]], place[r["class_rid"]]) for r in rows]
    assert [r["doc_id"] for r in rows] == [o[0] for o in order]
    assert got == brute([o[1] for o in order])


def test_empty_table(spark, no_docs):
    ship_code(spark)
    assert ngram_join.near_duplicates(no_docs).collect() == []


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.9995), (0.5, 0.9), (0.95, 0.999)):
        bands, rows = ngram_join.choose_bands(t, recall)
        assert bands * rows <= ngram_join.MAX_HASHES and 1 - (1 - t ** rows) ** bands >= recall
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.05, 0.999999)


def test_word_slices_do_not_matter(monkeypatch):
    rng = random.Random(9)
    texts = pa.array([words(rng, 50), None, "", "ab" * 300, "é" * 70 + " x", "a\nb\tc", "end"])
    monkeypatch.setattr(W, "LONGEST", 64)
    whole = W.words(texts)
    for size in (65, 100, 333):
        monkeypatch.setattr(W, "SLICE", size)
        part = W.words(texts)
        assert (part[0] == whole[0]).all() and (part[1] == whole[1]).all()
    again = W.words(pa.array(["end"]))
    assert again[0][0] == whole[0][-1]


def test_short_grams():
    word, off = W.words(pa.array(["a b c", "a b", "", "a b c d", "x a b"]))
    h, goff = W.grams(word, off, 3, short=True)
    assert list(np.diff(goff)) == [1, 1, 0, 2, 1] and len(set(h.tolist())) == 4
    h, goff = W.grams(word, off, 3, short=False)
    assert list(np.diff(goff)) == [1, 0, 0, 2, 1]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 200)] + [(7, 7), (900, 901), (901, 900), (900, 901)]
    edges += [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(160)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_query_on_documents(spark):
    from conftest import SF
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = sorted(queries.QUERIES["op9_ngram_jaccard"](spark, SF).collect(), key=lambda r: r["doc_id"])
    ids = [d for d, _ in docs]
    want = [(n, ids[c], ids[k]) for n, c, k in brute([t for _, t in docs])]
    assert [(r["n_links"], r["component_id"], r["class_id"]) for r in rows] == want
