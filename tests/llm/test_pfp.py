"""Prefix-free parsing against a table of all windows."""
import hashlib
import random

import numpy as np
import pytest

from ledgerlens.llm import pfp_dedup, queries
from ledgerlens.llm.common import ship_code


def brute(rows, length):
    """(id, bytes, removed, spans, digest) for rows of (id, text)."""
    out, seen = [], set()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for i, t in order:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            s = b[p: p + length]
            if s in seen:
                gone[p: p + length] = True
            seen.add(s)
        gone = gone[:-1]
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[:1].sum() if len(gone) else 0))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i if i is not None else -1, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(df, length=100, trigger=20, hot=pfp_dedup.HOT):
    got = pfp_dedup.remove_repeats(df, length=length, trigger=trigger, hot=hot).collect()
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_removed"], r["n_spans"],
                   hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got)


def small_rows(seed, alphabet, n=60):
    rng = random.Random(seed)
    stock = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(6)]
    return [(rng.randint(0, 400) * 1000 + k, "".join(rng.choice(stock) if rng.random() < 0.7 else rng.choice(alphabet)
                                                     for _ in range(rng.randint(0, 12)))) for k in range(n)]


@pytest.mark.parametrize("seed,alphabet,hot", [(1, "ab", 50_000), (2, "abcé", 50_000), (3, "ab", 2), (4, "a", 50_000), (5, "abcdefgh ", 1)])
def test_random_texts(spark, seed, alphabet, hot):
    ship_code(spark)
    rows = small_rows(seed, alphabet)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert run(df, length=12, trigger=4, hot=hot) == brute(rows, 12)


def test_awkward_rows(spark, awkward, awkward_docs):
    rows = [r[:2] for r in awkward if r[0] != 10]
    assert run(awkward_docs.filter("doc_id is null or doc_id <> 10")) == brute(rows, 100)


def test_empty_table(spark, no_docs):
    assert run(no_docs) == []


def test_slices_do_not_matter(monkeypatch):
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    off = np.array([0, 0, 1700, 1700, 4000, 5000])

    def windows():
        row, pos, n, a, key, fp = pfp_dedup.phrases(raw, off, 20, 6)
        found = set()
        for r, p, m, t, k in zip(row, pos, n, a, key):
            found |= {(int(r), int(p + i), int(t - i), int(k)) for i in range(m)}
        return found
    whole = windows()
    monkeypatch.setattr(pfp_dedup, "SLICE", 97)
    assert windows() == whole
    assert len(whole) == sum(max(0, b - a - 19) for a, b in zip(off[:-1], off[1:]))


def test_query_on_documents(spark):
    from conftest import SF
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
                 for r in queries.QUERIES["op3_prefix_free_dedup"](spark, SF).collect())
    assert got == brute(docs, 100)
