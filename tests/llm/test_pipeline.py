"""The pipeline against a step-by-step computation, and awkward input."""
import hashlib
import re
from collections import defaultdict

import corpus_pipeline as P
import pytest

from llm.test_decontaminate import brute as leaks
from llm.test_decontaminate import split
from llm.test_ngram import brute as near


def test_stage_names_and_columns(spark):
    from conftest import SF
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == P.COLUMNS


def test_rows_of_the_whole_run(spark):
    from conftest import SF
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS).collect())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [d for d in docs if re.search(r"[^\W\d_]", d[1] or "")]
    pages, seen = defaultdict(int), defaultdict(int)
    for s, t in {(s, t) for _, t, _, s, _ in docs}:  # copies are one page
        pages[s] += 1
        for line in {x.strip(" \t\r") for x in t.split("\n")} - {""}:
            seen[s, line] += 1
    cleaned, dropped = [], 0
    for i, t, _, s, _ in docs:
        def common(x, s=s):
            n = seen[s, x.strip(" \t\r")] if x.strip(" \t\r") else 0
            return n >= 3 and n > 0.1 * pages[s]
        kept = [x for x in t.split("\n") if not common(x)]
        if not any(x.strip(" \t\r") for x in kept):
            kept = t.split("\n")
        dropped += len(t.split("\n")) - len(kept)
        cleaned.append((i, "\n".join(kept)))
    assert dropped > 0
    groups = near([t for _, t in cleaned])
    cleaned = [d for k, (d, g) in enumerate(zip(cleaned, groups)) if g[1] == k]
    likely = [(i, t) for i, t in cleaned if any(len(set(split(x)) & set(split(t))) >= 0.45 * len(set(split(x))) for _, x in items)]
    # full alignment is quadratic: leave the longest texts to the exact check below
    short = [(i, t) for i, t in likely if len(t) < 8000]
    bad = {d for d, _ in leaks(items, short)}
    bad |= {i for i, t in likely if len(t) >= 8000 and any(" ".join(x.split()) in " ".join(t.split()) for _, x in items)}
    want = sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in cleaned if i not in bad)
    got = sorted((r["doc_id"], r["decoded_sha256"]) for r in P.run(spark, SF).collect())
    assert got == want


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, None), (2, "two words"), (None, "a b c d e f")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_awkward_rows_and_empty_tables(spark, awkward, awkward_docs, no_docs, folder, name):
    stage = dict(P.STAGES)[name]
    out = stage(spark, awkward_docs, folder).collect()
    texts = {(r["doc_id"]) for r in out}
    if name == "language_id":
        assert texts == {i for i, t, *_ in awkward if any(c.isalpha() for c in t or "")}
    elif name == "ngram_jaccard":
        assert len(out) == len(awkward) - 4  # copies of 4, its near copy, and "Two, words!"
    elif name == "decontaminate":
        assert {i for i, *_ in awkward} - texts == {7, 8}
    else:
        assert len(out) == len(awkward)
    assert stage(spark, no_docs, folder).collect() == []


def test_one_document_of_a_copy_group_survives(spark, folder):
    """A third of a source is one text: it is no boilerplate, and one copy stays whole."""
    from llm.conftest import make_docs
    copy = "\n".join(f"line {k} of the copied page, about the {w}" for k, w in enumerate("harbour bridge garden market".split()))
    rows = [(i, f"Menu\npage {i} " + " ".join(f"w{i}x{k}" for k in range(12)), "en", "s", 1) for i in range(60)]
    rows += [(1000 + i, copy, "en", "s", 1) for i in range(30)]
    docs = P.drop_lines(spark, make_docs(spark, rows), folder)
    texts = {r["doc_id"]: r["text"] for r in P.near_duplicates(spark, docs, folder).collect()}
    assert set(texts) == {*range(60), 1000} and texts[1000] == copy
    assert not any("Menu" in t for t in texts.values())


def test_a_table_without_labels_keeps_its_documents(spark, awkward, folder):
    from llm.conftest import make_docs
    rows = [(i, t, None, s, n) for i, t, _, s, n in awkward]
    got = [r["text"] for r in P.language_id(spark, make_docs(spark, rows), folder).collect()]
    assert sorted(got) == sorted(t for _, t, *_ in awkward if any(c.isalpha() for c in t or ""))
