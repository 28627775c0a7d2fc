"""Language ID: held-out accuracy, codewords, awkward input."""
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import langid, queries
from ledgerlens.llm.common import ship_code
from llm.conftest import make_docs


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 30])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) == {-1.0, 1.0}
    assert all((np.abs(c) == 1).all() and abs(c.sum()) < n for c in code.T)
    gap = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
    assert gap >= (1 if n == 2 else 2)


def test_decoding_corrects_a_wrong_bit():
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.zeros((langid.DIMS, 7)), np.zeros(7), np.full(7, 1 / 7))
    for k in range(4):
        for bit in range(7):
            margin = 3 * code[k].copy()
            margin[bit] *= -1
            model.bias = margin
            best, score, _ = langid.decode(model, np.zeros((1, langid.DIMS)))
            assert best[0] == k and 0 <= score[0] <= 1
    model.bias = np.zeros(7)
    assert langid.decode(model, np.zeros((1, langid.DIMS)))[2][0]


def test_slices_do_not_matter(monkeypatch):
    texts = pa.array(["Ünder the bridge, 1 2 3!", None, "", "x" * 300, "lá vïe en rose " * 20])
    whole = langid.features(texts)
    for size in (64, 101):
        monkeypatch.setattr(langid, "SLICE", size)
        assert np.allclose(langid.features(texts), whole, atol=1e-6)


def plain_features(text):
    """n-gram counts of the folded bytes, one at a time."""
    folded = bytearray()
    for byte in (text or "").lower().encode():
        byte = byte if byte >= 128 or ord("a") <= byte <= ord("z") else 32
        if not (byte == 32 and folded and folded[-1] == 32):
            folded.append(byte)
    count = [0.0] * langid.DIMS
    for n in langid.ORDERS:
        for i in range(len(folded) - n + 1):
            value = int.from_bytes(folded[i: i + n], "big") + n
            count[(value * int(langid._MULT[n - 1]) % (1 << 64)) >> 51] += 1
    norm = sum(count) ** 0.5
    return [c ** 0.5 / norm if norm else 0.0 for c in count]


def plain_decode(model, x):
    """(language, score): least loss over the codewords, bit by bit."""
    margin = [sum(float(w) * v for w, v in zip(column, x)) + float(b) for column, b in zip(np.asarray(model.weights).T, model.bias)]
    loss = [sum(t * np.log1p(np.exp(-m * c)) for m, c, t in zip(margin, word, model.trust)) * len(margin) for word in model.code]
    low = min(loss)
    p = [np.exp(low - v) for v in loss]
    return model.langs[loss.index(low)], max(p) / sum(p)


def test_features_and_decoding_against_a_plain_version(spark, awkward_docs):
    texts = ["", None, "Über die   Brücke, 1 2 3!", "it's  we'll", "x", "漢字 かな", "the quick brown fox " * 30]
    want = np.array([plain_features(t) for t in texts])
    got = langid.features(pa.array(texts))
    assert np.allclose(got, want, atol=1e-5)
    rng = np.random.default_rng(4)
    langs = list("abcde")
    rows = [int(k) for k in rng.integers(0, 5, 60)]
    x = np.maximum(rng.normal(0, 0.02, (60, langid.DIMS)), 0).astype(np.float32)
    for i, k in enumerate(rows):
        x[i, 50 * k: 50 * k + 50] += 0.1
    model = langid.fit(x, [langs[k] for k in rows], steps=20)
    best, score, _ = langid.decode(model, x[:20])
    for i in range(20):
        lang, p = plain_decode(model, x[i].tolist())
        assert model.langs[best[i]] == lang and abs(score[i] - p) < 1e-6


def test_awkward_rows(spark, awkward, awkward_docs):
    ship_code(spark)
    model = langid.train(awkward_docs)
    out = langid.predict(awkward_docs, model)
    assert out.columns == [c for c in awkward_docs.columns if c != "score"] + ["lang_pred", "score", "ambiguous"]
    rows = out.collect()
    assert len(rows) == len(awkward)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert letters or r["score"] == 0
    assert {r["lang_pred"] for r in rows} <= {"en", "de", "fr", "und"}


def test_no_labels_one_label_and_empty(spark, no_docs):
    ship_code(spark)
    assert langid.train(no_docs) is None
    none = make_docs(spark, [(1, "some text", None, "s", 1)])
    assert [r["lang_pred"] for r in langid.predict(none, langid.train(none)).collect()] == ["und"]
    one = make_docs(spark, [(1, "some text", "xx", "s", 1), (2, "other", None, "s", 1)])
    assert [(r["lang_pred"], r["score"]) for r in langid.predict(one, langid.train(one)).collect()] == [("xx", 1.0)] * 2
    assert langid.predict(no_docs, None).collect() == []


def test_two_and_many_languages(spark):
    ship_code(spark)
    rows = []
    for k, stem in enumerate(["ka", "lo", "mi", "nu", "pe", "ri", "so"]):
        rows += [(100 * k + i, " ".join(f"{stem}{c}{stem}" for c in "bdfg"[: 1 + i % 4]), f"l{k}", "s", 1) for i in range(30)]
    for langs in (2, 7):
        part = make_docs(spark, [r for r in rows if int(r[2][1]) < langs])
        got = langid.predict(part, langid.train(part, per_lang=20)).collect()
        assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97


def test_held_out_accuracy(spark):
    from conftest import SF
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_language_id"](spark, SF).collect()
    assert len(rows) == len(labels)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([labels[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95


def test_the_label_of_a_held_out_row_is_never_read(spark):
    ship_code(spark)
    docs = [(i, f"wort {i} und noch {i}", "de", "s", 1) for i in range(40)]
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 3 == 1]
    wrong = [(*d[:2], "zz", *d[3:]) if d in held else d for d in docs]
    df = make_docs(spark, wrong)
    model = langid.train(df.filter(~langid.held_out()))
    assert model.langs == ["de"]
