"""Base spans against plain patterns; added spans on planted proposals."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import pii, queries
from ledgerlens.llm.common import read

from .conftest import make_docs, words

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    out = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def digests(text):
    spans = plain(text)
    names = list(PATTERNS)
    line = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    return tuple(sum(k == i for _, k, _ in spans) for i in range(4)) + (hashlib.sha256(line.encode()).hexdigest(),)


COLS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
TRICKY = [
    "a@b.c_d@e.f x@y a@b@c.d é.x@mail.de. @a.b a@-.-- a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.1 1.2.3 1.2.3.4.5 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 411111111111 1111 5500 0000 0000 0004 4111  1111 1111 1111", "0" * 12 + "-" + "0" * 8,
    "+1 (555) 010-9999 +49 30 1234567. +1 23 ++44 20 7946 0958) +1)) 123456789 +1234567890123456", "🙂🙂 x.1@mail.de 🙂 +1 555 010 9999",
    "7" * 20_000, "a" * 50_000, "1." * 20_000, "a." * 20_000 + "@", "+1" + "(" * 20_000 + "2", "x@y." * 5_000, "4111111111111111 " * 3_000,
    "٣٤٥٦٧٨٩٠١٢٣٤٥٦ 4111111111111111", "\n4111-1111\n1111-1111 10.0.0.1\t10.0.0.2",
]


def test_base_spans_of_awkward_texts(spark, awkward):
    rows = awkward + [(100 + i, t, "en", "s", 1) for i, t in enumerate(TRICKY)]
    got = sorted((tuple(r[c] for c in COLS) for r in queries.pii_digests(make_docs(spark, rows)).collect()))
    assert got == sorted(digests(r[1]) for r in rows)


def test_whole_query(spark):
    docs = {r["doc_id"]: r["text"] for r in read(spark, SF, "documents").select("doc_id", "text").collect()}
    got = queries.op12_pii_spans(spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", **dict.fromkeys(COLS[:4], "bigint"), "base_sha256": "string", "spans": "string"}
    rows = got.collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLS) for r in rows} == {i: digests(t) for i, t in docs.items()}
    names = list(PATTERNS)
    for r in rows:   # base spans stay, and clean documents are left alone
        spans = set(r["spans"].split(",")) - {""}
        assert {f"{names[k]}:{a}:{b}" for a, k, b in plain(docs[r["doc_id"]])} <= spans
        if not re.search("[0-9@]", docs[r["doc_id"]] or ""):
            assert not spans


def labelled_corpus():
    """Base spans in prose, digits that are none, and proposals to find."""
    rng = random.Random(8)

    def card(sep=" "):
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[i:i + 4] for i in range(0, 16, 4))

    def phone(lead="+"):
        return f"{lead}49 30 {rng.randint(100, 999)} {rng.randint(1000, 9999)}"

    def bad_card():
        d = card("").strip()
        return d[:-1] + str((int(d[-1]) + 1) % 10)
    texts, hidden = [], []
    for i in range(400):
        parts = [words(rng, 12), f"mail to {words(rng, 1)}.{i}@mail{i % 7}.example.org or", f"host {i % 250}.12.{i % 99}.7",
                 f"card {card()}", f"phone {phone()}", words(rng, 9)]
        texts.append("\n".join(rng.sample(parts, 3)))
        texts.append(words(rng, 8) + f" {bad_card()} " + words(rng, 5) + f" {rng.randint(300, 999)}.300.{i}.999 " + f"order {rng.randint(10**6, 10**9)}")
    for _ in range(20):
        for kind, lead, span in [(2, "card ", card("/")), (3, "phone ", phone("00")), (0, "mail to ", f"{words(rng, 1)} (at) mail3.example [dot] org"),
                                 (1, "host ", "10[.]12[.]14[.]7")]:
            before = words(rng, 6) + " " + lead
            hidden.append((before + span + " " + words(rng, 4), len(before), kind, len(before) + len(span)))
    return texts, hidden


def test_added_spans_and_clean_texts(spark):
    texts, hidden = labelled_corpus()
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts + [h[0] for h in hidden])]
    found = {r["doc_id"]: [(s["start"], s["kind"], s["stop"], s["base"]) for s in r["spans"]]
             for r in pii.find_personal_data(make_docs(spark, rows)).collect()}
    for i, t in enumerate(texts):   # only base spans: the rest of these texts is clean
        assert [s[:3] for s in found[i]] == plain(t)
    caught = [0] * 4
    for i, (t, a, k, b) in enumerate(hidden, len(texts)):
        assert [s for s in found[i] if s[3]] == [s + (True,) for s in plain(t)]
        caught[k] += any(s[0] <= a and s[2] >= b and s[1] == k for s in found[i])
    assert min(caught) >= 18, caught


def test_training_sees_every_candidate(spark, monkeypatch):
    """Counts, weights and thresholds come from all labelled candidates, far
    beyond the number that a kind and label weighs in the trees."""
    n = 12_000
    rows = spark.range(n).select(F.col("id").alias("rid"), F.lit(0).alias("start"), (F.col("id") % 4).cast("int").alias("kind"),
                                 (F.col("id") % 3 > 0).cast("double").alias("label"),
                                 *[((F.col("id") % 3 > 0).cast("double") * 2 + F.col("id") % 2).alias(c) for c in pii.FEATURES])
    counts = pii._distinct(rows)
    assert counts.agg(F.sum("n")).first()[0] == n and counts.count() <= 2 * 4 * 2
    seen = []

    class Trees(pii.GBTClassifier):
        def _fit(self, learn):
            seen.append(learn.groupBy("label").agg(F.sum("weight").alias("w")).collect())
            return super()._fit(learn)
    monkeypatch.setattr(pii, "GBTClassifier", Trees)
    _, thresholds = pii.train(rows, balance=n)
    learned = sum(r["n"] for r in counts.filter("not held").collect())
    assert sum(r["w"] for r in seen[0]) == pytest.approx(learned) and learned > 0.7 * n
    assert set(thresholds) == {0, 1, 2, 3}
    pii.train(rows, balance=100)   # weighed down, not drawn: 8 kinds and labels, three quarters of 100 each
    assert sum(r["w"] for r in seen[1]) == pytest.approx(600, rel=0.05)


def test_no_labels_and_empty_table(spark, no_docs):
    assert pii.find_personal_data(no_docs).collect() == []
    one = make_docs(spark, [(1, "write a.b@mail.de (555) 010 9999", None, None, None)])
    assert [len(r["spans"]) for r in pii.find_personal_data(one).collect()] == [1]


def test_overlapping_proposals_keep_the_best(spark):
    spans = spark.createDataFrame(
        [(1, 0, 0, 10, True, None), (1, 2, 8, 20, False, 0.9), (1, 3, 12, 30, False, 0.8), (1, 2, 25, 40, False, 0.95),
         (1, 1, 50, 60, False, 0.7), (2, 2, 8, 20, False, 0.9)], "rid int, kind int, start bigint, stop bigint, base boolean, score double")
    clear = pii._clear_of_base(spans)
    assert sorted((r["rid"], r["start"]) for r in clear.collect()) == [(1, 12), (1, 25), (1, 50), (2, 8)]
    assert sorted((r["rid"], r["start"]) for r in pii._best_of_overlaps(clear).collect()) == [(1, 25), (1, 50), (2, 8)]


def test_redact(spark):
    docs = make_docs(spark, [(1, "x a.b@mail.de, 10.0.0.1!", None, None, None), (2, None, None, None, None), (3, "+4111111111111111", None, None, None)])
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got == {1: "x [email], [ip]!", 2: "", 3: "+[card]"}
