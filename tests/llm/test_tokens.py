"""Byte-level BPE and token counts against the libraries themselves."""
import base64
import hashlib
import sys

import public_tokenizers as vocab
import pytest
import tiktoken
from tokenizers import Tokenizer

from ledgerlens.llm import bpe_codec, queries, token_count
from ledgerlens.llm.common import ship_code

RANKS, JSON = vocab.path("byte_bpe_50k.tiktoken"), vocab.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def enc():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_round_trip_and_library_ids(spark, enc, awkward, awkward_docs):
    ship_code(spark)
    encoded = bpe_codec.encode(awkward_docs, RANKS, vocab.PATTERN)
    got = sorted((r["doc_id"] or -1, list(r["token_ids"])) for r in encoded.collect())
    want = sorted((i or -1, enc.encode_ordinary(t or "")) for i, t, *_ in awkward)
    assert got == want
    decoded = bpe_codec.decode(encoded, RANKS, vocab.PATTERN)
    assert sorted(bytes(r["decoded"]) for r in decoded.collect()) == sorted((t or "").encode() for _, t, *_ in awkward)


def test_digests(spark, enc, awkward, awkward_docs):
    got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.bpe_digests(awkward_docs).collect())
    ids = [(enc.encode_ordinary(t or ""), (t or "").encode()) for _, t, *_ in awkward]
    assert got == sorted((len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(),
                          hashlib.sha256(b).hexdigest()) for i, b in ids)


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_safe_boundaries(enc, chunk):
    text = "  two  spaces\n\n it's 12 ab12 " + "x" * 50 + " \t " * 40 + "é漢字 end " + " " * 700 + "tail" + "\n" * 600
    want = enc.encode_ordinary(text)
    assert list(bpe_codec.encode_text(enc, text, chunk)) == want
    assert "".join(p for p, _ in bpe_codec.pieces(text, chunk)) == text


def test_white_space_the_library_cannot_match_at_once(enc):
    """A run of a million blanks overflows the matcher's stack."""
    text = "a" + " " * 1_000_000 + "b"
    ids = bpe_codec.encode_text(enc, text)
    assert enc.decode_bytes(list(ids)) == text.encode()
    small = "a" + " " * 300 + "b"
    assert list(bpe_codec.encode_text(enc, small)) == enc.encode_ordinary(small)


def test_empty_table(spark, no_docs):
    assert queries.bpe_digests(no_docs).collect() == []
    assert token_count.count_tokens(no_docs, JSON, vocab.PATTERN).collect() == []


def test_missing_file_fails_early(spark, no_docs):
    with pytest.raises(FileNotFoundError):
        bpe_codec.encode(no_docs, "/nowhere/ranks", vocab.PATTERN)


def test_counts_equal_the_library(spark, library, awkward, awkward_docs):
    out = token_count.count_tokens(awkward_docs, JSON, vocab.PATTERN, 512)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect())
    want = []
    for i, t, *_ in awkward:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i or -1, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)


def test_whole_tokens_are_proven(library):
    c = token_count.counter(JSON, vocab.PATTERN)
    some = sorted(c.whole)[:: 997]
    assert some and all(len(library.encode(t, add_special_tokens=False)) == 1 for t in some)


def test_agreed_characters_split_alike(library):
    """Every character that the fast path handles itself splits the same way
    in both engines."""
    c = token_count.counter(JSON, vocab.PATTERN)
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000 or token_count._ODD.search(chr(cp)) is not None:
            continue
        ch = chr(cp)
        text = f"x{ch}y 1{ch}2 .{ch}. {ch} z"
        spans = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert c.find(text) == spans, hex(cp)


def test_query_on_documents(spark, library, enc):
    from conftest import SF
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op6_token_counts"](spark, SF).collect():
        assert r["n_tokens"] == len(library.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
    for r in queries.QUERIES["op5_byte_bpe"](spark, SF).collect():
        ids = enc.encode_ordinary(docs[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
