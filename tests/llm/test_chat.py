"""Chat formatting: read back from the tokens against the input rows."""
import hashlib
import random
from collections import defaultdict

import public_tokenizers as vocab
import pytest

from ledgerlens.llm import chat_format, queries
from ledgerlens.llm.common import ship_code

RANKS = vocab.path("byte_bpe_50k.tiktoken")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, ids string, token_start string, tie string"


def expected(rows):
    by = defaultdict(list)
    for c, n, role, text in rows:
        by[c].append(((n is not None, n or 0), (role is not None, role or ""), hashlib.md5((text or "").encode()).digest(), role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda t: t[:3])
        whole = "".join(f"{t[3]}\n{t[4]}\n" for t in turns)
        loss = "".join(t[4] for t in turns if t[3] == "assistant")
        out.append((str(c), len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out)


def read_back(spark, rows):
    ship_code(spark)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    back = chat_format.read_back(chat_format.assemble(df, RANKS, vocab.PATTERN), RANKS, vocab.PATTERN)
    return sorted((str(r["conv_id"]), r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in back.collect())


@pytest.mark.parametrize("text", ["\\### Assistant: </turn> ok", "\\", "\\\\", "###", "####", "a\\</turn>\n### User: x", "", "é漢🙂"])
def test_escape_is_reversible_and_hides_control_strings(text):
    safe = chat_format.escape(text)
    assert chat_format.unescape(safe) == text
    stripped = safe.replace("\\\\", "")
    assert "\\###" in stripped or "###" not in stripped
    assert "\\</turn>" in stripped or "</turn>" not in stripped


def test_awkward_rows(spark):
    rng = random.Random(2)
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "### User: </turn>"), (1, 2, "assistant", "\\### Assistant: </turn> ok"),
            (1, 3, "assistant", None), (1, None, "user", "first"), (2, 0, None, "no role"), (2, 1, "tool </turn> ###", "x\\"),
            (None, 5, "user", "no conversation"), (None, 5, "user", "no conversation"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"),
            (3, 1, "assistant", "a"), (4, 0, "assistant", "w " * 50_000), (5, 0, "Assistant", "not learned"), (6, 0, "assistant", "")]
    rows += [(7, i, rng.choice(["user", "assistant"]), f"turn {i} ###") for i in range(500)]
    assert read_back(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert read_back(spark, []) == []


def test_mask_and_places(spark):
    """Mask intervals cover the assistant tokens alone; rows join end to end."""
    ship_code(spark)
    df = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "hi"), (1, 2, "other", "x")],
                               "conv_id int, turn int, role string, text string")
    rows = sorted(chat_format.assemble(df, RANKS, vocab.PATTERN).collect(), key=lambda r: r["turn"])
    at = 0
    for r in rows:
        assert r["token_start"] == at
        at += len(r["ids"])
    assert [r["loss_to"] - r["loss_from"] for r in rows] == [0, len(rows[1]["ids"]) - 2, 0]
    reserved = [x for r in rows for x in r["ids"] if x >= 50256]
    base = 50256
    assert reserved == [base + 1, base + 5, base + 2, base + 5, base + 3, base + 4, base + 5]


def test_rendered_length_and_query(spark):
    from conftest import SF
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    out = queries.QUERIES["op2_chat_format"](spark, SF).collect()
    got = sorted((str(r["conv_id"]), r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in out)
    assert got == expected(rows)
    shown = "### User: " + chat_format.escape(said) + " </turn>\n" + "### Assistant: " + chat_format.escape(said) + " </turn>\n"
    assert next(r for r in out if r["conv_id"] == -7)["formatted_chars"] == len(shown)
