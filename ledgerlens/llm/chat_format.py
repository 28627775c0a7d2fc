"""Chat formatting by token-level assembly.

Every turn is a header, its text and an end mark. Header and end mark are
reserved ids above the vocabulary, spliced between segments that are encoded
separately, so no text can produce one; control strings inside a text are also
escaped reversibly, so the rendered form can be parsed as well. A turn's place
in its conversation's token stream is the prefix sum of the segment lengths
before it, and the loss mask (assistant texts) is an interval of that stream.

The output has one row per turn: a conversation may be of any length and is
never gathered as one value. ``read_back`` walks the rows of a conversation in
stream order and keeps only running digests.

Edge cases: null text and null role count as empty strings; rows of a null
conv_id form one conversation; turns that tie are ordered by role, then text
(equal rows are interchangeable); roles outside ``ROLES`` are spelled out
between two reserved ids; other columns are ignored; an empty table gives an
empty result."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_codec import encode_text, encoding
from .common import local_file, small_batches, strings

ROLES = ("system", "user", "assistant")
LOSS_ROLE = "assistant"
HASH, END = "###", "</turn>"
_CONTROL = regex.compile(r"\\|###|</turn>")
_ESCAPED = regex.compile(r"\\(.)", regex.DOTALL)
BATCH_BYTES = 4 << 20

# rendered form of the reserved ids, in the order of the ids above the vocabulary
MARKS = [*(f"{HASH} {r.capitalize()}: " for r in ROLES), f"{HASH} Role ", f" {HASH}: ", f" {END}\n"]
OTHER, SAYS, STOP = len(ROLES), len(ROLES) + 1, len(ROLES) + 2


def escape(text: str) -> str:
    """A backslash before every backslash and control string."""
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def assemble(df: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """One row per turn of (conv_id, turn, role, text): ids array<int> (whole
    turn), token_start (its place in the conversation), loss_from / loss_to
    (half-open token interval under the loss mask, empty for other roles) and
    n_chars of the rendered turn."""
    path = local_file(df.sparkSession, rank_file)

    def run(batches):
        enc = encoding(path, pattern)
        base = enc.n_vocab
        for batch in small_batches(batches, "text", BATCH_BYTES):
            ids, head, body, chars = [], [], [], []
            for role, text in zip(strings(batch.column("role")), strings(batch.column("text"))):
                safe = escape(text)
                tokens = encode_text(enc, safe)
                if role in ROLES:
                    parts, n_head = [np.array([base + ROLES.index(role)], np.uint32)], 1
                    n = len(MARKS[ROLES.index(role)])
                else:
                    name = escape(role)
                    spelled = encode_text(enc, name)
                    parts = [np.array([base + OTHER], np.uint32), spelled, np.array([base + SAYS], np.uint32)]
                    n_head, n = 2 + len(spelled), len(MARKS[OTHER]) + len(name) + len(MARKS[SAYS])
                ids.append(np.concatenate([*parts, tokens, np.array([base + STOP], np.uint32)]))
                head.append(n_head)
                body.append(len(tokens) if role == LOSS_ROLE else 0)
                chars.append(n + len(safe) + len(MARKS[STOP]))
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(off, np.concatenate(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(batch.column("role")),
                 pa.array([hashlib.md5(t.encode()).digest() for t in strings(batch.column("text"))], pa.binary()),
                 flat, pa.array(head, pa.int64()), pa.array(body, pa.int64()), pa.array(chars, pa.int64())],
                ["conv_id", "turn", "role", "tie", "ids", "head", "body", "n_chars"])

    src = df.select("conv_id", "turn", "role", "text")
    kinds = dict(src.dtypes)
    turns = src.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, tie binary, "
                                "ids array<int>, head bigint, body bigint, n_chars bigint")
    before = (Window.partitionBy("conv_id").orderBy("turn", "role", "tie")
              .rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0))
    return (turns.withColumn("token_start", start)
            .withColumn("loss_from", F.col("token_start") + F.col("head"))
            .withColumn("loss_to", F.col("loss_from") + F.col("body"))
            .select("conv_id", "turn", "ids", "token_start", "loss_from", "loss_to", "n_chars"))


class _Reader:
    """Parses the token stream of one conversation, turn by turn."""

    def __init__(self, enc):
        self.enc, self.base = enc, enc.n_vocab
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.at = 0

    def _text(self, ids) -> str:
        return self.enc.decode_bytes(ids).decode("utf-8")

    def add(self, ids: list[int], start: int, loss_from: int, loss_to: int) -> None:
        if start != self.at or ids[-1] != self.base + STOP:
            raise ValueError("turn rows do not join into one token stream")
        self.at += len(ids)
        kind = ids[0] - self.base
        if kind == OTHER:
            says = ids.index(self.base + SAYS)
            name = self._text(ids[1:says])
            role, first = unescape(name), says + 1
            self.chars += len(MARKS[OTHER]) + len(name) + len(MARKS[SAYS])
        else:
            role, first = ROLES[kind], 1
            self.chars += len(MARKS[kind])
        shown = self._text(ids[first:-1])
        self.chars += len(shown) + len(MARKS[STOP])
        text = unescape(shown)
        self.n_turns += 1
        self.turns.update(f"{role}\n{text}\n".encode())
        if loss_to > loss_from:
            learned = unescape(self._text(ids[loss_from - start: loss_to - start]))
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())


def read_back(assembled: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per conversation, from the ids and mask alone: n_turns, turns_sha256
    (role, newline, text, newline per turn), loss_chars and loss_sha256 (text
    under the mask, unescaped), formatted_chars, n_tokens."""
    path = local_file(assembled.sparkSession, rank_file)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    def run(batches):
        enc = encoding(path, pattern)
        key, reader, done = None, None, []

        def close():
            done.append((key, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars,
                         reader.loss.hexdigest(), reader.chars, reader.at))

        schema = None
        for batch in batches:
            schema = schema or batch.schema.field("conv_id").type
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "ids", "token_start", "loss_from", "loss_to")]
            for conv, ids, start, lo, hi in zip(*cols):
                if reader is None or conv != key:
                    if reader is not None:
                        close()
                    key, reader = conv, _Reader(enc)
                reader.add(ids, start, lo, hi)
            if len(done) >= 4096:
                yield _rows(done, names, schema)
                done = []
        if reader is not None:
            close()
        if done:
            yield _rows(done, names, schema)

    kind = dict(assembled.dtypes)["conv_id"]
    rows = (assembled.select("conv_id", "ids", "token_start", "loss_from", "loss_to")
            .repartition("conv_id").sortWithinPartitions("conv_id", "token_start"))
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                "loss_sha256 string, formatted_chars bigint, n_tokens bigint")


def _rows(done: list[tuple], names: list[str], key_type) -> pa.RecordBatch:
    kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done), kinds)], names)
