"""One query per operator, each over its whole table with production
parameters, and DuckDB SQL where SQL can express the result."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as vocab
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_codec, chat_format, decontaminate, langid, line_dedup, ngram_join, pfp_dedup, pii, sharding, target_sampling,
               token_count, vector_codes, vector_graph)
from .common import read, staged, with_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
SHARDS = [1.0] * 40
LINE_RATIO = 0.1
LINE_MIN_REPEATS = 3


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


@register("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


@register("op2_chat_format")
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    ranks = vocab.path(RANKS)
    formatted = chat_format.assemble(turns.unionByName(extra), ranks, vocab.PATTERN)
    return chat_format.read_back(formatted, ranks, vocab.PATTERN)


@register("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encode, decode, and the digests of both."""
    out = bpe_codec.round_trip(docs, vocab.path(RANKS), vocab.PATTERN)
    return out.select(
        "doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"), vocab.path(TOKENIZER), vocab.PATTERN, TOKEN_LIMIT)


_LINE_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, pos, trim(line, ' ' || chr(9) || chr(13)) AS line, line AS raw
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), freq AS (
  SELECT source, line, count(DISTINCT doc_id) AS n FROM lines WHERE line <> '' GROUP BY ALL
), total AS (
  SELECT source, count(*) AS t FROM documents GROUP BY ALL
), bad AS (
  SELECT source, line FROM freq JOIN total USING (source) WHERE n >= {LINE_MIN_REPEATS} AND n > {LINE_RATIO} * t
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(b.line) AS n_dropped,
         coalesce(string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (b.line IS NULL), '') AS text
  FROM lines l LEFT JOIN bad b ON l.source = b.source AND l.line = b.line GROUP BY ALL
)
SELECT doc_id, n_lines, n_dropped, length(text) AS kept_chars, md5(text) AS kept_md5 FROM kept
"""


@register("op7_line_dedup", _LINE_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.drop_boilerplate(docs, F.col("source"), LINE_RATIO, LINE_MIN_REPEATS)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("bigint").alias("kept_chars"),
                      F.md5(F.col("text").cast("binary")).alias("kept_md5"))


@register("op8_rendezvous_shards")
def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), SHARDS)


@register("op9_ngram_jaccard")
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(read(spark, sf_dir, "documents"))
    found = with_ids(staged(found, "found"), "doc_id", {"class_rid": "class_id", "component_rid": "component_id"})
    return found.select("doc_id", "class_id", "n_links", "component_id", "kept")


@register("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_copies(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("hits"))


@register("op3_prefix_free_dedup")
def op3_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pfp_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op4_vector_graph")
def op4_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_graph.near_duplicates(read(spark, sf_dir, "embeddings"))
    found = with_ids(staged(found, "found"), "vec_id", {"component_rid": "component_id"})
    return found.select("vec_id", "n_links", "component_id", "kept", "audit_recall")


CODE_PARTS, CODE_ENTRIES, CODE_ROUNDS, CODE_SCALE = 8, 16, 6, 4096


def _codes_sql() -> str:
    """Lloyd rounds as a chain of tables: p parts, b codebooks, a assignments."""
    near = """a{r} AS MATERIALIZED (
  SELECT vec_id, label, part, v, arg_min(struct_pack(d := d, e := entry), d * 1000 + entry) AS best FROM (
    SELECT p.vec_id, p.label, p.part, p.v, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d
    FROM p JOIN b{r} b USING (part)) GROUP BY ALL
)"""
    step = """b{n} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (
    SELECT part, entry, list(m ORDER BY pos) AS v FROM (
      SELECT part, best.e AS entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m
      FROM (SELECT part, best, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{r}) GROUP BY ALL) GROUP BY ALL
  ) m USING (part, entry)
)"""
    chain = []
    for r in range(CODE_ROUNDS):
        chain += [near.format(r=r), step.format(r=r, n=r + 1)]
    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {CODE_SCALE})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, label, part, list_slice(v, (part * len(v) // {CODE_PARTS} + 1)::BIGINT, ((part + 1) * len(v) // {CODE_PARTS})::BIGINT) AS v
  FROM k, range({CODE_PARTS}) t(part)
), b0 AS MATERIALIZED (
  SELECT part, rank - 1 AS entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rank FROM p)
  WHERE rank <= {CODE_ENTRIES}
), {", ".join(chain)}, {near.format(r=CODE_ROUNDS)}, c AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.e::INTEGER), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM a{CODE_ROUNDS} GROUP BY ALL
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{CODE_ROUNDS}) AS codebooks_sha256
FROM c
"""


@register("op11_vector_codes", _codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(read(spark, sf_dir, "embeddings"), CODE_PARTS, CODE_ENTRIES, CODE_ROUNDS, CODE_SCALE)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


@register("op12_pii_spans")
def op12_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(read(spark, sf_dir, "documents"))


def pii_digests(docs: DataFrame) -> DataFrame:
    """Counts per kind and digests of the base spans, and all spans."""
    found = pii.find_personal_data(docs)
    base = F.filter("spans", lambda s: s["base"])

    def of_kind(kind: int):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")

    count = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *count, F.sha2(pii.span_text(base).cast("binary"), 256).alias("base_sha256"),
                        pii.span_text(F.col("spans")).alias("spans"))


@register("op13_target_sampling")
def op13_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_sampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
