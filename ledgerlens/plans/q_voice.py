"""Transcript text operators (P1–P9, G15, I5) over every text of the given
tables: conversation turns, documents, and a spoken memo per payment."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import textmine as TM
from ..operators.aggregates import top_k
from ..sources.adapters import txn
from ..sources.tables import table
from . import sqlx as S
from .common import finish, rounded
from .oracle_base import TXN, with_
from .registry import register

KEYS = ["conv_id", "turn"]
_LOW = "lower(text)"


# what a user says about a payment, by payment id; {a} amount, {m} merchant
MEMOS = ["I spent {a} rupees on food at {m} today",
         "Paid {a} rupees for the bills yesterday, I am worried it is getting expensive",
         "Happy and excited: a great deal in Mumbai, worth it, my target is met",
         "Bought a phone for {a} rupees, what a waste, I regret this mistake",
         "Aaj ka kharcha {a} hai, bachat kam",
         "My plan : save {a} thousand for the future goal, not sure, a bit anxious",
         "It cost {a} rupees in Delhi last week, or ₹ {a}, terrible and always again",
         "Definitely investing 2 lakh with {m} in march, confident and satisfied"]


def _memo_parts(template):
    out = []
    for i, part in enumerate(template.replace("{m}", "{a}\0").split("{a}")):
        if i:
            out.append("m" if part.startswith("\0") else "a")
            part = part.removeprefix("\0")
        if part:
            out.append(S.q(part))
    return out


_MEMO_SQL = " ".join(f"WHEN {i} THEN concat({', '.join(_memo_parts(t))})" for i, t in enumerate(MEMOS))
TEXTS = f"""memos AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT 1000000000 + doc_id, 0, 'document', coalesce(text, '') FROM documents
  UNION ALL SELECT 2000000000 + CAST(user_id AS BIGINT), CAST(transaction_id AS BIGINT), 'memo',
    CASE CAST(transaction_id AS BIGINT) % {len(MEMOS)} {_MEMO_SQL} END
  FROM (SELECT user_id, transaction_id, CAST(CAST(floor(abs(coalesce(amount, 0))) AS BIGINT) AS VARCHAR) AS a,
          coalesce(merchant_name, 'a shop') AS m FROM txn))"""


def _sql(text):
    """The oracle text over all texts."""
    return f"{with_(TXN, TEXTS)} SELECT * FROM ({text.replace('FROM conversations', 'FROM memos')}) AS over_texts"


def _texts(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    docs = table(spark, sf, "documents").select(
        (F.lit(1_000_000_000) + F.col("doc_id")).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"),
        F.lit("document").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = F.expr("CASE CAST(transaction_id AS BIGINT) % " + f"{len(MEMOS)} {_MEMO_SQL} END")
    memos = txn(spark, sf).select(
        "user_id", "transaction_id", F.floor(F.abs(F.coalesce("amount", F.lit(0.0)))).cast("bigint").cast("string").alias("a"),
        F.coalesce("merchant_name", F.lit("a shop")).alias("m")).select(
        (F.lit(2_000_000_000) + F.col("user_id").cast("bigint")).alias("conv_id"),
        F.col("transaction_id").cast("bigint").alias("turn"), F.lit("memo").alias("role"), said.alias("text"))
    return turns.unionByName(docs).unionByName(memos)


def _hits_sql(kws):
    return "list_filter([" + ", ".join(f"CASE WHEN contains({_LOW}, {S.q(k)}) THEN {S.q(k)} END" for k in kws) + "], lambda x: x IS NOT NULL)"


def _any_sql(kws):
    return "(" + " OR ".join(f"contains({_LOW}, {S.q(k)})" for k in kws) + ")"


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
_LWORDS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"


@register("text_entities", _sql("SELECT conv_id, turn, role, text, "
          f"array_to_string({_hits_sql(dict(TM.FINANCIAL_KEYWORDS)['merchants'])}, ',') AS ent_merchants, "
          "array_to_string(" + " || ".join(f"regexp_extract_all({_LOW}, {S.q(p)}, 1)" for p in TM.AMOUNT_PATTERNS) + ", ',') AS ent_amounts, "
          f"array_to_string({_hits_sql(TM.ENTITY_CATEGORIES)}, ',') AS ent_categories, "
          f"array_to_string({_hits_sql(TM.ENTITY_LOCATIONS)}, ',') AS ent_locations, "
          "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_LOW}, {S.q(p)}) THEN {S.q(p)} END" for p in TM.DATE_PATTERNS)
          + "], lambda x: x IS NOT NULL), ',') AS ent_dates FROM conversations"))
def q_text_entities(spark, sf):
    return finish(TM.entities(_texts(spark, sf)))


_EMO = [n for n, _, _ in TM.EMOTIONS]


@register("text_emotions", rounded(_sql("SELECT conv_id, turn, " + ", ".join(
    f"CASE WHEN {_any_sql(kws)} THEN {w!r} ELSE 0.0 END AS emo_{n}" for n, w, kws in TM.EMOTIONS)
    + f", CASE WHEN NOT {_any_sql([k for _, _, kws in TM.EMOTIONS for k in kws])} THEN 0.5 ELSE 0.0 END AS emo_neutral FROM conversations"),
    [f"emo_{n}" for n in _EMO] + ["emo_neutral"]))
def q_text_emotions(spark, sf):
    return finish(TM.emotions(_texts(spark, sf)).select(*KEYS, *[f"emo_{n}" for n in _EMO], "emo_neutral"))


_POS = " + ".join(f"CAST(contains({_LOW}, {S.q(w)}) AS INTEGER)" for w in TM.POSITIVE_WORDS)
_NEG = " + ".join(f"CAST(contains({_LOW}, {S.q(w)}) AS INTEGER)" for w in TM.NEGATIVE_WORDS)
_SENT = (f"CASE WHEN len({_WORDS}) = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, "
         f"CAST(({_POS}) - ({_NEG}) AS DOUBLE) / greatest(len({_WORDS}), 1) * 10)) END")


@register("text_sentiment", rounded(_sql(f"SELECT conv_id, turn, {_SENT} AS sentiment_score, CAST(len({_WORDS}) AS BIGINT) AS n_words FROM conversations"),
                                    ["sentiment_score"]))
def q_text_sentiment(spark, sf):
    t = TM.lowered(_texts(spark, sf))
    return finish(t.select(*KEYS, TM.sentiment(F.col(TM.LOW)).alias("sentiment_score"),
                           TM.word_count(F.col("text")).cast("long").alias("n_words")))


_INS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any_sql(kws)} THEN {S.q(n)} END" for n, kws in TM.INSIGHTS) + "], lambda x: x IS NOT NULL), ',')"


@register("text_insights", _sql(f"SELECT conv_id, turn, {_INS} AS insights FROM conversations"))
def q_text_insights(spark, sf):
    return finish(TM.lowered(_texts(spark, sf)).select(*KEYS, F.array_join(TM.insights(F.col(TM.LOW)), ",").alias("insights")))


@register("text_keywords", _sql("SELECT conv_id, turn, array_to_string(list_sort(list_distinct("
          + _hits_sql([k for _, kws in TM.FINANCIAL_KEYWORDS for k in kws]) + ")), ',') AS keywords FROM conversations"))
def q_text_keywords(spark, sf):
    return finish(TM.lowered(_texts(spark, sf)).select(*KEYS, F.array_join(TM.keywords(F.col(TM.LOW)), ",").alias("keywords")))


_LANG = f"CASE WHEN {_any_sql(TM.HINDI_INDICATORS)} THEN 'hi' ELSE 'en' END"


@register("text_language", _sql(f"SELECT conv_id, turn, {_LANG} AS language FROM conversations"))
def q_text_language(spark, sf):
    return finish(TM.lowered(_texts(spark, sf)).select(*KEYS, TM.language(F.col(TM.LOW)).alias("language")))


_TOKKW = " || ".join(f"list_filter({_LWORDS}, lambda w: w IN ({', '.join(S.q(k) for k in kws)}))" for _, kws in TM.FINANCIAL_KEYWORDS)
ANALYSIS_SQL = f"""SELECT conv_id, turn, CAST(len({_WORDS}) AS BIGINT) AS n_words, len({_WORDS}) / 2.5 AS duration_seconds,
  0.92 + (CAST(('0x' || substr(md5(text), 1, 8)) AS BIGINT) % 100) / 1000.0 AS confidence,
  {_SENT} AS sentiment_score, {_LANG} AS language, {_INS} AS insights,
  array_to_string({_TOKKW}, ',') AS financial_keywords FROM conversations"""


@register("text_analysis", rounded(_sql(ANALYSIS_SQL), ["duration_seconds", "confidence", "sentiment_score"]))
def q_text_analysis(spark, sf):
    return finish(TM.analysis(_texts(spark, sf), KEYS))


_MENTIONS = " UNION ALL ".join(
    f"""SELECT conv_id, turn, {i} AS pattern_no, {S.q(a)} AS action_type, i AS mi,
          CAST(replace(num[i + 1], ',', '') AS DOUBLE) * {m!r} AS amount, seg[i + 1] AS text_segment
        FROM (SELECT conv_id, turn, regexp_extract_all({_LOW}, {S.q(p)}, 0) AS seg, regexp_extract_all({_LOW}, {S.q(p)}, 1) AS num
              FROM conversations), LATERAL (SELECT unnest(range(len(seg))) AS i)"""
    for i, (p, a, m) in enumerate(TM.SPENDING_PATTERNS))


@register("spending_mentions", rounded(_sql(f"""SELECT conv_id, turn,
  CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY pattern_no, mi) - 1 AS INTEGER) AS match_no,
  pattern_no, action_type, amount, text_segment, 0.9 AS confidence FROM ({_MENTIONS})"""), ["amount", "confidence"]))
def q_spending_mentions(spark, sf):
    return finish(TM.spending_mentions(_texts(spark, sf), KEYS))


# an average of few fixed values often ends in a tie at the 7th place: no float
# sum may decide it, so weights are counted and other values summed as decimals
_EMO_WEIGHTS = [(n, w) for n, w, _ in TM.EMOTIONS] + [("neutral", 0.5)]


def _exact_avg(c):
    return F.sum(F.col(c).cast("decimal(28,9)")).cast("double") / F.count(c)


def _exact_avg_sql(c):
    return f"CAST(sum(CAST({c} AS DECIMAL(28,9))) AS DOUBLE) / count({c})"


_ROLL = [f"{f}_emo_{n}" for f in ("avg", "max") for n in _EMO + ["neutral"]] + ["avg_sentiment", "min_sentiment", "max_sentiment",
                                                        "positive_ratio", "avg_duration", "avg_confidence"]


@register("voice_rollup", rounded(_sql(f"""WITH a AS ({ANALYSIS_SQL}),
e AS (SELECT conv_id, turn, {', '.join(f"CASE WHEN {_any_sql(kws)} THEN {w!r} ELSE 0.0 END AS emo_{n}" for n, w, kws in TM.EMOTIONS)},
   CASE WHEN NOT {_any_sql([k for _, _, kws in TM.EMOTIONS for k in kws])} THEN 0.5 ELSE 0.0 END AS emo_neutral FROM conversations),
lang AS (SELECT conv_id, language FROM (SELECT conv_id, language, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, language) AS r
   FROM a GROUP BY conv_id, language) WHERE r = 1)
SELECT conv_id, count(*) AS n_memos, {', '.join(f'count(*) FILTER (WHERE emo_{n} > 0) * {w!r}::DOUBLE / count(*) AS avg_emo_{n}' for n, w in _EMO_WEIGHTS)},
  {', '.join(f'max(emo_{n}) AS max_emo_{n}' for n, _ in _EMO_WEIGHTS)},
  {', '.join(f'count(*) FILTER (WHERE emo_{n} > 0.3) AS n_emo_{n}' for n in _EMO)},
  {_exact_avg_sql('sentiment_score')} AS avg_sentiment, min(sentiment_score) AS min_sentiment, max(sentiment_score) AS max_sentiment,
  avg(CAST(sentiment_score > 0.1 AS DOUBLE)) AS positive_ratio, {_exact_avg_sql('duration_seconds')} AS avg_duration,
  {_exact_avg_sql('confidence')} AS avg_confidence, min(turn) AS first_turn, max(turn) AS last_turn, any_value(lang.language) AS modal_language
FROM a JOIN e USING (conv_id, turn) JOIN lang USING (conv_id) GROUP BY conv_id"""), _ROLL))
def q_voice_rollup(spark, sf):
    """Per conversation (a user's memo stream)."""
    t = _texts(spark, sf)
    a = TM.analysis(t, KEYS).join(TM.emotions(t).select(*KEYS, *[f"emo_{n}" for n in _EMO], "emo_neutral"), KEYS)
    lang = (a.groupBy("conv_id", "language").agg(F.count(F.lit(1)).alias("_c")).groupBy("conv_id")
             .agg(F.min_by("language", F.struct(-F.col("_c"), F.col("language"))).alias("modal_language")))
    r = a.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_memos"),
        *[(F.count_if(F.col(f"emo_{n}") > 0) * F.lit(w) / F.count(F.lit(1))).alias(f"avg_emo_{n}") for n, w in _EMO_WEIGHTS],
        *[F.max(f"emo_{n}").alias(f"max_emo_{n}") for n in _EMO + ["neutral"]],
        *[F.count_if(F.col(f"emo_{n}") > 0.3).alias(f"n_emo_{n}") for n in _EMO],
        _exact_avg("sentiment_score").alias("avg_sentiment"), F.min("sentiment_score").alias("min_sentiment"),
        F.max("sentiment_score").alias("max_sentiment"),
        F.avg((F.col("sentiment_score") > 0.1).cast("double")).alias("positive_ratio"),
        _exact_avg("duration_seconds").alias("avg_duration"), _exact_avg("confidence").alias("avg_confidence"),
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    return finish(r.join(lang, "conv_id"))


@register("voice_top_terms", _sql(f"""WITH w AS (SELECT conv_id, unnest({_TOKKW}) AS term FROM conversations),
c AS (SELECT conv_id, term, count(*) AS n FROM w GROUP BY ALL)
SELECT conv_id, term, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, term) AS r FROM c)
WHERE r <= 10"""))
def q_voice_top_terms(spark, sf):
    """The 10 most common financial keywords per conversation."""
    t = TM.with_tokens(TM.lowered(_texts(spark, sf)))
    w = t.select("conv_id", F.explode_outer(TM.token_keywords(F.col(TM.TOKENS))).alias("term")).where("term IS NOT NULL")
    c = w.groupBy("conv_id", "term").agg(F.count(F.lit(1)).alias("n"))
    top = top_k(c, ["conv_id"], [F.col("n").desc(), F.col("term")], 10)
    return finish(top.select("conv_id", "term", "n", F.col("rank").cast("int").alias("rank")))


@register("text_insight_rows", rounded(_sql(" UNION ALL ".join(
    f"SELECT conv_id, turn, {S.q(n)} AS insight_type, {TM.INSIGHT_TEXTS[n][0]!r} AS confidence, {S.q(TM.INSIGHT_TEXTS[n][1])} AS message, "
    f"{S.q(TM.INSIGHT_TEXTS[n][2])} AS recommendation, {S.q(TM.INSIGHT_TEXTS[n][3])} AS category FROM conversations WHERE {_any_sql(kws)}"
    for n, kws in TM.INSIGHTS)), ["confidence"]))
def q_text_insight_rows(spark, sf):
    """One full row per insight of a text."""
    return finish(TM.insight_rows(_texts(spark, sf), KEYS))


@register("voice_top_insights", _sql(f"""WITH w AS (SELECT conv_id, unnest(string_split({_INS}, ',')) AS insight FROM conversations),
c AS (SELECT conv_id, insight, count(*) AS n FROM w WHERE insight <> '' GROUP BY ALL)
SELECT conv_id, insight, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, insight) AS r FROM c)
WHERE r <= 3"""))
def q_voice_top_insights(spark, sf):
    """The 3 most common insight types per conversation (ties by name)."""
    w = TM.lowered(_texts(spark, sf)).select("conv_id", F.explode_outer(TM.insights(F.col(TM.LOW))).alias("insight")).where("insight IS NOT NULL")
    c = w.groupBy("conv_id", "insight").agg(F.count(F.lit(1)).alias("n"))
    top = top_k(c, ["conv_id"], [F.col("n").desc(), F.col("insight")], 3)
    return finish(top.select("conv_id", "insight", "n", F.col("rank").cast("int").alias("rank")))
