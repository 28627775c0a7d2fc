"""Streaming queries (S1–S6): run the stream to completion, read the sink."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import time as T
from ..operators import tagging as TG
from ..sources.adapters import catalog, txn
from ..streaming import jobs as J
from .common import finish, rounded
from .oracle_base import CATALOG, TXN, with_
from .q_tagging import FUZZ, LABELS, TCAT, VOTES, _RULE, _STRIP
from . import sqlx as S
from .registry import register

_TS = '"timestamp"'


@register("stream_training_samples", rounded(with_(TXN) + f"""
SELECT user_id || '_' || strftime({_TS}, '%Y-%m-%dT%H:%M:%S.%f') AS sample_id, user_id, merchant_name, amount,
  strftime({_TS}, '%Y-%m-%d %H:%M:%S.%f') AS ts, category AS label
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, {_TS} ORDER BY transaction_id) AS r FROM txn) WHERE r = 1""", ["amount"]))
def q_stream_training_samples(spark, sf):
    stream = J.stream_txn(spark, sf)
    root = J.route(stream)
    run = J.whole(J.run_batches(J.training_samples(J.on_time(spark, root, stream.schema)), "samples"))
    d = J.with_late_samples(J.read_sink(spark, run), J.late(spark, root, stream.schema))
    return finish(d.select("sample_id", "user_id", "merchant_name", "amount", T.ts_text("timestamp").alias("ts"), "label"))


@register("stream_retrain_trigger", with_(TXN) + """
SELECT CAST(i AS BIGINT) AS trigger_no, CAST(i * 100 AS BIGINT) AS threshold
FROM range(1, (SELECT count(*) FROM txn) // 100 + 1) AS r(i)""")
def q_stream_retrain_trigger(spark, sf):
    stream = J.stream_txn(spark, sf)
    root = J.route(stream)
    run = J.whole(J.retrain_triggers(J.training_samples(J.on_time(spark, root, stream.schema)), every=100))
    rows = J.read_sink(spark, J.late_triggers(run, J.late(spark, root, stream.schema), every=100))
    return finish(rows.where(F.col("trigger_no").isNotNull()).select("trigger_no", "threshold"))


@register("stream_last_txn_features", rounded(with_(TXN) + f"""
SELECT user_id, arg_max(amount, ({_TS}, transaction_id)) AS last_amount, arg_max(hour({_TS}), ({_TS}, transaction_id)) AS last_hour,
  arg_max(merchant_name, ({_TS}, transaction_id)) AS last_merchant,
  strftime(max({_TS}), '%Y-%m-%d %H:%M:%S.%f') AS last_ts, count(*) AS n_seen
FROM txn GROUP BY user_id""", ["last_amount"]))
def q_stream_last_txn_features(spark, sf):
    d = J.read_sink(spark, J.run_batches(J.last_txn_features(J.stream_txn(spark, sf)), "lastfeat", "update"), ["user_id"])
    return finish(d.select("user_id", F.col("_l.amount").alias("last_amount"), F.col("_l.hour").alias("last_hour"),
                           F.col("_l.merchant_name").alias("last_merchant"),
                           T.ts_text("_l.timestamp").alias("last_ts"), "n_seen"))


@register("stream_velocity", with_(TXN) + f"""
SELECT user_id, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
  count(*) AS transactions
FROM (SELECT user_id, time_bucket(INTERVAL 6 HOUR, {_TS}) - to_hours(6 * k) AS ws FROM txn, range(0, 4) AS r(k))
GROUP BY ALL""")
def q_stream_velocity(spark, sf):
    stream = J.stream_txn(spark, sf)
    root = J.route(stream)
    run = J.whole(J.run_batches(J.velocity(J.on_time(spark, root, stream.schema)), "velocity", "update"))
    d = J.with_late_counts(J.read_sink(spark, run, ["user_id", "w"]), J.late(spark, root, stream.schema))
    return finish(d.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                           F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "transactions"))


@register("stream_tagging", rounded(with_(TXN, CATALOG, TCAT, f"""d AS (SELECT transaction_id, coalesce(merchant_name, 'Unknown') AS merchant_name,
   {_STRIP.format(x="coalesce(merchant_name, 'Unknown')")} AS m FROM txn)""",
    """names AS (SELECT DISTINCT m FROM d WHERE m NOT IN (SELECT c FROM tcat))""", FUZZ,
    f"""r AS (SELECT d.transaction_id, d.merchant_name, e.c_cat AS exact_cat, fz.category AS fuzzy_cat, fz.score,
      {_RULE.replace('contains(m,', 'contains(d.m,')} AS rule_cat FROM d LEFT JOIN tcat e ON e.c = d.m LEFT JOIN fz ON fz.m = d.m)""",
    """s AS (SELECT *, coalesce(exact_cat, fuzzy_cat, rule_cat) AS cat,
      CASE WHEN exact_cat IS NOT NULL THEN 0.9 WHEN fuzzy_cat IS NOT NULL THEN 0.7 + score * 0.2
           WHEN rule_cat = 'Other' THEN 0.4 ELSE 0.6 END AS confidence FROM r)""") + f"""
SELECT transaction_id, merchant_name, {S.display('cat')} AS category, confidence,
  CASE WHEN exact_cat IS NOT NULL THEN 'merchant_catalog' WHEN confidence > 0.7 THEN 'fuzzy_match' ELSE 'keyword_rules' END AS prediction_source,
  CAST(confidence < 0.7 AS INTEGER) AS requires_review FROM s""", ["confidence"]))
def q_stream_tagging(spark, sf):
    """The match dimension comes from the names known so far (the backlog's)."""
    names = txn(spark, sf).select(TG.strip_lower(F.coalesce("merchant_name", F.lit("Unknown"))).alias("m"))
    cat = catalog(spark, sf)
    return finish(J.read_sink(spark, J.tag_stream(J.stream_txn(spark, sf), cat, J.match_dimension(names, cat))))


@register("stream_label_votes", rounded(with_(TXN, VOTES, LABELS) + "SELECT * FROM lbl", ["confidence"]))
def q_stream_label_votes(spark, sf):
    votes = TG.community_votes(J.stream_txn(spark, sf))
    d = J.read_sink(spark, J.run_batches(J.label_votes(votes), "votes", "update"), ["signature"])
    return finish(d.select("signature", "votes", F.col("_last.category_name").alias("category_name"),
                           F.col("_last.confidence").alias("confidence")))
