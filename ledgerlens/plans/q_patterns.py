"""Extended rules, pattern features, boosts (C9, C10, D6, E11, K10), the
champion/delta blend (K7, I1), novelty dampening (K9), tagger quality (G18)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns as P
from ..sources.adapters import pay, txn
from . import sqlx as S
from .common import finish, rounded
from .oracle_base import PAY, TXN, with_
from .registry import register

_TS = '"timestamp"'
CHAMP_END = "1996-01-01"
DELTA_END = "1997-01-01"


def _ext_sql(name, amount):
    low = f"lower(coalesce({name}, ''))"
    parts = [f"WHEN {S.contains_any(low, kws)} THEN {S.q(lbl)}" for lbl, kws in P.EXTENDED_RULES]
    parts.append(f"WHEN {amount} > 10000 AND {S.contains_any(low, P.FINANCE_RULE[1])} THEN {S.q(P.FINANCE_RULE[0])}")
    parts.append(f"WHEN {S.contains_any(low, P.EDUCATION_RULE[1])} THEN {S.q(P.EDUCATION_RULE[0])}")
    return "CASE " + " ".join(parts) + " ELSE 'other' END"


@register("rule_tagger_extended", rounded(with_(TXN) + f"""
SELECT transaction_id, merchant_name, amount, {_ext_sql('merchant_name', 'amount')} AS category, 0.65 AS confidence FROM txn""",
    ["amount", "confidence"]))
def q_rule_tagger_extended(spark, sf):
    t = txn(spark, sf)
    return finish(t.select("transaction_id", "merchant_name", "amount",
                           P.extended_rule(F.col("merchant_name"), F.col("amount")).alias("category"),
                           F.lit(P.RULE_CONFIDENCE).alias("confidence")))


_NM = "coalesce(merchant_name, '')"
_KW_COLS = ["has_numbers", "has_special_chars"] + [f"keyword_{g}" for g, _ in P.KEYWORD_GROUPS]


@register("merchant_keyword_features", rounded(with_(TXN) + f"""
SELECT transaction_id, length({_NM}) AS merchant_length, CAST(regexp_matches({_NM}, '[0-9]') AS DOUBLE) AS has_numbers,
  CAST({' OR '.join(f"contains({_NM}, {S.q(ch)})" for ch in P.SPECIAL_CHARS)} AS DOUBLE) AS has_special_chars,
  {', '.join(f"CAST({S.contains_any(f'lower({_NM})', kws)} AS DOUBLE) AS keyword_{g}" for g, kws in P.KEYWORD_GROUPS)}
FROM txn""", _KW_COLS))
def q_merchant_keyword_features(spark, sf):
    return finish(P.keyword_features(txn(spark, sf)))


_h, _d = f"hour({_TS})", f"(isodow({_TS}) - 1)"
_wk = f"({_d} >= 5)"
_DP = {
    "hour": _h, "is_morning": f"{_h} BETWEEN 6 AND 11", "is_lunch": f"{_h} BETWEEN 11 AND 14",
    "is_evening": f"{_h} BETWEEN 17 AND 21", "is_late_night": f"({_h} >= 22 OR {_h} <= 5)", "day_of_week": _d,
    "is_weekend": _wk, "is_weekday": f"NOT {_wk}", "is_monday": f"{_d} = 0", "is_friday": f"{_d} = 4",
    "weekend_morning": f"{_wk} AND {_h} BETWEEN 6 AND 11",
    "weekday_commute": f"NOT {_wk} AND ({_h} BETWEEN 7 AND 10 OR {_h} BETWEEN 17 AND 20)",
    "weekend_evening": f"{_wk} AND {_h} BETWEEN 17 AND 22",
}
_DP_DBL = [k for k in _DP if k not in ("hour", "day_of_week")]


@register("daypart_flags", rounded(with_(TXN) + "SELECT transaction_id, " + ", ".join(
    (f"{v} AS {k}" if k in ("hour", "day_of_week") else f"CAST({v} AS DOUBLE) AS {k}") for k, v in _DP.items()) + " FROM txn",
    _DP_DBL))
def q_daypart_flags(spark, sf):
    t = txn(spark, sf)
    return finish(t.select("transaction_id", *[v.alias(k) for k, v in P.daypart(F.col("timestamp")).items()]))


_AP = {
    "amount": "amount", "amount_log": "ln(1 + amount)", "is_micro": "amount <= 50", "is_small": "amount > 50 AND amount <= 500",
    "is_medium": "amount > 500 AND amount <= 5000", "is_large": "amount > 5000", "is_round_amount": "amount % 100 = 0",
    "is_odd_amount": "amount % 2 = 1", "likely_food_amount": "amount BETWEEN 50 AND 1500",
    "likely_transport_amount": "amount BETWEEN 10 AND 500", "likely_utility_amount": "amount BETWEEN 100 AND 5000",
    "likely_shopping_amount": "amount BETWEEN 200 AND 20000",
}


@register("amount_patterns", rounded(with_(PAY) + "SELECT transaction_id, " + ", ".join(
    f"CAST({v} AS DOUBLE) AS {k}" for k, v in _AP.items()) + " FROM pay", list(_AP)))
def q_amount_patterns(spark, sf):
    t = pay(spark, sf)
    return finish(t.select("transaction_id", *[v.alias(k) for k, v in P.amount_patterns(F.col("amount")).items()]))


def _boost_sql():
    low = "lower(coalesce(merchant_name, ''))"
    kw = {g: S.contains_any(low, kws) for g, kws in P.KEYWORD_GROUPS}
    a = "amount"
    food = (f"(CASE WHEN {kw['food_strong']} THEN 0.15 WHEN {kw['food_medium']} THEN 0.08 ELSE 0.0 END + "
            f"CASE WHEN {_DP['is_lunch']} AND {a} BETWEEN 50 AND 1500 THEN 0.10 WHEN {_DP['is_evening']} AND {a} BETWEEN 50 AND 1500 THEN 0.08 "
            f"WHEN {_DP['is_late_night']} AND {a} > 50 AND {a} <= 500 THEN 0.12 ELSE 0.0 END)")
    tr = (f"(CASE WHEN {kw['transport_strong']} THEN 0.15 WHEN {kw['transport_medium']} THEN 0.08 ELSE 0.0 END + "
          f"CASE WHEN {_DP['weekday_commute']} AND {a} BETWEEN 10 AND 500 THEN 0.12 ELSE 0.0 END)")
    sh = (f"(CASE WHEN {kw['shopping_strong']} THEN 0.15 WHEN {kw['shopping_medium']} THEN 0.08 ELSE 0.0 END + "
          f"CASE WHEN {_DP['weekend_evening']} AND {a} BETWEEN 200 AND 20000 THEN 0.10 ELSE 0.0 END)")
    en = (f"(CASE WHEN {kw['entertainment_strong']} THEN 0.15 WHEN {kw['entertainment_medium']} THEN 0.08 ELSE 0.0 END + "
          f"CASE WHEN {_DP['is_evening']} OR ({_DP['weekend_evening']}) THEN 0.10 ELSE 0.0 END)")
    ut = (f"(CASE WHEN {kw['utility_strong']} THEN 0.15 WHEN {kw['utility_medium']} THEN 0.08 ELSE 0.0 END + "
          f"CASE WHEN {a} BETWEEN 100 AND 5000 THEN 0.08 ELSE 0.0 END)")
    return (f"CASE cat WHEN 'food' THEN {food} WHEN 'transport' THEN {tr} WHEN 'shopping' THEN {sh} "
            f"WHEN 'entertainment' THEN {en} WHEN 'bills' THEN {ut} WHEN 'utility' THEN {ut} ELSE 0.0 END")


@register("confidence_boost", rounded(with_(TXN, f"b AS (SELECT *, {_ext_sql('merchant_name', 'amount')} AS cat FROM txn)",
    f"c AS (SELECT transaction_id, cat, {_boost_sql()} AS boost FROM b)") + """
SELECT transaction_id, cat AS predicted_category, 0.65 AS base_confidence, boost AS confidence_boost,
  least(0.65 + boost, 0.96) AS confidence, CAST(least(0.65 + boost, 0.96) < 0.7 AS INTEGER) AS requires_review FROM c""",
    ["base_confidence", "confidence_boost", "confidence"]))
def q_confidence_boost(spark, sf):
    return finish(P.boosted(txn(spark, sf)))


# --- K7 / K9 / G18 -----------------------------------------------------------
def _blend(spark, sf):
    t = pay(spark, sf)
    idx = P.label_index(t)
    k = idx.agg(F.count(F.lit(1))).scalar()
    champ_rows = t.where(F.col("timestamp") < F.lit(CHAMP_END).cast("timestamp_ntz"))
    delta_rows = t.where((F.col("timestamp") >= F.lit(CHAMP_END).cast("timestamp_ntz"))
                         & (F.col("timestamp") < F.lit(DELTA_END).cast("timestamp_ntz")))
    champ = P.frequency_model(champ_rows, "vpa", idx, k)
    delta = P.frequency_model(delta_rows, "user_id", idx, k)
    rows = t.select("transaction_id", "vpa", "user_id", "category", "timestamp")
    return P.blend(rows, champ, delta, "vpa", "user_id", idx, k), champ


BLEND_CTES = [
    """labels AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT category AS label FROM pay WHERE category IS NOT NULL))""",
    """kk AS (SELECT count(*) AS k FROM labels)""",
    f"""cm AS (SELECT vpa, category, count(*) AS c FROM pay WHERE {_TS} < TIMESTAMP '{CHAMP_END}' GROUP BY ALL)""",
    f"""cn AS (SELECT vpa, count(*) AS n FROM pay WHERE {_TS} < TIMESTAMP '{CHAMP_END}' AND category IS NOT NULL GROUP BY ALL)""",
    f"""dm AS (SELECT user_id, category, count(*) AS c FROM pay WHERE {_TS} >= TIMESTAMP '{CHAMP_END}' AND {_TS} < TIMESTAMP '{DELTA_END}' GROUP BY ALL)""",
    f"""dn AS (SELECT user_id, count(*) AS n FROM pay WHERE {_TS} >= TIMESTAMP '{CHAMP_END}' AND {_TS} < TIMESTAMP '{DELTA_END}' AND category IS NOT NULL GROUP BY ALL)""",
    """pr AS (SELECT row_number() OVER () AS rid, * FROM pay)""",
    """lng AS (SELECT p.rid, p.transaction_id, l.idx, l.label,
   CASE WHEN cn.n IS NULL THEN 1.0 / kk.k ELSE (coalesce(cm.c, 0) + 1) / (cn.n + kk.k) END AS cp,
   CASE WHEN dn.n IS NULL THEN NULL ELSE (coalesce(dm.c, 0) + 1) / (dn.n + kk.k) END AS dp
  FROM pr p CROSS JOIN labels l CROSS JOIN kk LEFT JOIN cn ON cn.vpa = p.vpa LEFT JOIN cm ON cm.vpa = p.vpa AND cm.category = l.label
  LEFT JOIN dn ON dn.user_id = p.user_id LEFT JOIN dm ON dm.user_id = p.user_id AND dm.category = l.label)""",
    f"""bl AS (SELECT *, CASE WHEN dp IS NULL THEN cp ELSE {P.BLEND_ALPHA!r} * cp + {1 - P.BLEND_ALPHA!r} * dp END AS p FROM lng)""",
    """rk AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p DESC, idx DESC) AS rt,
   row_number() OVER (PARTITION BY rid ORDER BY p DESC, idx ASC) AS ra FROM bl)""",
    """blend AS (SELECT rid, any_value(transaction_id) AS transaction_id, max(CASE WHEN ra = 1 THEN label END) AS predicted_category, max(p) AS confidence,
   max(CASE WHEN rt = 1 THEN label END) AS top1_category, max(CASE WHEN rt = 1 THEN p END) AS top1_confidence,
   max(CASE WHEN rt = 2 THEN label END) AS top2_category, max(CASE WHEN rt = 2 THEN p END) AS top2_confidence,
   max(CASE WHEN rt = 3 THEN label END) AS top3_category, max(CASE WHEN rt = 3 THEN p END) AS top3_confidence,
   CASE WHEN bool_or(dp IS NOT NULL) THEN 'ensemble' ELSE 'champion' END AS prediction_source,
   CAST(max(p) >= 0.6 AS INTEGER) AS meets_threshold FROM rk GROUP BY rid)""",
]
_BL_COLS = ["transaction_id", "predicted_category", "confidence", "top1_category", "top1_confidence", "top2_category",
            "top2_confidence", "top3_category", "top3_confidence", "prediction_source", "meets_threshold"]
_BL_DBL = ["confidence", "top1_confidence", "top2_confidence", "top3_confidence"]


@register("ensemble_blend", rounded(with_(PAY, *BLEND_CTES) + f"SELECT {', '.join(_BL_COLS)} FROM blend", _BL_DBL))
def q_ensemble_blend(spark, sf):
    b, _ = _blend(spark, sf)
    return finish(b.select(*_BL_COLS))


@register("novelty_dampening", rounded(with_(PAY, *BLEND_CTES) + f"""
SELECT b.transaction_id, CAST(cn.vpa IS NULL AS INTEGER) AS novel_merchant,
  CASE WHEN cn.vpa IS NULL AND confidence > 0.6 THEN 0.6 ELSE confidence END AS dampened_confidence,
  {', '.join(f"top{j}_confidence * CASE WHEN cn.vpa IS NULL AND confidence > 0.6 THEN 0.6 / confidence ELSE 1.0 END AS dampened_top{j}_confidence" for j in (1, 2, 3))},
  CAST(cn.vpa IS NULL OR (CASE WHEN cn.vpa IS NULL AND confidence > 0.6 THEN 0.6 ELSE confidence END) < 0.7 AS INTEGER) AS requires_review
FROM blend b JOIN pr p USING (rid) LEFT JOIN cn ON cn.vpa = p.vpa""",
    ["dampened_confidence", "dampened_top1_confidence", "dampened_top2_confidence", "dampened_top3_confidence"]))
def q_novelty_dampening(spark, sf):
    b, champ = _blend(spark, sf)
    known = champ.select("vpa", F.lit(1).alias("_known"))
    d = b.join(known, "vpa", "left")
    out = P.dampen(d, F.col("_known").isNull())
    return finish(out.select("transaction_id", "novel_merchant", "dampened_confidence", "dampened_top1_confidence",
                             "dampened_top2_confidence", "dampened_top3_confidence", "requires_review"))


QUALITY_SQL = rounded(with_(PAY, *BLEND_CTES, f"""ev AS (SELECT p.category AS label, b.predicted_category AS pred, b.confidence FROM blend b JOIN pr p USING (rid)
  WHERE p.{_TS} >= TIMESTAMP '{DELTA_END}' AND p.category IS NOT NULL)""",
    """pc AS (SELECT c, sum(tp) AS tp, sum(sup) AS sup, sum(prd) AS prd FROM (
     SELECT label AS c, CAST(label = pred AS INTEGER) AS tp, 1 AS sup, 0 AS prd FROM ev
     UNION ALL SELECT pred, 0, 0, 1 FROM ev) GROUP BY c)""",
    """m AS (SELECT c, sup, CASE WHEN prd > 0 THEN tp / prd ELSE 0.0 END AS pr, CASE WHEN sup > 0 THEN tp / sup ELSE 0.0 END AS rc FROM pc)""") + """
SELECT (SELECT count(*) FROM ev) AS n, (SELECT avg(CAST(label = pred AS DOUBLE)) FROM ev) AS accuracy,
  sum(sup * pr) / sum(sup) AS precision_weighted, sum(sup * rc) / sum(sup) AS recall_weighted,
  sum(sup * CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END) / sum(sup) AS f1_weighted,
  (SELECT avg(confidence) FROM ev) AS mean_confidence, (SELECT count(*) FILTER (WHERE confidence > 0.8) FROM ev) AS high_confidence,
  (SELECT count(*) FILTER (WHERE confidence < 0.7) FROM ev) AS needs_review,
  CAST((SELECT avg(CAST(label = pred AS DOUBLE)) FROM ev) >= 0.92 AS INTEGER) AS target_met
FROM m""", ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "mean_confidence"])


def quality(ev):
    """G18 over (label, pred, confidence): accuracy, support-weighted
    precision/recall/F1, confidence counts, target flag (0.92)."""
    per_c = ev.select(F.col("label").alias("c"), (F.col("label") == F.col("pred")).cast("int").alias("tp"),
                      F.lit(1).alias("sup"), F.lit(0).alias("prd")).unionByName(
        ev.select(F.col("pred").alias("c"), F.lit(0).alias("tp"), F.lit(0).alias("sup"), F.lit(1).alias("prd")))
    pc = per_c.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("sup"), F.sum("prd").alias("prd"))
    pr = F.when(F.col("prd") > 0, F.col("tp") / F.col("prd")).otherwise(0.0)
    rc = F.when(F.col("sup") > 0, F.col("tp") / F.col("sup")).otherwise(0.0)
    f1 = F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0)
    weighted = pc.agg((F.sum(F.col("sup") * pr) / F.sum("sup")).alias("precision_weighted"),
                      (F.sum(F.col("sup") * rc) / F.sum("sup")).alias("recall_weighted"),
                      (F.sum(F.col("sup") * f1) / F.sum("sup")).alias("f1_weighted"))
    ov = ev.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"),
                F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") > 0.8).alias("high_confidence"),
                F.count_if(F.col("confidence") < 0.7).alias("needs_review"))
    # two one-row aggregates side by side: a 1 x 1 join on a constant key
    return (ov.withColumn("_k", F.lit(1)).join(weighted.withColumn("_k", F.lit(1)), "_k").drop("_k")
              .withColumn("target_met", (F.col("accuracy") >= 0.92).cast("int")))


@register("tagger_quality", QUALITY_SQL)
def q_tagger_quality(spark, sf):
    b, _ = _blend(spark, sf)
    ev = (b.where((F.col("timestamp") >= F.lit(DELTA_END).cast("timestamp_ntz")) & F.col("category").isNotNull())
           .select(F.col("category").alias("label"), F.col("predicted_category").alias("pred"), "confidence"))
    return finish(quality(ev).select("n", "accuracy", "precision_weighted", "recall_weighted", "f1_weighted",
                                     "mean_confidence", "high_confidence", "needs_review", "target_met"))
