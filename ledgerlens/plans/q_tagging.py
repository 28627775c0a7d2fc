"""Catalog, priors, community labels, tagger, vocabularies (A1, A8, F1–F6,
C8, G14, J2, J5, K1)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import tagging as TG
from ..operators import windows as W
from ..sources.adapters import catalog, pay, txn
from . import sqlx as S
from .common import finish, rounded
from .oracle_base import CATALOG, PAY, TXN, with_
from .registry import register

TRAIN_END = "1998-01-01"
_CANON = "CASE lower(\"Category\") " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in X.CATALOG_CANONICAL.items()) + " END"
_CID = lambda x: "coalesce(CASE " + x + " " + " ".join(f"WHEN {S.q(k)} THEN {v!r}" for k, v in X.CANONICAL_IDS.items()) + " END, 0.0)"
_DISP = "coalesce(CASE \"Category\" " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in X.CATALOG_DISPLAY.items()) + " END, 'Other')"
_STRIP = "lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"

CDIM = f"""cdim AS (SELECT normalized_name, arg_min(cc, ord) AS canonical_category FROM (
    SELECT {S.norm('"Merchant Name"')} AS normalized_name, ord, {_CANON} AS cc FROM catalog) WHERE cc IS NOT NULL
  GROUP BY normalized_name
  UNION ALL
  SELECT DISTINCT {S.norm('"Merchant Name"')}, NULL FROM catalog c0 WHERE NOT EXISTS (
    SELECT 1 FROM catalog c1 WHERE {S.norm('c1."Merchant Name"')} = {S.norm('c0."Merchant Name"')} AND {_CANON.replace('"Category"', 'c1."Category"')} IS NOT NULL))"""


def _taxonomy(spark):
    ids = {v: int(i) for v, i in X.CANONICAL_IDS.items()}
    internal = {"Food & Dining": "food", "Shopping": "shopping", "Transport": "transport", "Healthcare": "healthcare",
                "Bills": "utilities"}
    rows = [(i, c, internal.get(c), ids.get(c, 5 if c.startswith("P2P") else None)) for i, c in enumerate(X.DEFAULT_CATEGORIES)]
    return spark.createDataFrame(rows, "position INT, display STRING, internal STRING, canonical_id INT")


_TAX = " UNION ALL ".join(
    f"SELECT {i} AS position, {S.q(c)} AS display, "
    + (S.q({'Food & Dining': 'food', 'Shopping': 'shopping', 'Transport': 'transport', 'Healthcare': 'healthcare', 'Bills': 'utilities'}[c])
       if c in ('Food & Dining', 'Shopping', 'Transport', 'Healthcare', 'Bills') else "CAST(NULL AS VARCHAR)")
    + f" AS internal, {int(X.CANONICAL_IDS[c]) if c in X.CANONICAL_IDS else (5 if c.startswith('P2P') else 'NULL')} AS canonical_id"
    for i, c in enumerate(X.DEFAULT_CATEGORIES))


@register("category_dim", with_(CATALOG, CDIM, f"tax AS ({_TAX})") + """
SELECT tax.position, tax.display, tax.internal, tax.canonical_id,
  (SELECT count(*) FROM cdim WHERE cdim.canonical_category = tax.display) AS catalog_merchants
FROM tax""")
def q_category_dim(spark, sf):
    """Default taxonomy (12) with canonical ids, joined with how many
    catalog merchants map to each category."""
    cd = TG.catalog_dim(catalog(spark, sf)).groupBy(F.col("canonical_category").alias("display")).agg(
        F.count(F.lit(1)).alias("catalog_merchants"))
    tax = _taxonomy(spark)
    return finish(tax.join(F.broadcast(cd), "display", "left").select(
        "position", "display", "internal", "canonical_id",
        F.coalesce("catalog_merchants", F.lit(0)).cast("long").alias("catalog_merchants")))


_PRI_COLS = ["catalog_category_id", "catalog_confidence", "catalog_is_food", "catalog_is_shopping",
             "catalog_is_transport", "catalog_is_healthcare", "catalog_is_personal", "catalog_is_bills"]
_ONEHOT = ", ".join(f"CAST(catalog_category_id = {float(i)!r} AS DOUBLE) AS {n}" for i, n in enumerate(
    ["catalog_is_food", "catalog_is_shopping", "catalog_is_transport", "catalog_is_healthcare",
     "catalog_is_personal", "catalog_is_bills"], start=1))


@register("catalog_priors", rounded(with_(PAY, CATALOG, CDIM, f"""pr AS (SELECT transaction_id, merchant_name, vpa,
    {S.norm('merchant_name')} AS merchant_token, {S.handle('vpa')} AS vpa_handle,
    {_CID('cdim.canonical_category')} AS catalog_category_id FROM pay LEFT JOIN cdim ON cdim.normalized_name = {S.norm('merchant_name')})""") + f"""
SELECT transaction_id, merchant_name, vpa, merchant_token, vpa_handle, catalog_category_id,
  CASE WHEN catalog_category_id > 0 THEN 0.95 ELSE 0.0 END AS catalog_confidence,
  CAST(catalog_category_id > 0 AS INTEGER) AS merchant_known, CAST(catalog_category_id > 0 AS INTEGER) AS payee_seen_before,
  {_ONEHOT} FROM pr""", _PRI_COLS))
def q_catalog_priors(spark, sf):
    t = pay(spark, sf).select("transaction_id", "merchant_name", "vpa")
    return finish(TG.priors(t, TG.catalog_dim(catalog(spark, sf))))


# --- community labels --------------------------------------------------------
_HINT_CANON = ("coalesce(CASE " + S.category_hint("merchant_name") + " WHEN 'food' THEN 'Food & Dining' WHEN 'transport' THEN 'Transport' "
               "WHEN 'shopping' THEN 'Shopping' WHEN 'healthcare' THEN 'Healthcare' WHEN 'utilities' THEN 'Bills' END, 'Personal')")
VOTES = f"""votes AS (SELECT transaction_id, merchant_name, {S.handle('vpa')} AS vpa_handle, '' AS geohash5,
   {_HINT_CANON} AS category_name, 0.6 + 0.1 * (CAST(user_id AS BIGINT) % 4) AS confidence, "timestamp" AS ts
  FROM txn WHERE category = 'purchase')"""
LABELS = f"""lbl AS (SELECT signature, count(*) AS votes, arg_max(category_name, (ts, transaction_id)) AS category_name,
   arg_max(confidence, (ts, transaction_id)) AS confidence FROM (
   SELECT *, {S.signature('merchant_name', 'vpa_handle', 'geohash5')} AS signature FROM votes) GROUP BY signature)"""


def _labels(spark, sf):
    return TG.community_labels(TG.community_votes(txn(spark, sf)))


@register("community_labels", rounded(with_(TXN, VOTES, LABELS) + "SELECT * FROM lbl", ["confidence"]))
def q_community_labels(spark, sf):
    return finish(_labels(spark, sf))


@register("label_priors", rounded(with_(TXN, VOTES, LABELS, CATALOG, CDIM, f"""pr AS (SELECT transaction_id, merchant_name, vpa,
    {S.norm('merchant_name')} AS merchant_token, {S.handle('vpa')} AS vpa_handle,
    {_CID('cdim.canonical_category')} AS cid FROM txn LEFT JOIN cdim ON cdim.normalized_name = {S.norm('merchant_name')})""",
f"""pl AS (SELECT pr.*, l.category_name AS lc, l.confidence AS lconf FROM pr LEFT JOIN (SELECT * FROM lbl WHERE confidence >= 0.8) l
   ON l.signature = {S.signature('merchant_token', 'vpa_handle')})""",
f"""px AS (SELECT transaction_id, merchant_name, vpa, merchant_token, vpa_handle,
   CASE WHEN lc IS NOT NULL THEN coalesce(CASE lc {' '.join(f'WHEN {S.q(k)} THEN {v!r}' for k, v in X.CANONICAL_IDS.items())} END, cid) ELSE cid END AS catalog_category_id,
   CASE WHEN lc IS NOT NULL THEN greatest(0.95, lconf) WHEN cid > 0 THEN 0.95 ELSE 0.0 END AS catalog_confidence,
   CASE WHEN lc IS NOT NULL OR cid > 0 THEN 1 ELSE 0 END AS merchant_known,
   CASE WHEN lc IS NOT NULL OR cid > 0 THEN 1 ELSE 0 END AS payee_seen_before FROM pl)""") + f"""
SELECT *, {_ONEHOT} FROM px""", _PRI_COLS))
def q_label_priors(spark, sf):
    t = txn(spark, sf).select("transaction_id", "merchant_name", "vpa")
    return finish(TG.priors(t, TG.catalog_dim(catalog(spark, sf)), _labels(spark, sf)))


# --- tagger ------------------------------------------------------------------
TCAT = f"""tcat AS (SELECT c, min(ord) AS c_ord, arg_max(cat, ord) AS c_cat FROM (
   SELECT {_STRIP.format(x='"Merchant Name"')} AS c, ord, {_DISP} AS cat FROM catalog) GROUP BY c)"""
FUZZ = """fz AS (SELECT m, c AS match, score, c_cat AS category FROM (
   SELECT m, c, c_cat, score, row_number() OVER (PARTITION BY m ORDER BY score DESC, c_ord) AS r FROM (
     SELECT n.m, t.c, t.c_ord, t.c_cat, least(length(n.m), length(t.c)) / greatest(length(n.m), length(t.c)) AS score
     FROM names n JOIN tcat t ON (contains(n.m, t.c) OR contains(t.c, n.m)) WHERE length(n.m) > 0) WHERE score > 0.6)
  WHERE r = 1)"""
_RULE = S.first_match("m", X.RULE_TAGGER_KEYWORDS, "Other")


@register("fuzzy_catalog_match", rounded(with_(TXN, PAY, CATALOG, TCAT,
    f"""names AS (SELECT DISTINCT m FROM (SELECT {_STRIP.format(x="coalesce(merchant_name, 'Unknown')")} AS m FROM txn
        UNION ALL SELECT {_STRIP.format(x="coalesce(merchant_name, 'Unknown')")} FROM pay) WHERE m NOT IN (SELECT c FROM tcat))""",
    FUZZ) + "SELECT * FROM fz", ["score"]))
def q_fuzzy_catalog_match(spark, sf):
    cat = TG.tagger_catalog(catalog(spark, sf))
    m = (txn(spark, sf).select("merchant_name").unionByName(pay(spark, sf).select("merchant_name"))
         .select(TG.strip_lower(F.coalesce("merchant_name", F.lit("Unknown"))).alias("m")))
    m = m.join(cat.select(F.col("c").alias("m")), "m", "left_anti")
    return finish(TG.fuzzy_match(m, cat))


@register("catalog_tagger", rounded(with_(TXN, CATALOG, TCAT, f"""d AS (SELECT transaction_id, coalesce(merchant_name, 'Unknown') AS merchant_name,
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
def q_catalog_tagger(spark, sf):
    return finish(TG.tag(txn(spark, sf), catalog(spark, sf)))


@register("rule_tagger", rounded(with_(PAY, f"""r AS (SELECT transaction_id, merchant_name, lower(coalesce(memo, '')) AS m FROM pay)""") + f"""
SELECT transaction_id, merchant_name, {_RULE} AS category, CASE WHEN {_RULE} = 'Other' THEN 0.4 ELSE 0.6 END AS confidence FROM r""",
    ["confidence"]))
def q_rule_tagger(spark, sf):
    """C8 on the part-name text (memo), the only descriptive text of ``pay``."""
    t = pay(spark, sf)
    cat, conf = X.rule_tag(F.lower(F.coalesce("memo", F.lit(""))))
    return finish(t.select("transaction_id", "merchant_name", cat.alias("category"), conf.alias("confidence")))


# --- vocabularies ------------------------------------------------------------
_TOK = S.norm("merchant_name")
VOCAB = f"""vocab AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS code FROM (
   SELECT DISTINCT {_TOK} AS value FROM pay WHERE "timestamp" < TIMESTAMP '{TRAIN_END}' UNION SELECT '<UNK>'))"""


def _vocab(spark, sf):
    t = pay(spark, sf).where(F.col("timestamp") < F.lit(TRAIN_END).cast("timestamp_ntz"))
    return TG.vocabulary(t.select(X.normalize_name("merchant_name").alias("tok")), "tok")


@register("label_vocab", with_(PAY, VOCAB) + "SELECT value, code FROM vocab")
def q_label_vocab(spark, sf):
    return finish(_vocab(spark, sf).withColumn("code", F.col("code").cast("long")))


@register("label_encode", with_(PAY, VOCAB) + f"""
SELECT transaction_id, {_TOK} AS merchant_token,
  coalesce(v.code, (SELECT code FROM vocab WHERE value = '<UNK>')) AS merchant_id
FROM pay LEFT JOIN vocab v ON v.value = {_TOK}""")
def q_label_encode(spark, sf):
    t = pay(spark, sf).select("transaction_id", X.normalize_name("merchant_name").alias("merchant_token"))
    return finish(TG.encode(t, "merchant_token", _vocab(spark, sf), "merchant_id")
                  .withColumn("merchant_id", F.col("merchant_id").cast("long")))


@register("novel_merchants", with_(PAY, CATALOG, CDIM, VOCAB, f"""f AS (SELECT transaction_id, {_TOK} AS tok,
    row_number() OVER (PARTITION BY user_id, merchant_name ORDER BY "timestamp", transaction_id) AS fam FROM pay)""") + f"""
SELECT f.transaction_id, f.tok AS merchant_token,
  CAST(((c.canonical_category IS NULL OR {_CID('c.canonical_category')} = 0) AND fam <= 1) OR v.value IS NULL AS DOUBLE) AS novelty_score
FROM f LEFT JOIN cdim c ON c.normalized_name = f.tok LEFT JOIN vocab v ON v.value = f.tok""")
def q_novel_merchants(spark, sf):
    """novel = (no catalog prior and payee not seen before) or token
    outside the training vocabulary."""
    t = pay(spark, sf)
    fam = W.with_running_count(t.select("transaction_id", "user_id", "merchant_name", "timestamp"),
                               ["user_id", "merchant_name"], "timestamp", "transaction_id", out="fam")
    cd = TG.catalog_dim(catalog(spark, sf)).select(F.col("normalized_name").alias("merchant_token"), "canonical_id")
    v = _vocab(spark, sf).select(F.col("value").alias("merchant_token"), F.lit(1).alias("_inv"))
    d = (fam.withColumn("merchant_token", X.normalize_name("merchant_name"))
            .join(cd, "merchant_token", "left").join(v, "merchant_token", "left")
            .withColumn("catalog_confidence", F.when(F.coalesce("canonical_id", F.lit(0.0)) > 0, 0.95).otherwise(0.0)))
    novel = ((F.col("catalog_confidence") <= 0) & (F.col("fam") <= 1)) | F.col("_inv").isNull()
    return finish(d.select("transaction_id", "merchant_token", novel.cast("double").alias("novelty_score")))


@register("catalog_upsert", with_(TXN, CATALOG, f"""r AS (SELECT DISTINCT merchant_name FROM txn WHERE merchant_name IS NOT NULL
   AND lower(merchant_name) NOT IN (SELECT lower("Merchant Name") FROM catalog))""") + f"""
SELECT "Merchant Name", "Category", 0 AS is_new FROM catalog
UNION ALL
SELECT merchant_name, {S.first_match('lower(merchant_name)', X.RULE_TAGGER_KEYWORDS, 'Other')}, 1 FROM r""")
def q_catalog_upsert(spark, sf):
    """Append merchants not already present (case-insensitive) with their
    rule-tagger category."""
    cat = catalog(spark, sf)
    new = (txn(spark, sf).select("merchant_name").where(F.col("merchant_name").isNotNull()).distinct()
           .join(cat.select(F.lower(F.col("Merchant Name")).alias("_l")),
                 F.lower(F.col("merchant_name")) == F.col("_l"), "left_anti"))
    rc, _ = X.rule_tag(F.lower(F.col("merchant_name")))
    return finish(cat.select("Merchant Name", "Category", F.lit(0).alias("is_new")).unionByName(
        new.select(F.col("merchant_name").alias("Merchant Name"), rc.alias("Category"), F.lit(1).alias("is_new"))))
