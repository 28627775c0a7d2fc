"""Category tagging: catalog dimension, priors, community labels, the
exact → fuzzy → keyword tagger (F5/F6/C8), vocabularies and label codes.

The fuzzy step (containment either way, score = shorter/longer > 0.6) is an
*equi*-join on q-grams: every q-gram of the shorter name stands in the longer
one, so the shorter name is looked up under its rarest q-gram alone, and the
few candidates are verified by length and containment. Work grows with the
length of the names; no nested-loop or cross join, no candidate cap.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .ranking import with_global_position

# fixed values: confidences of the tagger paths
EXACT_CONF = 0.9
FUZZY_MIN_SCORE = 0.6
UNK = "<UNK>"


def strip_lower(c) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def catalog_dim(catalog: DataFrame) -> DataFrame:
    """A1 (priors variant): one row per normalised name, first non-null
    canonical category in file order, canonical id (0 when none)."""
    canon = F.element_at(X.lit_map(X.CATALOG_CANONICAL), F.lower(F.col("Category")))
    d = catalog.select(X.normalize_name(F.col("Merchant Name")).alias("normalized_name"), "ord",
                       canon.alias("canonical_category"))
    g = d.groupBy("normalized_name").agg(
        F.min(F.when(F.col("canonical_category").isNotNull(), F.struct("ord", "canonical_category"))).alias("_f"))
    cat = F.col("_f.canonical_category")
    return g.select("normalized_name", cat.alias("canonical_category"),
                    F.coalesce(F.element_at(X.lit_map(X.CANONICAL_IDS), cat), F.lit(0.0)).alias("canonical_id"))


def tagger_catalog(catalog: DataFrame) -> DataFrame:
    """A1 (tagger variant): key = lower(strip(name)); value = display category
    of the *last* row with that key; order = first row with that key."""
    d = catalog.select(strip_lower(F.col("Merchant Name")).alias("c"), "ord",
                       F.coalesce(F.element_at(X.lit_map(X.CATALOG_DISPLAY), F.col("Category")), F.lit("Other")).alias("cat"))
    return d.groupBy("c").agg(F.min("ord").alias("c_ord"), F.max_by("cat", "ord").alias("c_cat"))


def _grams(s: Column, q: int) -> Column:
    """Distinct q-grams of a name; a shorter name is its own gram."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(s) - (q - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(s, i, F.lit(q))))


def _contained(short: DataFrame, long: DataFrame, q: int = 3) -> DataFrame:
    """(s, l): distinct names ``s`` of ``short`` contained in a name ``l`` of
    ``long`` with length(s) / length(l) > FUZZY_MIN_SCORE."""
    grams = _grams(F.col("l"), q)
    for k in range(1, q):  # a name this short may hold one that is shorter than a q-gram
        grams = F.when(F.length("l") * FUZZY_MIN_SCORE < q - 1, F.array_union(grams, _grams(F.col("l"), k))).otherwise(grams)
    # outer: an inner explode would make the grams once more to test their number
    listed = long.select("l", F.explode_outer(grams).alias("g"))
    rarity = listed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    asked = short.select("s", _grams(F.col("s"), q).alias("gs")).select("s", F.size("gs").alias("need"), F.explode_outer("gs").alias("g"))
    # a name with a gram that no longer name has is contained in none
    rarest = (asked.join(rarity, "g").groupBy("s").agg(F.min_by("g", F.struct("n", "g")).alias("g"), F.count(F.lit(1)).alias("have"), F.max("need").alias("need"))
              .where("have = need"))
    ok = (F.length("s") / F.length("l") > FUZZY_MIN_SCORE) & F.contains(F.col("l"), F.col("s"))
    return rarest.select("s", "g").join(listed, "g").where(ok).select("s", "l")


def fuzzy_match(names: DataFrame, cat: DataFrame) -> DataFrame:
    """F6 over distinct names ``m``: best catalog key by score desc, then
    catalog order. Returns (m, match, score, category)."""
    m = names.select("m").distinct().where(F.length("m") > 0)
    c = cat.select("c").where(F.length("c") > 0)
    pairs = (_contained(c.select(F.col("c").alias("s")), m.select(F.col("m").alias("l"))).select(F.col("l").alias("m"), F.col("s").alias("c"))
             .unionByName(_contained(m.select(F.col("m").alias("s")), c.select(F.col("c").alias("l"))).select(F.col("s").alias("m"), F.col("l").alias("c"))))
    pairs = pairs.distinct().join(cat, "c")
    lm, lc = F.length("m"), F.length("c")
    pairs = pairs.withColumn("score", F.least(lm, lc) / F.greatest(lm, lc))
    best = pairs.groupBy("m").agg(F.min_by(F.struct(F.col("c").alias("match"), "score", F.col("c_cat").alias("category")),
                                           F.struct(-F.col("score"), "c_ord")).alias("_b"))
    return best.select("m", "_b.match", "_b.score", "_b.category")


def tag(t: DataFrame, catalog: DataFrame) -> DataFrame:
    """exact (0.9) → fuzzy (0.7 + 0.2·score) → keyword rules (0.6 / 0.4)."""
    cat = tagger_catalog(catalog)
    names = t.select(strip_lower(F.coalesce("merchant_name", F.lit("Unknown"))).alias("m")).distinct()
    return tag_with(t, cat, fuzzy_match(names.join(cat.select(F.col("c").alias("m")), "m", "left_anti"), cat))


def tag_with(t: DataFrame, cat: DataFrame, matches: DataFrame) -> DataFrame:
    """The tagger with its two dimensions given: ``tagger_catalog`` rows and
    fuzzy matches (m, category, score). Row by row, so ``t`` may be a stream."""
    d = t.select("transaction_id", F.coalesce("merchant_name", F.lit("Unknown")).alias("merchant_name")) \
         .withColumn("m", strip_lower(F.col("merchant_name")))
    d = d.join(cat.select(F.col("c").alias("m"), F.col("c_cat").alias("exact_cat")), "m", "left")
    d = d.join(matches.select("m", F.col("category").alias("fuzzy_cat"), "score"), "m", "left")
    rule_cat, rule_conf = X.rule_tag(F.col("m"))
    category = F.coalesce("exact_cat", "fuzzy_cat", rule_cat)
    conf = (F.when(F.col("exact_cat").isNotNull(), F.lit(EXACT_CONF))
             .when(F.col("fuzzy_cat").isNotNull(), 0.7 + F.col("score") * 0.2).otherwise(rule_conf))
    source = (F.when(F.col("exact_cat").isNotNull(), "merchant_catalog")
               .when(conf > 0.7, "fuzzy_match").otherwise("keyword_rules"))
    return d.select("transaction_id", "merchant_name", X.display_category(category).alias("category"),
                    conf.alias("confidence"), source.alias("prediction_source"),
                    (conf < 0.7).cast("int").alias("requires_review"))


def community_votes(t: DataFrame) -> DataFrame:
    """Crowd votes derived from purchase events: each purchase is a vote for
    the canonical category implied by the merchant's category hint."""
    hint_to_canon = {"food": "Food & Dining", "transport": "Transport", "shopping": "Shopping",
                     "healthcare": "Healthcare", "utilities": "Bills"}
    canon = F.coalesce(F.element_at(X.lit_map(hint_to_canon), X.category_hint("merchant_name")), F.lit("Personal"))
    return t.where(F.col("category") == "purchase").select(
        "transaction_id", "merchant_name", X.vpa_handle("vpa").alias("vpa_handle"), F.lit("").alias("geohash5"),
        canon.alias("category_name"),
        (0.6 + 0.1 * F.pmod(F.col("user_id").cast("long"), F.lit(4))).alias("confidence"),
        F.col("timestamp").alias("ts"))


def community_labels(votes: DataFrame) -> DataFrame:
    """Per signature, votes = count, last (ts, id) vote's category and
    confidence win."""
    sig = X.label_signature("merchant_name", "vpa_handle", "geohash5")
    v = votes.withColumn("signature", sig)
    return v.groupBy("signature").agg(
        F.count(F.lit(1)).alias("votes"),
        F.max_by(F.struct("category_name", "confidence"), F.struct("ts", "transaction_id")).alias("_last"),
    ).select("signature", "votes", F.col("_last.category_name").alias("category_name"),
             F.col("_last.confidence").alias("confidence"))


def priors(t: DataFrame, cdim: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """F1 (+F3 when labels are given): catalog prior by token, then a strong
    community label (confidence >= 0.8) overrides. Keeps the input columns."""
    tok = X.normalize_name("merchant_name")
    d = t.select("*", tok.alias("merchant_token"), X.vpa_handle("vpa").alias("vpa_handle"))
    d = d.join(cdim.select(F.col("normalized_name").alias("merchant_token"), F.col("canonical_id").alias("_cid")),
               "merchant_token", "left")
    cid = F.coalesce("_cid", F.lit(0.0))
    hit = cid > 0
    d = d.select("*", cid.alias("catalog_category_id"),
                 F.when(hit, 0.95).otherwise(0.0).alias("catalog_confidence"),
                 hit.cast("int").alias("merchant_known"), hit.cast("int").alias("payee_seen_before")).drop("_cid")
    if labels is not None:
        d = d.withColumn("_sig", X.label_signature("merchant_token", "vpa_handle"))
        lb = labels.where(F.col("confidence") >= 0.8).select(F.col("signature").alias("_sig"), F.col("category_name").alias("_lc"),
                                                             F.col("confidence").alias("_lconf"))
        d = d.join(lb, "_sig", "left")
        strong = F.col("_lc").isNotNull()
        d = (d.withColumn("catalog_category_id", F.when(strong, F.coalesce(F.element_at(X.lit_map(X.CANONICAL_IDS), F.col("_lc")),
                                                                             F.col("catalog_category_id")))
                          .otherwise(F.col("catalog_category_id")))
              .withColumn("catalog_confidence", F.when(strong, F.greatest(F.lit(0.95), F.col("_lconf"))).otherwise(F.col("catalog_confidence")))
              .withColumn("merchant_known", F.when(strong, 1).otherwise(F.col("merchant_known")))
              .withColumn("payee_seen_before", F.when(strong, 1).otherwise(F.col("payee_seen_before")))
              .drop("_sig", "_lc", "_lconf"))
    c = F.col("catalog_category_id")
    onehot = [(c == float(i)).cast("double").alias(n) for i, n in enumerate(ONEHOT, start=1)]
    return d.select("*", *onehot)


ONEHOT = ["catalog_is_food", "catalog_is_shopping", "catalog_is_transport", "catalog_is_healthcare",
          "catalog_is_personal", "catalog_is_bills"]


def vocabulary(tokens: DataFrame, col: str) -> DataFrame:
    """J5 + K1: sorted distinct vocabulary with ``<UNK>``; code = position."""
    v = tokens.select(F.col(col).alias("value")).where(F.col("value").isNotNull()) \
              .unionByName(tokens.sparkSession.range(1).select(F.lit(UNK).alias("value"))).distinct()
    return with_global_position(v, "value", out="code").select("value", "code")


def encode(df: DataFrame, col: str, vocab: DataFrame, out: str) -> DataFrame:
    unk = vocab.where(F.col("value") == UNK).select("code").scalar()
    d = df.join(vocab.select(F.col("value").alias(col), F.col("code").alias(out)), col, "left")
    return d.withColumn(out, F.coalesce(F.col(out), unk))
