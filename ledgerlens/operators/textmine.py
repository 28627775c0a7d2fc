"""Transcript text operators (P1–P9, G15, I5) over a table of texts.

Every operator is a Column expression over the whole text, no UDF, no
truncation. The lower-cased text is a column of its own (``lowered``), made
once and read by every substring test; whole-word keywords of all groups and
the word count come from one split (``with_tokens``), and the groups share the
few words kept; patterns with amounts run only on texts that hold their unit."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: word lists and patterns that must equal the reference
FINANCIAL_KEYWORDS = [
    ("spending", ["spent", "bought", "purchased", "paid", "cost", "expensive", "cheap", "price"]),
    ("saving", ["save", "saved", "savings", "budget", "affordable", "deal", "discount"]),
    ("regret", ["regret", "mistake", "shouldnt have", "waste", "unnecessary", "overspent"]),
    ("celebration", ["happy", "great deal", "good price", "worth it", "satisfied"]),
    ("concern", ["worried", "stressed", "anxious", "tight budget", "cant afford"]),
    ("goals", ["goal", "target", "plan", "future", "dream", "want to buy"]),
    ("merchants", ["zomato", "swiggy", "amazon", "flipkart", "uber", "ola", "paytm"]),
    ("amounts", ["hundred", "thousand", "lakh", "crore", "rupee", "rupees", "₹"]),
]
AMOUNT_PATTERNS = [r"₹\s*(\d+(?:,\d+)*(?:\.\d+)?)", r"(\d+)\s*rupees?", r"(\d+)\s*thousand", r"(\d+)\s*lakh"]
ENTITY_CATEGORIES = ["food", "transport", "shopping", "entertainment", "utilities", "bills", "groceries", "delivery"]
ENTITY_LOCATIONS = ["mumbai", "delhi", "bangalore", "hyderabad", "chennai", "pune", "kolkata"]
DATE_PATTERNS = ["today", "yesterday", "tomorrow", "last week", "next week",
                 "january|february|march|april|may|june|july|august|september|october|november|december"]
EMOTIONS = [
    ("positive", 0.8, ["excited", "happy", "delicious", "amazing", "great", "wonderful", "love", "fantastic"]),
    ("negative", 0.7, ["ugh", "expensive", "hate", "terrible", "awful", "frustrated", "angry"]),
    ("anxious", 0.6, ["worried", "nervous", "uncertain", "not sure", "concerned", "anxious"]),
    ("confident", 0.7, ["confident", "sure", "definitely", "absolutely", "investing", "planning"]),
    ("frustrated", 0.6, ["again", "always", "getting expensive", "keep paying", "tired of"]),
]
POSITIVE_WORDS = ["good", "great", "happy", "satisfied", "pleased", "excellent", "wonderful"]
NEGATIVE_WORDS = ["bad", "terrible", "awful", "disappointed", "upset", "angry", "frustrated"]
INSIGHTS = [
    ("regret", ["expensive", "costly", "too much", "regret", "waste", "mistake"]),
    ("financial_goal", ["investing", "investment", "save", "saving", "goal", "future", "plan", "budget"]),
    ("concern", ["worried", "concerned", "expensive", "not sure", "uncertain", "stress"]),
    ("celebration", ["excited", "happy", "delicious", "amazing", "great", "celebration"]),
]
# fixed values: confidence, message, recommendation and category per insight
INSIGHT_TEXTS = {
    "regret": (0.8, "You seem to have some regret about a recent purchase",
               "Consider setting spending limits or using our nudge system", "spending_behavior"),
    "financial_goal": (0.7, "You mentioned financial goals or future purchases",
                       "Set up a savings goal in the app to track progress", "financial_planning"),
    "concern": (0.9, "You expressed financial concerns or stress",
                "Review your budget and consider speaking with our AI advisor", "financial_wellness"),
    "celebration": (0.8, "You seem happy with a recent purchase or financial decision",
                    "Great job making smart financial choices!", "positive_reinforcement"),
}
SPENDING_PATTERNS = [
    (r"paid (\d+(?:,\d+)*)\s*rupees?", "payment", 1.0),
    (r"spent (\d+(?:,\d+)*)\s*rupees?", "spent", 1.0),
    (r"bought .+ for (\d+(?:,\d+)*)\s*rupees?", "purchase", 1.0),
    (r"cost (\d+(?:,\d+)*)\s*rupees?", "cost", 1.0),
    (r"(\d+(?:,\d+)*)\s*thousand", "large_amount", 1000.0),
    (r"(\d+(?:,\d+)*)\s*lakh", "very_large_amount", 100000.0),
]
HINDI_INDICATORS = ["hai", "hoon", "paisa", "rupiya", "kharcha", "bachat"]


def _any(low: Column, kws) -> Column:
    c = F.lit(False)
    for k in kws:
        c = c | low.contains(k)
    return c


def _hits(low: Column, kws) -> Column:
    """Keywords present, in list order."""
    return F.array_compact(F.array(*[F.when(low.contains(k), F.lit(k)) for k in kws]))


LOW, TOKENS, N_WORDS = "_low", "_tokens", "_n"
# the keywords that can be a word of their own
_WORDS = list(dict.fromkeys(k for _, kws in FINANCIAL_KEYWORDS for k in kws if " " not in k))


def lowered(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds the lower-cased text: an expression used many times would be
    computed many times, a column once."""
    return texts.withColumn(LOW, F.lower(F.col(text)))


def with_tokens(texts: DataFrame) -> DataFrame:
    """Adds the words of the lowered text that are keywords, in text order,
    and the number of all its words; one split serves both."""
    w = F.split(F.col(LOW), r"\s+")
    d = texts.withColumn("_split", w)
    split, last = F.col("_split"), F.size("_split")
    # white space at either end, and an empty text, leave an empty string
    ends = (split[0] == "").cast("int") + ((last > 1) & (F.element_at(split, -1) == "")).cast("int")
    return d.withColumns({TOKENS: F.filter(split, lambda x: x.isin(*_WORDS)), N_WORDS: last - ends}).drop("_split")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def entities(texts: DataFrame, text: str = "text") -> DataFrame:
    low = F.col(LOW)
    merchants = dict(FINANCIAL_KEYWORDS)["merchants"]
    amounts = F.concat(*[F.regexp_extract_all(low, F.lit(p), 1) for p in AMOUNT_PATTERNS])
    dates = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(p)) for p in DATE_PATTERNS]))
    return lowered(texts, text).select(
        *texts.columns, F.array_join(_hits(low, merchants), ",").alias("ent_merchants"),
        F.array_join(amounts, ",").alias("ent_amounts"),
        F.array_join(_hits(low, ENTITY_CATEGORIES), ",").alias("ent_categories"),
        F.array_join(_hits(low, ENTITY_LOCATIONS), ",").alias("ent_locations"),
        F.array_join(dates, ",").alias("ent_dates"))


def emotions(texts: DataFrame, text: str = "text") -> DataFrame:
    low = F.col(LOW)
    cols = [F.when(_any(low, kws), F.lit(w)).otherwise(F.lit(0.0)).alias(f"emo_{n}") for n, w, kws in EMOTIONS]
    none = ~_any(low, [k for _, _, kws in EMOTIONS for k in kws])
    return lowered(texts, text).select(*texts.columns, *cols, F.when(none, 0.5).otherwise(0.0).alias("emo_neutral"))


def sentiment(low: Column, n: Column | None = None) -> Column:
    """Balance of positive and negative words per word of the text; ``n`` is
    its word count where the table has it already."""
    pos = sum((low.contains(w)).cast("int") for w in POSITIVE_WORDS)
    neg = sum((low.contains(w)).cast("int") for w in NEGATIVE_WORDS)
    n = word_count(low) if n is None else n
    s = (pos - neg) / F.greatest(n, F.lit(1)) * 10
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s.cast("double"))))


def insights(low: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_any(low, kws), F.lit(n)) for n, kws in INSIGHTS]))


def insight_rows(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per insight with its confidence, message, recommendation
    and category."""
    low = F.col(LOW)
    found = [F.when(_any(low, kws), F.struct(*[F.lit(v).alias(c) for c, v in zip(
        ("insight_type", "confidence", "message", "recommendation", "category"), (n, *INSIGHT_TEXTS[n]))])) for n, kws in INSIGHTS]
    rows = lowered(texts, text).select(*keys, F.inline_outer(F.array_compact(F.array(*found))))
    return rows.where(F.col("insight_type").isNotNull())


def keywords(low: Column) -> Column:
    allk = [k for _, kws in FINANCIAL_KEYWORDS for k in kws]
    return F.array_sort(F.array_distinct(_hits(low, allk)))


def language(low: Column) -> Column:
    return F.when(_any(low, HINDI_INDICATORS), "hi").otherwise("en")


def token_keywords(tokens: Column) -> Column:
    """The keyword tokens, category by category (duplicates kept, as in the
    reference)."""
    def keep(kws):
        return lambda w: w.isin(*kws)
    return F.concat(*[F.filter(tokens, keep([k for k in kws if " " not in k])) for _, kws in FINANCIAL_KEYWORDS])


def _mention(i, pattern, action, mult):
    def f(segment):
        number = F.regexp_replace(F.regexp_extract(segment, pattern, 1), ",", "")
        return F.struct(F.lit(i).alias("pattern_no"), F.lit(action).alias("action_type"),
                        (number.cast("double") * F.lit(mult)).alias("amount"), segment.alias("text_segment"))
    return f


def spending_mentions(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """P5: one row per regex match: (pattern_no, match_no, action_type,
    amount, text_segment). A pattern runs on texts that hold its first word
    and its unit."""
    low = F.col(LOW)
    mentions = []
    for i, (pat, action, mult) in enumerate(SPENDING_PATTERNS):
        may = F.lit(True)
        for word in ("paid ", "spent ", "bought ", "cost ", "rupee", "thousand", "lakh"):
            if word in pat:
                may = may & low.contains(word)
        found = F.when(may, F.regexp_extract_all(low, F.lit(pat), F.lit(0))).otherwise(F.array().cast("array<string>"))
        mentions.append(F.transform(found, _mention(i, pat, action, mult)))
    # outer: for an inner explode the optimiser filters by the size of the
    # array first, which would match every pattern again
    ex = (lowered(texts, text).select(*keys, F.posexplode_outer(F.concat(*mentions)).alias("match_no", "m"))
          .where(F.col("match_no").isNotNull()))
    return ex.select(*keys, "match_no", "m.pattern_no", "m.action_type", "m.amount", "m.text_segment",
                     F.lit(0.9).alias("confidence"))


def analysis(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """P8 text-only analysis row per text."""
    t, low = F.col(text), F.col(LOW)
    n = F.col(N_WORDS)
    bucket = F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(100))
    d = with_tokens(lowered(texts, text))
    return d.select(*keys, n.cast("long").alias("n_words"), (n / 2.5).alias("duration_seconds"),
                    (0.92 + bucket / 1000.0).alias("confidence"),
                    sentiment(low, n).alias("sentiment_score"), language(low).alias("language"),
                    F.array_join(insights(low), ",").alias("insights"),
                    F.array_join(token_keywords(F.col(TOKENS)), ",").alias("financial_keywords"))
