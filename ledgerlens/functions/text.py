"""String Column expressions: name normalisation, VPA parsing, keyword
chains. Every keyword chain is an ordered ``when`` (first match wins, in the
order written), so the whole thing stays inside whole-stage codegen."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ----------------------------------------------------------------------------
# fixed values: keyword lists and lookup tables that must equal the reference
# ----------------------------------------------------------------------------
# internal category -> keywords (category hint; substring test on lower(name))
CATEGORY_HINT_KEYWORDS = [
    ("food", ["restaurant", "cafe", "food", "delivery", "zomato", "swiggy", "dining",
              "tea", "chai", "coffee", "bakery", "pizza", "burger", "kitchen"]),
    ("transport", ["uber", "ola", "metro", "bus", "train", "fuel", "petrol", "transport"]),
    ("shopping", ["amazon", "flipkart", "shop", "store", "mart", "mall", "retail"]),
    ("utilities", ["electricity", "water", "gas", "internet", "mobile", "recharge", "bill"]),
    ("entertainment", ["movie", "cinema", "netflix", "spotify", "game", "bookmyshow"]),
    ("healthcare", ["hospital", "clinic", "pharmacy", "medical", "doctor", "health"]),
    ("education", ["school", "college", "course", "book", "tuition", "fees"]),
    ("investment", ["mutual", "sip", "stock", "fd", "insurance", "investment"]),
    ("other", []),
]
# internal -> display category
DISPLAY_CATEGORY = {
    "food": "Food & Dining", "transport": "Transport", "shopping": "Shopping",
    "utilities": "Bills & Utilities", "entertainment": "Entertainment",
    "education": "Education", "investment": "Finance", "healthcare": "Healthcare",
    "other": "Other",
}
# keyword rule tagger (display category, keywords); confidence 0.6, else Other 0.4
RULE_TAGGER_KEYWORDS = [
    ("Food & Dining", ["food", "restaurant", "cafe", "coffee", "tea", "chai", "pizza",
                       "burger", "kitchen", "dining", "bakery", "sweets", "snacks",
                       "meal", "lunch", "dinner"]),
    ("Transport", ["uber", "ola", "taxi", "metro", "bus", "train", "petrol", "fuel",
                   "parking"]),
    ("Shopping", ["amazon", "flipkart", "shopping", "store", "mart", "mall", "retail"]),
    ("Bills & Utilities", ["electricity", "gas", "water", "mobile", "internet", "bill",
                           "recharge"]),
    ("Entertainment", ["movie", "cinema", "netflix", "entertainment", "game", "music"]),
]
# catalog category -> display category (tagger); anything else -> Other
CATALOG_DISPLAY = {
    "Food & Dining": "Food & Dining", "Transport": "Transport", "Shopping": "Shopping",
    "Bills & Utilities": "Bills & Utilities", "Digital Subscriptions": "Entertainment",
    "Healthcare & Pharmacy": "Healthcare", "Education & Coaching": "Education",
    "Finance & Insurance": "Finance", "Groceries & Kirana": "Shopping",
    "Travel & Hospitality": "Transport", "Fashion & Lifestyle": "Shopping",
    "Government & NGOs": "Other", "Home & Services": "Other",
}
# lower(catalog category) -> canonical category (priors); others -> null
CATALOG_CANONICAL = {
    "food & dining": "Food & Dining", "shopping": "Shopping", "transport": "Transport",
    "healthcare": "Healthcare", "healthcare & pharmacy": "Healthcare", "bills": "Bills",
    "bills & utilities": "Bills", "personal": "Personal",
}
# canonical category -> id
CANONICAL_IDS = {"Food & Dining": 1.0, "Shopping": 2.0, "Transport": 3.0,
                 "Healthcare": 4.0, "Personal": 5.0, "Bills": 6.0}
# default taxonomy
DEFAULT_CATEGORIES = [
    "Food & Dining", "Shopping", "Transport", "Healthcare", "Personal", "Bills",
    "P2P: Family Transfer", "P2P: Loan Given", "P2P: Loan Repayment", "P2P: Gift",
    "P2P: Tip", "P2P: Reimbursement",
]
# merchant business category from the VPA (substring of lower(vpa))
MERCHANT_BUSINESS_KEYWORDS = [
    ("food_delivery", ["swiggy", "zomato", "ubereats", "foodpanda", "food"]),
    ("grocery", ["bigbasket", "grofers", "blinkit", "zepto", "grocery", "fresh"]),
    ("retail", ["amazon", "flipkart", "myntra", "ajio", "store", "mart"]),
    ("transport", ["uber", "ola", "rapido", "metro", "taxi", "transport"]),
    ("entertainment", ["bookmyshow", "netflix", "spotify", "hotstar", "movie"]),
    ("utilities", ["electricity", "gas", "water", "mobile", "broadband", "bill"]),
    ("healthcare", ["pharmacy", "hospital", "clinic", "doctor", "medical"]),
    ("education", ["school", "college", "university", "course", "education"]),
]
# trusted merchants (first substring hit of lower(name)); default 0.6
TRUSTED_MERCHANTS = [
    ("zomato", 0.95), ("swiggy", 0.95), ("uber", 0.90), ("ola", 0.90), ("amazon", 0.93),
    ("flipkart", 0.90), ("paytm", 0.85), ("phonepe", 0.88), ("googlepay", 0.90),
    ("netflix", 0.95), ("spotify", 0.95),
]
VPA_BANK_PATTERN = "sbi|hdfc|icici|axis|kotak|paytm|gpay|phonepe"
VPA_WALLET_PATTERN = "paytm|mobikwik|freecharge|amazonpay"
LEGAL_SUFFIX_PATTERN = "ltd|pvt|inc|corp"
CITY_PATTERN = "mumbai|delhi|bangalore|chennai|hyderabad|pune|kolkata"
MEMO_TOPIC_PATTERNS = [
    ("memo_has_food_keywords", "food|restaurant|cafe|meal|lunch|dinner|breakfast"),
    ("memo_has_transport_keywords", "taxi|uber|ola|bus|train|metro|fuel|petrol"),
    ("memo_has_shopping_keywords", "shop|store|amazon|flipkart|purchase|buy"),
    ("memo_has_bills_keywords", "bill|electricity|gas|water|rent|mobile|internet"),
]
CAP_STATE_CODES = {"OK": 0, "Near": 1, "Over": 2}


# ----------------------------------------------------------------------------
def _letters_digits(x: Column) -> Column:
    # one pattern: what is not [a-z0-9] is white space or becomes a space, and
    # white space collapses
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def normalize_name(x) -> Column:
    """lower, non [a-z0-9 whitespace] -> space, collapse, trim; null/"" -> unknown."""
    x = _c(x)
    s = _letters_digits(x)
    return F.when(x.isNull() | (x == ""), F.lit("unknown")).otherwise(s)


def normalize_label_name(x) -> Column:
    """Community-label variant: only null -> unknown ("" stays "")."""
    x = _c(x)
    return F.when(x.isNull(), F.lit("unknown")).otherwise(_letters_digits(x))


def vpa_handle(vpa) -> Column:
    v = _c(vpa)
    return F.when(v.isNull() | ~v.contains("@"), F.lit("unknown")).otherwise(
        F.lower(F.substring_index(v, "@", -1)))


def word_count(x) -> Column:
    t = F.trim(_c(x))
    return F.when(_c(x).isNull(), F.lit(None)).when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def is_all_upper(x) -> Column:
    x = _c(x)
    return ((F.upper(x) == x) & (F.lower(x) != x)).cast("int")


def contains_any(x, keywords) -> Column:
    x = _c(x)
    cond = F.lit(False)
    for k in keywords:
        cond = cond | x.contains(k)
    return cond


def first_match(x, table, default) -> Column:
    """Ordered keyword chain: label of the first (label, keywords) whose
    keyword is a substring of x."""
    expr = None
    for label, kws in table:
        if not kws:
            continue
        cond = contains_any(x, kws)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def category_hint(name) -> Column:
    n = _c(name)
    return F.when(n.isNull(), F.lit("other")).otherwise(first_match(F.lower(n), CATEGORY_HINT_KEYWORDS, "other"))


def rule_tag(merchant_lower) -> tuple[Column, Column]:
    cat = first_match(merchant_lower, RULE_TAGGER_KEYWORDS, "Other")
    conf = F.when(cat == "Other", F.lit(0.4)).otherwise(F.lit(0.6))
    return cat, conf


def display_category(internal) -> Column:
    m = F.create_map(*[F.lit(v) for kv in DISPLAY_CATEGORY.items() for v in kv])
    return F.coalesce(F.element_at(m, F.lower(_c(internal))), _c(internal))


def lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in d.items() for v in kv])


def merchant_business_category(vpa) -> Column:
    return first_match(F.lower(F.coalesce(_c(vpa), F.lit(""))), MERCHANT_BUSINESS_KEYWORDS, "other")


def merchant_trust(name) -> Column:
    lower = F.lower(F.coalesce(_c(name), F.lit("")))
    expr = None
    for k, v in TRUSTED_MERCHANTS:
        cond = lower.contains(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(0.6))


def whole_word(x, word) -> Column:
    return _c(x).rlike(r"(?U)\b" + re.escape(word) + r"\b")


def cap_state_code(x) -> Column:
    return F.coalesce(F.element_at(lit_map(CAP_STATE_CODES), _c(x)), F.lit(0))


def label_signature(name, handle, geo=None) -> Column:
    g = F.lit("") if geo is None else F.coalesce(_c(geo), F.lit(""))
    raw = F.concat_ws("|", normalize_label_name(name), F.lower(F.coalesce(_c(handle), F.lit(""))), g)
    return F.substring(F.sha2(raw, 256), 1, 16)


def business_name(vpa) -> Column:
    """text before '@', '.'/'_' -> space, title case."""
    return F.initcap(F.translate(F.substring_index(_c(vpa), "@", 1), "._", "  "))
