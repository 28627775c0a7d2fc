"""Adapters that turn the given tables into the canonical ``transactions``
shape, plus dimensions derived deterministically from them.

Canonical columns (all nullable):
  transaction_id STRING, user_id STRING, merchant_name STRING, amount DOUBLE,
  timestamp TIMESTAMP_NTZ, category STRING, vpa STRING, source STRING,
  status STRING, disputed BOOLEAN, refunded BOOLEAN, rating DOUBLE,
  type STRING, memo STRING, direction STRING, caps_state STRING, payee_name STRING

``txn``  is built from ``events`` (real times of day, one month).
``pay``  is built from ``lineitem ⋈ orders ⋈ supplier ⋈ part`` (multi-year,
         dates at midnight).
The oracle SQL mirrors these definitions text for text (``plans/oracle_base``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# --- fixed values (our own choice, used by both the adapter and the oracle) ---
# Merchant names assigned to events by k % 20.
MERCHANT_NAMES = [
    "Swiggy", "Zomato", "Uber", "Ola Cabs", "Amazon", "Flipkart", "Tea Point",
    "Chai Wala", "Starbucks", "Netflix", "Spotify", "BookMyShow", "Apollo Pharmacy",
    "Airtel Recharge", "Tata Power Electricity", "Big Bazaar Mart", "Tea Points",
    "Zerodha Stock", "City Hospital", "Random New Service",
]
# Remarks added to the memo of an order by l_orderkey % 16, and the line of
# business in a supplier's VPA by l_suppkey % 9.
ORDER_REMARKS = ["", "loan", "lend money", "borrow", "repay", "return", "birthday gift", "tip", "tipping point", "food dinner",
                 "uber cab fuel", "shopping amazon clothes", "electricity bill recharge", "movie ticket", "rent salary", "loans"]
VPA_TRADES = ["traders", "food", "grocery", "mart", "taxi", "movie", "mobile", "clinic", "school"]
# VPA handles assigned to events by k % 5.
VPA_HANDLES = ["paytm", "ybl", "okhdfcbank", "oksbi", "upi"]
# Catalog category per supplier nation, by s_nationkey % 13 (the 13 catalog categories).
CATALOG_CATEGORIES = [
    "Food & Dining", "Transport", "Shopping", "Bills & Utilities",
    "Digital Subscriptions", "Healthcare & Pharmacy", "Education & Coaching",
    "Finance & Insurance", "Groceries & Kirana", "Travel & Hospitality",
    "Fashion & Lifestyle", "Government & NGOs", "Home & Services",
]
# Literal catalog rows that always lead the catalog (test fixture rows).
CATALOG_FIXTURE = [
    ("Tea Point", "Food & Dining", "Tea"),
    ("Chai Wala", "Food & Dining", "Tea"),
    ("Starbucks", "Food & Dining", "Coffee"),
    ("Uber", "Transport", "Ride Hailing"),
]

CANONICAL_COLUMNS = [
    "transaction_id", "user_id", "merchant_name", "amount", "timestamp", "category",
    "vpa", "source", "status", "disputed", "refunded", "rating", "type", "memo",
    "direction", "caps_state", "payee_name",
]


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn_from_events(table(spark, sf_dir, "events"))


def txn_from_events(ev: DataFrame) -> DataFrame:
    """Row-level mapping only, so it applies to a streaming ``events`` too."""
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.element_at(_lit_array(MERCHANT_NAMES), F.pmod(k, F.lit(20)) + 1)
    handle = F.element_at(_lit_array(VPA_HANDLES), F.pmod(k, F.lit(5)) + 1)
    is_err = F.col("event_type") == "error"
    return ev.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("user_id").cast("string").alias("user_id"),
        name.alias("merchant_name"),
        F.col("value").alias("amount"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("category"),
        F.concat(F.lower(F.regexp_replace(name, " ", "")), F.lit("@"), handle).alias("vpa"),
        F.lit("events").alias("source"),
        F.when(is_err, "failed").otherwise("success").alias("status"),
        F.lit(False).alias("disputed"),
        is_err.alias("refunded"),
        F.when(F.col("event_type") == "purchase", (F.pmod(k, F.lit(5)) + 1).cast("double")).alias("rating"),
        F.when(is_err, "refund").otherwise("purchase").alias("type"),
        F.col("event_type").alias("memo"),
        F.when(F.col("event_type") == "signup", "receive").otherwise("send").alias("direction"),
        F.lit(None).cast("string").alias("caps_state"),
        F.lit(None).cast("string").alias("payee_name"),
    )


def pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payments fact: a 4-way join, planned inline from the source tables
    as they are now. Branches of one query that read it share its exchanges;
    nothing is kept between queries, so a replaced source file is seen."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        "l_returnflag", "l_linestatus", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    # No broadcast hints: supplier/part grow with the data; the planner and AQE
    # pick broadcast only from measured sizes (autoBroadcastJoinThreshold).
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(s, li.l_suppkey == s.s_suppkey)
           .join(p, li.l_partkey == p.p_partkey))
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("s_name").alias("merchant_name"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("p_type").alias("category"),
        F.concat(F.col("s_name"), F.lit("."), F.element_at(_lit_array(VPA_TRADES), F.pmod(F.col("l_suppkey"), F.lit(len(VPA_TRADES))).cast("int") + 1),
                 F.lit("@"), F.col("p_brand")).alias("vpa"),
        F.lit("orders").alias("source"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success").alias("status"),
        ((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O")).alias("disputed"),
        (F.col("l_returnflag") == "R").alias("refunded"),
        F.lit(None).cast("double").alias("rating"),
        F.when(F.col("l_returnflag") == "R", "refund").otherwise("purchase").alias("type"),
        F.concat(F.col("p_name"), F.lit(" "), F.element_at(
            _lit_array(ORDER_REMARKS), F.pmod(F.col("l_orderkey"), F.lit(len(ORDER_REMARKS))).cast("int") + 1)).alias("memo"),
        F.when(F.col("l_returnflag") == "R", "receive").otherwise("send").alias("direction"),
        F.lit(None).cast("string").alias("caps_state"),
        F.lit(None).cast("string").alias("payee_name"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchant catalog (``Merchant Name, Category, Subcategory`` + file order
    ``ord``): the fixture rows first, then every supplier with a non-negative
    balance, category by nation. Suppliers with a negative balance stay out of
    the catalog, so the tagger's fuzzy and rule paths see real traffic."""
    fixture = spark.createDataFrame(
        [(i, n, c, sc) for i, (n, c, sc) in enumerate(CATALOG_FIXTURE)],
        "ord BIGINT, `Merchant Name` STRING, Category STRING, Subcategory STRING")
    sup = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") >= 0).select(
        (F.col("s_suppkey") + len(CATALOG_FIXTURE)).alias("ord"),
        F.col("s_name").alias("Merchant Name"),
        F.element_at(_lit_array(CATALOG_CATEGORIES), F.pmod(F.col("s_nationkey"), F.lit(13)) + 1).alias("Category"),
        F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("Subcategory"),
    )
    return fixture.unionByName(sup)


# ----------------------------------------------------------------------------
# Context dimensions for the nudge / advice operators, derived from customer.
# ----------------------------------------------------------------------------
def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("user_id"),
        (F.lit(20000.0) + F.abs(F.col("c_acctbal")) * 5).alias("monthly_income"),
        (F.lit(22) + F.pmod(F.col("c_custkey"), F.lit(40))).cast("int").alias("age"),
        F.pmod(F.col("c_custkey"), F.lit(4)).cast("int").alias("dependents"),
        F.when(F.col("c_acctbal") > 5000, "high").when(F.col("c_acctbal") > 0, "moderate").otherwise("low").alias("risk_tolerance"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "self_employed").otherwise("salaried").alias("employment_status"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("acctbal"))


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer saves for an emergency fund (6 months of income);
    BUILDING-segment customers also save for a purchase-category goal."""
    p = user_profiles(spark, sf_dir)
    sav = p.select("user_id", F.lit(0).alias("goal_order"), F.lit("Emergency Fund").alias("name"),
                   F.lit("savings").alias("type"), F.lit(None).cast("string").alias("category"),
                   (F.col("monthly_income") * 6).alias("target_amount"),
                   F.greatest(F.col("acctbal"), F.lit(0.0)).alias("current_amount"),
                   F.lit("2024-12-31").cast("date").alias("target_date"))
    home = p.where(F.col("segment") == "BUILDING").select(
        "user_id", F.lit(1).alias("goal_order"), F.lit("Home Upgrade").alias("name"), F.lit("purchase").alias("type"),
        F.lit("purchase").alias("category"), F.lit(50000.0).alias("target_amount"),
        (F.greatest(F.col("acctbal"), F.lit(0.0)) / 2).alias("current_amount"),
        F.lit("2025-06-30").cast("date").alias("target_date"))
    return sav.unionByName(home)


def budgets(spark: SparkSession, sf_dir: str, t: DataFrame) -> DataFrame:
    """A budget per (user, category) the user spends in: a tenth of the
    account balance, at least 100."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), "c_acctbal")
    uc = t.select("user_id", F.coalesce("category", F.lit("other")).alias("category")).distinct()
    return uc.join(c, "user_id").select("user_id", "category",
                                        F.greatest(F.lit(100.0), F.abs(F.col("c_acctbal")) / 10).alias("limit"))
