"""Transcript fixture rows (hand-computed from the cited word lists)."""
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import textmine as TM

ROWS = [
    (1, "I just paid fifteen hundred rupees to Swiggy for dinner, and it was absolutely delicious!"),
    (2, "Ugh, I had to pay two thousand five hundred for electricity bill again, this is getting expensive"),
    (3, "I'm so excited! Just bought this amazing dress for three thousand rupees from Myntra"),
    (4, "I'm thinking about investing ten thousand in mutual funds, but I'm not sure if it's the right time"),
    (5, "paid 1,500 rupees then 2 lakh"),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(ROWS, "conv_id INT, text STRING").withColumn("turn", F.lit(0))


def test_entities_and_emotions(texts):
    e = {r.conv_id: r for r in TM.entities(texts).collect()}
    assert e[1].ent_merchants == "swiggy" and e[1].ent_amounts == ""
    assert e[5].ent_amounts == "500,2"
    m = {r.conv_id: r for r in TM.emotions(texts).collect()}
    assert (m[1].emo_positive, m[1].emo_confident) == (0.8, 0.7)
    assert (m[2].emo_negative, m[2].emo_frustrated) == (0.7, 0.6)
    assert m[3].emo_positive == 0.8
    assert (m[4].emo_anxious, m[4].emo_confident) == (0.6, 0.7)
    assert all(r.emo_neutral == 0.0 for r in m.values() if r.conv_id != 5)
    assert m[5].emo_neutral == 0.5


def test_sentiment_insights_language(texts):
    rows = {r.conv_id: r for r in texts.select(
        "conv_id", TM.sentiment(F.col("text")).alias("s"), F.array_join(TM.insights(F.col("text")), ",").alias("i"),
        TM.language(F.col("text")).alias("lang")).collect()}
    assert rows[1].s == 0.0 and rows[1].i == "celebration" and rows[1].lang == "en"
    assert rows[2].i == "regret,concern"
    assert rows[3].i == "celebration"
    assert rows[4].i == "financial_goal,concern"


def test_spending_mentions(texts):
    m = TM.spending_mentions(texts.where("conv_id = 5"), ["conv_id", "turn"]).collect()
    got = sorted((r.action_type, r.amount) for r in m)
    assert got == [("payment", 1500.0), ("very_large_amount", 200000.0)]


@pytest.mark.parametrize("text,n,found", [
    (None, None, ""), ("", 0, ""), ("  \t\n", 0, ""), ("saved", 1, "saved"), (" saved ", 1, "saved"),
    ("Paid\tpaid  paid, rupees\n", 4, "paid,paid,rupees"), ("prepaid costs", 2, "")])
def test_words_of_awkward_texts(spark, text, n, found):
    one = spark.createDataFrame([(1, text)], "conv_id INT, text STRING")
    row = TM.analysis(one, ["conv_id"]).first()
    assert (row.n_words, row.financial_keywords or "") == (n, found)
    whole = one.select(TM.sentiment(F.lower("text")).alias("s"), TM.word_count(F.col("text")).alias("n")).first()
    assert (row.sentiment_score, row.n_words) == (whole.s, whole.n)


def test_mentions_match_each_pattern_once(texts):
    plan = TM.spending_mentions(texts, ["conv_id", "turn"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(TM.SPENDING_PATTERNS)


def test_mentions_of_empty_and_null_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "nothing")], "conv_id INT, text STRING")
    assert TM.spending_mentions(rows, ["conv_id"]).collect() == []
