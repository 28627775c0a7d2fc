import random

import pytest
from pyspark.sql import Row

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, score string, hits string, n_lines string, size string, key string, token_ids string"
EXTRA = ("a", "b", "c", "d", "e", "f", "g")


def words(rng, n):
    return " ".join("".join(rng.choice("abdegilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def make_docs(spark, rows):
    """Documents with extra columns named like the operators' own."""
    data = [tuple(r) + EXTRA[: 12 - len(r)] for r in rows]
    return spark.createDataFrame(data, DOCS) if data else spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text, lang, source, n_chars) with nulls, empty and long texts,
    repeated rows and ids, and line ends of all kinds."""
    rng = random.Random(5)
    base = words(rng, 400)
    near = base.split()
    near[200] = "changed"
    rows = [
        (1, None, "en", "s", None), (2, "", None, None, 0), (3, " \t\n\r ", "en", "s", 5), (4, base, "en", "s", 1),
        (4, base, "en", "s", 1), (5, base, "de", None, None), (6, " ".join(near), "en", "s", 1),
        (None, base[:700], "fr", "s", 3), (None, "Ünïcode ’quotes’ — 漢字かな 🙂 \U0001F9FF͸ x", "fr", "s", 3),
        (7, "two words", "en", "s", 9), (8, "Two, words!", "en", "t", 9), (9, "12345 67 ###", "en", "t", 9),
        (10, words(rng, 60_000), "en", "t", 1), (11, "a" * 30_000, "en", "t", 1), (12, " " * 20_000 + "x", "en", "t", 1),
        (13, "line\nline\r\n  line  \n\nother", "en", "t", 1), (14, "\x00\x01 control \x1f", "en", "t", 1),
        (15, "it's we'll I'd <|endoftext|> ''s  <|endoftext|>", "en", "t", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward_docs(spark, awkward):
    return make_docs(spark, awkward)


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])


def rows_of(df):
    return [Row(**r.asDict()) for r in df.collect()]
