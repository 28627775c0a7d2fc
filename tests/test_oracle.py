"""Every registered query against its DuckDB oracle (or a rows-only run)."""
import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF
from ledgerlens.sources.tables import TABLES

QUERIES = E.queries()
ORACLES = E.oracle_sql()
# Spark ML keys: tests/test_ml_queries.py runs them with a small forest
TRAINING = {"train_tagger", "cv_accuracy", "platt_calibration", "score_transactions", "score_checks", "train_delta",
            "model_comparison", "feature_importance", "explain_scores"}
# ties of rounded averages show on more rows only
LARGER, LARGER_SF = ["voice_rollup", "merchant_insight_rows"], "/root/testdata/sf0.01"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(x)) for x in row)


def _compare(spark, con, key, sf):
    df = QUERIES[key](spark, sf)
    cols = df.columns
    rows = [tuple(_norm(x) for x in r) for r in df.collect()]
    rel = con.sql(ORACLES[key])
    ocols = rel.columns
    assert sorted(cols) == sorted(ocols)
    order = sorted(range(len(ocols)), key=lambda i: ocols[i])
    idx = [cols.index(ocols[i]) for i in order]
    got = sorted((tuple(r[i] for i in idx) for r in rows), key=_key)
    exp = sorted((tuple(_norm(r[i]) for i in order) for r in rel.fetchall()), key=_key)
    assert len(got) == len(exp)
    assert got == exp


# a query without an oracle has a test of its own
@pytest.mark.parametrize("key", sorted(k for k in QUERIES if k in ORACLES and k not in TRAINING))
def test_query_matches_oracle(spark, duck, key):
    _compare(spark, duck, key, SF)


@pytest.mark.parametrize("key", LARGER)
def test_query_matches_oracle_on_more_rows(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{LARGER_SF}/{t}.parquet')")
    _compare(spark, con, key, LARGER_SF)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_the_library_stands_without_the_optional_part(tmp_path):
    """Without the training-data operators the other queries are still there."""
    top = Path(E.__file__).parent
    shutil.copytree(top / "ledgerlens", tmp_path / "ledgerlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries()), sep=chr(10))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == sorted(k for k in QUERIES if not k.startswith("op") and k != "pipeline")
