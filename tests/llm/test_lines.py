"""Site-relative line frequency: both join paths and awkward input."""
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import line_dedup
from llm.conftest import make_docs


def brute(rows, ratio, least):
    pages, seen = defaultdict(int), defaultdict(int)
    for _, text, _, host, *_ in rows:
        pages[host] += 1
        for line in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
            seen[host, line] += 1
    out = []
    for i, text, _, host, *_ in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if not (x.strip(" \t\r") and seen[host, x.strip(" \t\r")] >= least
                                         and seen[host, x.strip(" \t\r")] > ratio * pages[host])]
        out.append((-1 if i is None else i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_lines", [1000, -1])
@pytest.mark.parametrize("ratio,least,site_lines", [(0.3, 2, 1000), (0.0, 1, 1000), (0.5, 100, 1000), (0.0, 1, 1)])
def test_against_brute_force(spark, awkward, awkward_docs, broadcast_lines, ratio, least, site_lines, monkeypatch):
    monkeypatch.setattr(line_dedup, "SITE_LINES", site_lines)
    out = line_dedup.drop_boilerplate(awkward_docs, F.col("source"), ratio, least, broadcast_lines=broadcast_lines)
    assert set(out.columns) == set(awkward_docs.columns) | {"n_lines", "n_dropped"}
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["text"], r["n_lines"], r["n_dropped"])
                  for r in out.collect()), key=str)
    assert got == brute(awkward, ratio, least)


def test_boilerplate_goes_and_the_rest_stays(spark):
    rows = [(i, f"Home\n  page {i}\nFooter", "en", "a" if i % 2 else None, 1) for i in range(40)]
    rows += [(100 + i, f"Home\nother {i}", "en", "b", 1) for i in range(3)]
    rows += [(200 + i, f"Home\nthird {i}", "en", "c", 1) for i in range(2)]
    out = line_dedup.drop_boilerplate(make_docs(spark, rows), F.col("source"), 0.1, 3)
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[0] == "  page 0" and text[1] == "  page 1"
    assert text[100] == "other 0" and text[200] == "Home\nthird 0"  # three pages of a small site, two of another


def test_url_hosts_and_empty_table(spark, no_docs):
    df = spark.createDataFrame([(i, f"http://h{i % 2}.org/{i}", f"menu\nbody {i}") for i in range(60)], "doc_id int, url string, text string")
    out = line_dedup.drop_boilerplate(df, F.parse_url(F.col("url"), F.lit("HOST")), 0.5, 20)
    assert {r["text"] for r in out.collect()} == {f"body {i}" for i in range(60)}
    assert line_dedup.drop_boilerplate(no_docs, F.col("source")).collect() == []


@pytest.mark.parametrize("broadcast_lines", [1000, -1])
def test_copies_count_once_and_no_page_loses_all(spark, broadcast_lines):
    copy = "first of the copies\n\nsecond"
    rows = [(i, f"Home\nbody {i}", "en", "a", 1) for i in range(40)]
    rows += [(100 + i, copy, "en", "a", 1) for i in range(20)]
    rows += [(200 + i, " " * i + "Home\n", "en", "a", 1) for i in range(3)] + [(300, None, "en", "a", 1), (301, "", "en", "a", 1)]
    out = line_dedup.drop_boilerplate(make_docs(spark, rows), F.col("source"), 0.1, 20, broadcast_lines=broadcast_lines,
                                      by_text=True, keep_whole=True)
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in out.collect()}
    assert all(got[i] == (f"body {i}", 1) for i in range(40))
    assert all(got[i][0] == t and got[i][1] == 0 for i, t, *_ in rows if i >= 100)


def test_query_where_lines_drop(spark):
    """op7 against its SQL on a table where many lines drop."""
    import duckdb
    from ledgerlens.llm import queries
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    rel = con.sql(queries.ORACLES["op7_line_dedup"])
    want, cols = sorted(rel.fetchall()), rel.columns
    got = sorted(tuple(r[c] for c in cols) for r in queries.QUERIES["op7_line_dedup"](spark, folder).collect())
    assert got == want and sum(r[cols.index("n_dropped")] for r in want) > 100
