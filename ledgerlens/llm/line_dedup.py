"""Line deduplication by site-relative frequency, with DataFrame functions only.

A line is boilerplate of a site when it is on at least ``min_repeats`` pages
of the site and the share of the site's pages that hold it exceeds
``max_ratio``; such lines are dropped from every page of the site. Lines are
compared without surrounding blanks; empty lines are never dropped. The rule
is on the line alone, whatever the size of the site. With ``by_text`` equal texts of a site
are one page, in the counts of lines and of pages, so copies of a page don't
make its lines boilerplate. With ``keep_whole`` a page all of whose lines
would go keeps them all.

Each page sends each of its distinct lines once, as a digest, and the counts
are summed before the shuffle, so a site with a third of all pages costs no
more than its distinct lines. With ``by_text`` (line, text) digests are made
distinct first, in a shuffle that no single line or text can skew. The boilerplate list holds at most
lines-per-page / ``max_ratio`` lines a site; it is written and counted, joined
to the pages by broadcast while it has at most ``broadcast_lines`` lines and
no site more than ``SITE_LINES`` of them (a page's lines are looked up in its
site's list), and beyond that by a shuffle of line digests.

Edge cases: a null text stays null and counts as a page without lines; a null
host is a site of its own; repeated rows are pages of their own (one page with
``by_text``, as are all null texts of a site); a text whose lines all go
becomes empty (stays as it is with ``keep_whole``); result columns replace input columns of the same
name; an empty table gives an empty result."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_ids, staged

BLANKS = " \t\r"
BROADCAST_LINES = 200_000
SITE_LINES = 1_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    return F.md5(F.btrim(line, F.lit(BLANKS)).cast("binary"))


def _is_line(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(BLANKS))) > 0


def boilerplate(pages: DataFrame, max_ratio: float, min_repeats: int, host_col: str = "host",
                text_col: str = "text", by_text: bool = False) -> DataFrame:
    """(host, line digest, pages with it, pages of the site) of the lines to drop."""
    page = [F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("page")] if by_text else []
    seen = pages.select(F.col(host_col).alias("host"), *page, F.explode(F.array_distinct(
        F.transform(F.filter(_lines(F.col(text_col)), _is_line), _digest))).alias("line"))
    sites = pages.select(F.col(host_col).alias("site"), *page)
    if by_text:
        seen, sites = seen.distinct(), sites.distinct()
    totals = sites.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_repeats)
    return (counts.join(totals, F.col("host").eqNullSafe(F.col("site")))
            .filter(F.col("n") > max_ratio * F.col("total")).select("host", "line", "n", "total"))


def drop_boilerplate(df: DataFrame, host: Column, max_ratio: float = 0.1, min_repeats: int = 3,
                     text_col: str = "text", id_col: str = "doc_id", n_lines: str = "n_lines",
                     n_dropped: str = "n_dropped", broadcast_lines: int = BROADCAST_LINES,
                     by_text: bool = False, keep_whole: bool = False) -> DataFrame:
    """All columns of ``df`` with boilerplate lines removed from ``text_col``,
    plus the number of lines and of dropped lines."""
    pages = df.withColumn("_host", host)
    found = staged(boilerplate(pages, max_ratio, min_repeats, "_host", text_col, by_text), "lines")
    most = found.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("site")).first()
    if (most["all"] or 0) <= broadcast_lines and (most["site"] or 0) <= SITE_LINES:
        return _drop_by_site(df, pages, found, text_col, n_lines, n_dropped, keep_whole)
    return _drop_by_line(df, host, found, text_col, id_col, n_lines, n_dropped, keep_whole)


def _result(df: DataFrame, rows: DataFrame, kept: Column, lines: Column, text_col: str,
            n_lines: str, n_dropped: str, keep_whole: bool) -> DataFrame:
    # higher-order functions would be evaluated once per use: keep them apart
    rows = rows.withColumn("_lines", lines).withColumn("_kept", kept)
    if keep_whole:
        cut = F.size("_kept") < F.size("_lines")
        rows = rows.withColumn("_kept", F.when(cut & ~F.exists("_kept", _is_line), F.col("_lines")).otherwise(F.col("_kept")))
    n = F.coalesce(F.size("_lines"), F.lit(0))
    out = {text_col: F.array_join("_kept", "\n"),
           n_lines: F.when(F.col("_lines").isNull(), 0).otherwise(n).cast("bigint"),
           n_dropped: F.when(F.col("_lines").isNull(), 0).otherwise(n - F.size("_kept")).cast("bigint")}
    return rows.select(*[F.col(c) for c in df.columns if c not in out], *[v.alias(k) for k, v in out.items()])


def _drop_by_site(df, pages, found, text_col, n_lines, n_dropped, keep_whole):
    by_site = found.groupBy(F.col("host").alias("_site")).agg(F.collect_set("line").alias("_bad"))
    rows = pages.join(F.broadcast(by_site), F.col("_host").eqNullSafe(F.col("_site")), "left")
    bad = F.coalesce(F.col("_bad"), F.array().cast("array<string>"))
    kept = F.when(F.size(bad) == 0, F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: ~_is_line(x) | ~F.array_contains(bad, _digest(x))))
    return _result(df, rows, kept, _lines(F.col(text_col)), text_col, n_lines, n_dropped, keep_whole)


def _drop_by_line(df, host, found, text_col, id_col, n_lines, n_dropped, keep_whole):
    rest = [c for c in df.columns if c not in (id_col, "rid")]
    rows = row_ids(df, id_col, rest)
    seen = rows.select("rid", host.alias("_host"), F.posexplode(_lines(F.col(text_col))).alias("_pos", "_text"))
    seen = seen.filter(_is_line(F.col("_text"))).withColumn("_line", _digest(F.col("_text"))).drop("_text")
    hit = seen.join(found, F.col("_host").eqNullSafe(F.col("host")) & (F.col("_line") == F.col("line")), "left_semi")
    gone = hit.groupBy("rid").agg(F.collect_set("_pos").alias("_gone"))
    rows = rows.join(gone, "rid", "left")
    kept = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x, i: ~F.array_contains(F.col("_gone"), i)))
    return _result(df, rows, kept, _lines(F.col(text_col)), text_col, n_lines, n_dropped, keep_whole)
