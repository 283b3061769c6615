"""Line dedup: boilerplate by its frequency among a site's pages, in DataFrame functions alone.

For every site (host) the pages that hold a line are counted and divided by the site's pages; lines
above a ratio are boilerplate and are cut from all pages of that site.

Defined cases: a null text stays null and counts as a page without lines; blank lines are never
boilerplate; a page counts once for a line that it repeats; rows without a site are left alone;
repeated rows count as pages of their own; other columns stay as they are, whatever their names; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Written, whole_row, with_text

#: A line on more than this share of a site's pages is boilerplate, if on LEAST pages or more.
RATIO = 0.1
LEAST = 3


def mark(line: Column) -> Column:
    """96 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def blank(line: Column) -> Column:
    return F.translate(line, " \t\n\x0b\x0c\r", "") == ""


def boilerplate(pages: DataFrame, site: str, text: str, ratio: float = RATIO, least: int = LEAST, written: Written | None = None) -> DataFrame:
    """site, lines (array of marks): what to cut from that site's pages.

    Counting combines on the map side, so a site with a third of all rows is summed where it is
    read. A site's array holds at most (lines of a page on average) / ratio marks, whatever its size.
    """
    written = written or Written(pages.sparkSession)
    known = pages.where(F.col(f"`{site}`").isNotNull()).select(F.col(f"`{site}`").alias("site"), F.col(f"`{text}`").cast("string").alias("t"))
    totals = written(known.groupBy("site").agg(F.count("*").alias("n_pages")))
    each = F.explode(F.array_distinct(F.filter(F.split("t", "\n"), lambda x: ~blank(x))))
    counts = (
        known.select("site", each.alias("line"))
        .select("site", mark(F.col("line")).alias("m"))
        .groupBy("site", F.col("m.h").alias("h"), F.col("m.g").alias("g"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least)
    )
    frequent = counts.join(totals, "site").where(F.col("n") > F.col("n_pages") * F.lit(ratio))
    return frequent.groupBy("site").agg(F.collect_list(F.struct("h", "g")).alias("lines"))


def cut_pages(pages: DataFrame, site: str, text: str, ratio: float, least: int) -> DataFrame:
    """row (a page's columns), t (its text), __all and __left: its lines, and those that stay.

    The table of boilerplate is written first, so whether it is sent to all executors is decided by
    its size on disk; if it is too large for that, pages meet it in a join that AQE splits by skew.
    """
    written = Written(pages.sparkSession)
    found = written(boilerplate(pages, site, text, ratio, least, written))
    found = found.select(F.col("site").alias("__site"), F.col("lines").alias("__marks"))
    given = pages.select(whole_row(pages), F.col(f"`{site}`").alias("site"), F.col(f"`{text}`").cast("string").alias("t"))
    joined = given.join(found, F.col("site") == F.col("__site"), "left").withColumn("__all", F.split("t", "\n"))
    left = F.filter("__all", lambda x: blank(x) | ~F.array_contains(F.col("__marks"), mark(x)))
    return joined.withColumn("__left", F.when(F.col("__marks").isNotNull(), left).otherwise(F.col("__all")))


def without_boilerplate(
    pages: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST, length: str | None = None
) -> DataFrame:
    """The columns of ``pages``, whatever their names, with ``text`` cut; ``length`` names a column that
    holds a text's characters, which is counted anew where lines went."""
    joined = cut_pages(pages, site, text, ratio, least)
    cut = F.coalesce(F.size("__left") < F.size("__all"), F.lit(False))
    return joined.select(*with_text(pages, F.array_join("__left", "\n"), cut, text, length))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_lines, n_cut and the text left of every document."""
    docs = docs.select("doc_id", "source", "text")
    joined = cut_pages(docs, "source", "text", RATIO, LEAST)
    n, left = F.size("__all"), F.size("__left")
    counts = [F.when(F.col("t").isNull(), 0).otherwise(c).cast("long").alias(name) for c, name in ((n, "n_lines"), (n - left, "n_cut"))]
    text = F.when(left < n, F.array_join("__left", "\n")).otherwise(F.col("t"))
    return joined.select("row.doc_id", "row.source", *counts, text.alias("text"))


def oracle(ratio: float = RATIO, least: int = LEAST) -> str:
    """SQL for the rows of ``dedup``."""
    return f"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents
), l AS (
    SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d
), seen AS (
    SELECT source, line, count(DISTINCT rid) AS n FROM l
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') AND source IS NOT NULL GROUP BY source, line
), bad AS (
    SELECT seen.source, line FROM seen
    JOIN (SELECT source, count(*) AS pages FROM d GROUP BY source) p ON p.source = seen.source
    WHERE n >= {least} AND n > pages * {ratio}
), per AS (
    SELECT rid, count(*) AS n_lines, count(*) FILTER (bad.line IS NOT NULL) AS n_cut,
        coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (bad.line IS NULL), '') AS cut
    FROM l LEFT JOIN bad ON bad.source = l.source AND bad.line = l.line GROUP BY rid
)
SELECT doc_id, source, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_cut, 0)::BIGINT AS n_cut,
    CASE WHEN text IS NULL THEN NULL ELSE cut END AS text
FROM d LEFT JOIN per USING (rid)"""
