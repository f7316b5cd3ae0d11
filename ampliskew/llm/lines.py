"""Op 8: lines that repeat over the pages of a site, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, written

#: Boilerplate lines (16-byte hashes with their site) up to which they are broadcast; beyond it the join is shuffled.
BROADCAST_LINES = 200_000
#: Parts a site's boilerplate is copied to where it is shuffled, so that a hot site meets in many tasks.
SALTS = 64


def line_hashes(text: Column) -> Column:
    """128-bit keys of the lines, in order; blank lines are null."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(F.trim(x) != "", F.concat(F.hex(F.xxhash64(x)), F.hex(F.xxhash64(x, F.lit(1))))))


def boilerplate(docs: DataFrame, site_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """site, lines (array of line keys): lines on over ``ratio`` of the site's pages and on ``min_pages`` at least.

    Pages of a site with the same set of lines count once, so a page that is merely copied isn't boilerplate. Counts are
    combined before the shuffle; a site has at most (mean lines a page / ratio) such lines.
    """
    lines = F.sort_array(F.array_distinct(F.array_compact(line_hashes(F.coalesce(col(text_col).cast("string"), F.lit(""))))))
    pages = docs.select(col(site_col).cast("string").alias("site"), lines.alias("lines")).distinct()
    pages = written(pages, "distinct-pages")
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    counts = pages.select("site", F.explode("lines").alias("line")).groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = totals.withColumnRenamed("site", "_site")
    found = counts.join(totals, counts["site"].eqNullSafe(totals["_site"])).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return found.groupBy("site").agg(F.collect_list("line").alias("lines"))


def drop_lines(docs: DataFrame, ratio: float = 0.08, min_pages: int = 5, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with the text less its site's boilerplate lines, and n_lines, n_dropped (names by ``fresh`` where taken).

    Lines are parted by line feeds and compared as they are; blank lines are never boilerplate. A null site is a site of
    its own. A null text stays null (0 lines), an empty one has one line; a text that loses all lines becomes empty.
    Repeated rows and ids don't matter, an empty table gives an empty one.
    """
    found = written(boilerplate(docs, site_col, text_col, ratio, min_pages), "boilerplate")
    site, lines, salt, n_lines, n_dropped, hashes = fresh(docs, "site", "lines", "salt", "n_lines", "n_dropped", "hashes")
    found = found.select(F.col("site").alias(site), F.col("lines").alias(lines))
    if (found.agg(F.sum(F.size(lines))).first()[0] or 0) <= BROADCAST_LINES:
        out = docs.join(F.broadcast(found), col(site_col).cast("string").eqNullSafe(col(site)), "left")
    else:
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(col(text_col)), F.lit(SALTS)))
        found = found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(found, col(site_col).cast("string").eqNullSafe(col(site)) & (col(salt) == F.col("_part")), "left")
    text = F.split(col(text_col), "\n", -1)
    keep = F.filter(F.arrays_zip(text.alias("line"), line_hashes(col(text_col)).alias("key")), lambda x: x["key"].isNull() | ~F.array_contains(col(lines), x["key"]))
    kept = F.when(col(lines).isNull(), text).otherwise(F.transform(keep, lambda x: x["line"]))
    out = out.select(*map(col, docs.columns), kept.alias(hashes))
    size = F.when(col(text_col).isNull(), 0).otherwise(F.size(F.split(col(text_col), "\n", -1))).cast("long")
    left = F.when(col(text_col).isNull(), 0).otherwise(F.size(col(hashes))).cast("long")
    new = F.when(col(text_col).isNotNull(), F.array_join(col(hashes), "\n"))
    return out.select(*(new.alias(c) if c == text_col else col(c) for c in docs.columns), size.alias(n_lines), (size - left).alias(n_dropped))


OP8_SQL = """
WITH l AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), pages AS (SELECT DISTINCT source, list_sort(list_distinct(list_filter(ls, lambda x: trim(x, ' ') <> ''))) AS s FROM l
), totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source
), bad AS (
  SELECT c.source, line FROM (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(s) AS line FROM pages) GROUP BY source, line) c JOIN totals t ON c.source = t.source
  WHERE n >= 5 AND n > 0.08 * pages
), per AS (SELECT source, list(line) AS lines FROM bad GROUP BY source
), kept AS (
  SELECT doc_id, ls, CASE WHEN per.lines IS NULL THEN ls ELSE list_filter(ls, lambda x: trim(x, ' ') = '' OR NOT list_contains(per.lines, x)) END AS k
  FROM l LEFT JOIN per ON l.source = per.source
)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(k) AS BIGINT) AS n_dropped, array_to_string(k, chr(10)) AS text FROM kept
"""
