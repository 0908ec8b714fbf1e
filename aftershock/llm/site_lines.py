"""Boilerplate lines by how many pages of their site hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.llm.shared import copies, salt, stored

# Shares of a site's pages that make a line boilerplate, of ordinary lines and of those of many words, which
# hardly repeat by chance; and the pages that have to hold it at least.
MAX_RATIO = 0.005
LONG_RATIO = 0.001
LONG_WORDS = 50
LEAST_HOLDERS = 3
# Percent of its characters that a page may lose.
MOST = 50
SALTS = 16


def line_digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def is_long(line: Column, words: int = LONG_WORDS) -> Column:
    """Whether a line has ``words`` words, told by the blanks inside it."""
    inner = F.trim(line)
    return F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit(""))) >= words - 1


def host_of(url: Column) -> Column:
    """What stands between ``://`` and the path, in lower case; empty where there is no such thing."""
    return F.lower(F.regexp_extract(url, "://([^/?#]*)", 1))


def drop_site_lines(
    docs: DataFrame,
    site: str | Column = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    long_ratio: float = LONG_RATIO,
    least_holders: int = LEAST_HOLDERS,
) -> DataFrame:
    """Drop lines that more than ``max_ratio`` of the pages of their site hold.

    Adds ``lines`` and ``dropped`` (long) to the columns and replaces the text. ``site`` is a column or an
    expression, such as :func:`host_of` a URL. Lines of many words (:func:`is_long`) go from a share of
    ``long_ratio`` on. At least ``least_holders`` pages have to hold a line, whatever the size of the site.

    A page is a different text of a site: whole copies of a page count once, or a page copied
    often would lose every line. A page that would lose more than half of its characters (blank
    lines aside) keeps all lines: it is not text with boilerplate but one of many near copies, or
    nothing else. Blank lines stay.

    A NULL site is the empty site. A NULL text stays NULL, with no lines; an empty text has
    one blank line. Repeated rows are treated alike. Column names of the input cannot clash,
    as rows travel in a struct.

    Only digests of lines are counted and joined. Counts combine on the map side; a site or a
    line that owns much of the rows is spread by salts, copies of a page by their place.
    """
    site = F.coalesce((F.col(site) if isinstance(site, str) else site).cast("string"), F.lit(""))
    row = docs.select(
        F.struct("*").alias("row"),
        site.alias("site"),
        line_digest(F.col(text)).alias("page"),
    )
    lines = F.filter(F.split(F.col("body"), "\n", -1), lambda x: F.trim(x) != "")
    pages = docs.select(
        site.alias("site"),
        line_digest(F.col(text)).alias("page"),
        F.col(text).alias("body"),
    ).filter("page IS NOT NULL")
    held = F.transform(lines, lambda x: F.struct(line_digest(x).alias("line"), is_long(x).alias("long")))
    pages = pages.select("site", "page", F.array_distinct(held).alias("held"))
    pages = stored(pages.groupBy("site", "page").agg(F.first("held").alias("held")))

    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    held = pages.select("site", "page", F.inline("held"))
    counts = held.groupBy("site", "line", "long").agg(F.count(F.lit(1)).alias("holders"))
    ratio = F.when(F.col("long"), long_ratio).otherwise(max_ratio)
    common = (
        counts.filter(F.col("holders") >= least_holders)
        .withColumn("salt", salt(F.col("line"), SALTS))
        .join(copies(totals, SALTS), ["site", "salt"])
        .filter(F.col("holders") > ratio * F.col("pages"))
        .select("site", "line")
    )
    common = stored(common)
    hits = held.withColumn("salt", salt(F.col("page"), SALTS)).join(copies(common, SALTS), ["site", "line", "salt"])
    unwanted = stored(hits.groupBy("site", "page").agg(F.collect_set("line").alias("unwanted")))

    # A page that owns many rows is spread whatever its keys are.
    place = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    marked = row.withColumn("salt", place).join(copies(unwanted, SALTS), ["site", "page", "salt"], "left")
    all_lines = F.split(F.col(f"row.{text}"), "\n", -1)
    marked = marked.withColumn("kept", F.filter(all_lines, lambda x: ~F.array_contains("unwanted", line_digest(x))))
    mostly = 100 * _characters(F.col("kept")) < (100 - MOST) * _characters(all_lines)
    whole = F.col("unwanted").isNull() | mostly
    new_text = F.when(whole, F.col(f"row.{text}")).otherwise(F.array_join("kept", "\n"))
    n_lines = F.when(F.col("page").isNull(), 0).otherwise(F.size(all_lines)).cast("long")
    n_kept = F.when(whole, n_lines).otherwise(F.size("kept").cast("long"))
    others = [F.col(f"row.{c}").alias(c) for c in docs.columns if c not in (text, "lines", "dropped")]
    return marked.select(*others, new_text.alias(text), n_lines.alias("lines"), (n_lines - n_kept).alias("dropped"))


def _characters(lines: Column) -> Column:
    """Characters of the lines that are not blank."""
    size = lambda total, x: total + F.when(F.trim(x) == "", 0).otherwise(F.length(x))
    return F.aggregate(lines, F.lit(0).cast("long"), lambda total, x: size(total, x).cast("long"))
