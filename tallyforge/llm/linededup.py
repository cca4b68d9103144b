"""Boilerplate lines by site-relative frequency: a line that many pages of one host share is dropped from them.

Only column expressions and joins. A line's pages are counted with partial aggregates, whatever the host's size; what is
joined back is the small table of boilerplate lines, as one array a host or, if that table is large, a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import durable

#: Share of its host's pages above which a line is boilerplate.
RATIO = 0.05
#: Boilerplate lines (32 bytes each) that may be broadcast; more are joined page by page, each page's copies over SALTS tasks.
BROADCAST_LINES, SALTS = 200_000, 16
_SPACE = " \t\r"


def _key(*columns: Column) -> Column:
    """Two independent 64-bit hashes, which stand for long keys in shuffles."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("second"), *columns).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_key(line: Column) -> Column:
    return F.md5(F.trim(line, F.lit(_SPACE)))


def _distinct_lines(text: Column) -> Column:
    """Keys of the different lines of a text that aren't blank."""
    shown = F.filter(F.transform(_lines(text), lambda x: F.trim(x, F.lit(_SPACE))), lambda x: x != "")
    return F.transform(F.array_distinct(shown), F.md5)


def boilerplate_lines(pages: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO) -> DataFrame:
    """The lines that exceed the ratio: `(site, line, n_pages, site_pages)`, lines as MD5.

    A line's frequency is the pages of the host that hold it over all pages of the host; every row is a page, copies
    too. A line counts once a page, without spaces, tabs and CR around it; blank lines don't count. A line of a
    single page is shared by none and is never boilerplate.
    """
    rows = pages.where(F.col(host_col).isNotNull()).select(F.col(host_col).alias("site"), F.col(text_col).alias("text"))
    totals = rows.groupBy("site").agg(F.count("*").alias("site_pages"))
    counted = rows.select("site", F.explode(_distinct_lines(F.col("text"))).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n_pages"))
    return counted.where("n_pages > 1").join(totals, "site").where(F.col("n_pages") > F.lit(ratio) * F.col("site_pages"))


def _drops_by_page(pages: DataFrame, boiler: DataFrame, text: Column, host: Column) -> DataFrame:
    """`pages` with `_tf_drop`, the boilerplate lines it holds: a join by page, for a large table of lines."""
    page = _key(host, text)
    held = pages.where(host.isNotNull()).select(host.alias("site"), page.alias("_tf_page"), F.explode(_distinct_lines(text)).alias("line"))
    drops = held.join(boiler, ["site", "line"]).groupBy("_tf_page").agg(F.collect_set("line").alias("_tf_drop"))
    salted = drops.withColumn("_tf_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumns({"_tf_page": page, "_tf_salt": F.spark_partition_id() % SALTS}).join(salted, ["_tf_page", "_tf_salt"], "left")


def drop_boilerplate(pages: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO) -> DataFrame:
    """`pages` with the boilerplate lines of its host taken out of each text, and their number as `dropped_lines`.

    Every row and column is kept (a column `dropped_lines` is replaced); a text of boilerplate alone becomes empty.
    Rows with a null host and null texts stay as they are. A page loses every occurrence of a boilerplate line. The
    single page of a host loses nothing. Ties with the ratio stay. An empty table gives an empty table.
    """
    text, host = F.col(text_col), F.col(host_col)
    boiler = durable(boilerplate_lines(pages, text_col, host_col, ratio).select("site", "line"))
    if boiler.count() <= BROADCAST_LINES:
        by_site = boiler.groupBy(F.col("site").alias("_tf_site")).agg(F.collect_set("line").alias("_tf_lines"))
        marked = pages.join(F.broadcast(by_site), host == F.col("_tf_site"), "left")
        marked = marked.withColumn("_tf_drop", F.when(F.col("_tf_lines").isNotNull(), F.array_intersect(_distinct_lines(text), "_tf_lines")))
    else:
        marked = _drops_by_page(pages, boiler, text, host)
    some = F.coalesce(F.size("_tf_drop") > 0, F.lit(False))
    kept = F.filter(_lines(text), lambda x: ~F.array_contains(F.col("_tf_drop"), _line_key(x)))
    out = marked.withColumn("_tf_kept", F.when(some, kept))
    rest = F.when(some, F.array_join("_tf_kept", "\n")).otherwise(text)
    dropped = F.when(some, F.size(_lines(text)) - F.size("_tf_kept")).otherwise(F.lit(0))
    columns = [c for c in pages.columns if c != "dropped_lines"]
    return out.select(*[rest.alias(c) if c == text_col else F.col(c) for c in columns], dropped.cast("long").alias("dropped_lines"))
