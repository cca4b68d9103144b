"""Small ordered views of result tables: pages, lookups and leaders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 5000


def containing(table: DataFrame, text: str) -> DataFrame:
    """Rows of which some column contains the text, whatever the case."""
    hits = [F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())) for c in table.columns]
    return table.where(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))


def page(table: DataFrame, sort: str, descending: bool = False, offset: int = 0, limit: int = 50, text: str | None = None, key: str | None = None) -> DataFrame:
    """A page of a table, sorted as numbers where the values are numbers, blanks lowest; `key` breaks ties."""
    if not 0 < limit <= MAX_PAGE or offset < 0:
        raise ValueError("limit must be 1..5000 and offset not negative")
    rows = containing(table, text) if text else table
    as_text = F.coalesce(F.col(sort).cast("string"), F.lit(""))
    order = [as_text.try_cast("double"), as_text]
    order = [o.desc_nulls_last() if descending else o.asc_nulls_first() for o in order]
    return rows.orderBy(*order, *([key] if key else [])).offset(offset).limit(limit)


def page_total(table: DataFrame, text: str | None = None) -> DataFrame:
    return (containing(table, text) if text else table).agg(F.count("*").alias("total"))


def leaders(table: DataFrame, by: str, key: str, n: int = 15) -> DataFrame:
    """The n rows of the greatest `by`, ties in order of key."""
    return table.orderBy(F.desc(by), key).limit(n)


def find_products(products: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Products whose id, brand or category contains the text, in order of id."""
    sought = F.lit(text.lower())
    hit = [F.coalesce(F.contains(F.lower(c), sought), F.lit(False)) for c in ("product_id", "brand", "category_code")]
    return products.where(hit[0] | hit[1] | hit[2]).orderBy("product_id").limit(limit)
