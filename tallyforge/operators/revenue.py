"""Exact revenue by group: integer sums, one division at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S

from .classify import classify_purchases


def _finished(keyed: DataFrame) -> DataFrame:
    """`(group_key, price_minor)` rows summed; a sum beyond 64 bits raises under ANSI arithmetic."""
    sums = keyed.groupBy("group_key").agg(F.sum("price_minor").alias("sum_minor"), F.count("*").alias("purchase_count"))
    return sums.select(
        "group_key", "sum_minor", "purchase_count", S.money_text("sum_minor").alias("total_revenue"), S.money_text(S.average_minor("sum_minor", "purchase_count")).alias("average_revenue")
    )


def revenue_from_lines(lines: DataFrame, mode: str = "category_id", line_col: str = "value") -> DataFrame:
    """Revenue of the valid purchases among raw lines."""
    valid = classify_purchases(lines, mode, line_col).where("reason = 'VALID_PURCHASE'")
    return _finished(valid.select("group_key", "price_minor"))


def revenue(events: DataFrame, mode: str = "category_id") -> DataFrame:
    """Revenue of the purchases among curated events; by category id, all purchases that have one."""
    bought = events.where(F.col("event_type") == "purchase")
    key = F.col("category_id") if mode == "category_id" else S.group_key(mode, "category_id", "category_code")
    return _finished(bought.select(key.alias("group_key"), "price_minor").where(F.col("group_key").isNotNull()))


def with_codes(revenues: DataFrame, funnel: DataFrame) -> DataFrame:
    """Revenue by category id with the category's code beside it; the code table is one row a category.

    Merged, not broadcast: a hash table of texts takes a whole page of memory (up to 64 MB) however few they are.
    """
    codes = funnel.select(F.col("category_id").alias("group_key"), "category_code")
    return revenues.join(codes.hint("merge"), "group_key", "left")


def ordered(table: DataFrame, *keys: str) -> DataFrame:
    """The table in total order of its keys."""
    return table.orderBy(*keys)
