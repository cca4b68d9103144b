"""Data-quality reports over curated events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_COLUMNS = ("event_time", "event_type", "product_id", "category_id", "category_code", "brand", "price_minor", "user_id", "user_session")
DISTINCTS = ("product_id", "category_id", "category_code", "brand", "user_id", "user_session")


def profile(events: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: rows, first and last time, nulls, zero prices and distinct values (exact unless `approximate`).

    Exact distinct counts take one narrow pass of (column, hash) pairs, not a copy of every row for each column.
    """
    simple = [
        F.count("*").alias("n_rows"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("category_id", "category_code", "brand", "user_session")],
        F.count_if(F.col("price_minor") == 0).alias("zero_prices"),
    ]
    if approximate:
        return events.agg(*simple, *[F.approx_count_distinct(F.col(c)).alias(f"distinct_{c}") for c in DISTINCTS])
    pair = lambda k, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("k"), F.xxhash64(c).alias("a"), F.xxhash64(c, F.lit(k)).alias("b")))
    values = events.select(F.explode(F.array_compact(F.array(*[pair(k, c) for k, c in enumerate(DISTINCTS)]))).alias("v")).select("v.*").distinct()
    counts = values.agg(*[F.count_if(F.col("k") == k).alias(f"distinct_{c}") for k, c in enumerate(DISTINCTS)])
    return events.agg(*simple).crossJoin(F.broadcast(counts))


def events_per_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n_events"))


def zero_price_purchases(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if((F.col("event_type") == "purchase") & (F.col("price_minor") == 0)).alias("zero_price_purchases"))


def ambiguous_categories(events: DataFrame) -> DataFrame:
    """How many category ids come with more than one code."""
    codes = events.groupBy("category_id").agg(F.count_distinct("category_code").alias("n"))
    return codes.agg(F.count_if((F.col("n") > 1) & F.col("category_id").isNotNull()).alias("ambiguous_categories"))


def duplicates(events: DataFrame, columns: tuple[str, ...] = EVENT_COLUMNS) -> DataFrame:
    """Groups of rows equal in all columns, and the rows beyond the first of each."""
    groups = events.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def conservation(parsed: DataFrame, written: DataFrame) -> DataFrame:
    """One row: lines in, accepted, rejected, written; raises if a line is lost on the way."""
    counts = parsed.agg(F.count("*").alias("lines_in"), F.count_if(F.col("reject_reason").isNull()).alias("accepted"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"))
    out = counts.crossJoin(written.agg(F.count("*").alias("written")))
    sound = (F.col("lines_in") == F.col("accepted") + F.col("rejected")) & (F.col("accepted") == F.col("written"))
    return out.where(F.assert_true(sound, F.lit("rows were lost")).isNull())
