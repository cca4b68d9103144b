"""Funnels and trends over curated events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.functions.numbering import numbered
from tallyforge.functions.tables import durable

KINDS = {"views": "view", "carts": "cart", "removes": "remove_from_cart", "purchases": "purchase"}


def counters() -> list[Column]:
    """Events, events of each type, and revenue in cents."""
    kind = F.col("event_type")
    out = [F.count("*").alias("events")]
    out += [F.count_if(kind == value).alias(name) for name, value in KINDS.items()]
    return [*out, F.coalesce(F.sum(F.when(kind == "purchase", F.col("price_minor"))), F.lit(0)).alias("revenue_minor")]


def _with_ratios(table: DataFrame) -> DataFrame:
    return table.withColumns({"view_to_purchase": S.ratio("purchases", "views"), "cart_to_purchase": S.ratio("purchases", "carts")})


def funnel_by_category(events: DataFrame) -> DataFrame:
    known = events.where(F.col("category_id").isNotNull())
    sums = known.groupBy("category_id").agg(*counters(), F.max("category_code").alias("category_code"), F.count_distinct("category_code").alias("distinct_codes"))
    return _with_ratios(sums)


def funnel_by_brand(events: DataFrame) -> DataFrame:
    return _with_ratios(events.groupBy(S.or_unknown("brand").alias("brand")).agg(*counters()))


def trend_by_hour(events: DataFrame) -> DataFrame:
    return events.groupBy("event_date", "event_hour").agg(*counters(), F.count_distinct("user_id").alias("distinct_users"))


def hourly_sets(events: DataFrame) -> DataFrame:
    """`(event_date, event_hour, bucket, users, counters)`: what hours hold, in a form that any roll-up can be made from.

    Events are read once and added up by hour and user. Users get dense numbers, and each hour keeps its users as bits in
    buckets of 32,768 numbers, so that sets of hours merge exactly. Null users are counted as events, not as users.
    """
    by_user = durable(events.groupBy("event_date", "event_hour", "user_id").agg(*counters()))
    users = durable(numbered(by_user.select("user_id").where("user_id is not null").distinct(), "user_id", name="number"))
    marked = by_user.join(users.withColumn("number", F.col("number") + 1), "user_id", "left")
    bucket = F.coalesce(F.bitmap_bucket_number("number"), F.lit(0).cast("long")).alias("bucket")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("users")
    return durable(marked.groupBy("event_date", "event_hour", bucket).agg(bits, *[F.sum(c).alias(c) for c in by_user.columns[3:]]))


def rolled_up(sets: DataFrame, *keys: str) -> DataFrame:
    """Counters and exact distinct users by `keys`, from the sets of hours alone."""
    added = [c for c in sets.columns if c not in ("event_date", "event_hour", "bucket", "users")]
    merged = sets.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("users").alias("users"), *[F.sum(c).alias(c) for c in added])
    return merged.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in added], F.sum(F.bitmap_count("users")).alias("distinct_users"))


def trend_by_day(events: DataFrame) -> DataFrame:
    """Days rolled up from hours, distinct users included."""
    return rolled_up(hourly_sets(events), "event_date")


def totals_check(events: DataFrame, funnel: DataFrame, revenues: DataFrame) -> DataFrame:
    """One row of totals that must agree: input events, funnel events, and purchases counted twice."""
    known = F.col("category_id").isNotNull()
    left = events.agg(F.count_if(known).alias("input_events"))
    mid = funnel.agg(F.sum("events").alias("funnel_events"), F.sum("purchases").alias("funnel_purchases"), F.sum("revenue_minor").alias("funnel_revenue"))
    right = revenues.agg(F.sum("purchase_count").alias("revenue_purchases"), F.sum("sum_minor").alias("revenue_minor"))
    row = left.crossJoin(mid).crossJoin(right)
    sound = (F.col("input_events") == F.col("funnel_events")) & (F.col("funnel_purchases") == F.col("revenue_purchases")) & (F.col("funnel_revenue") == F.col("revenue_minor"))
    return row.where(F.assert_true(F.coalesce(sound, F.lit(True)), F.lit("totals differ")).isNull())


def session_purchase_rate(events: DataFrame) -> DataFrame:
    """Per category root: sessions, sessions with a purchase, and their ratio."""
    root = S.or_unknown(S.category_root("category_code"))
    sessions = events.where(F.col("user_session").isNotNull()).groupBy("user_session", root.alias("category_root")).agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"))
    out = sessions.groupBy("category_root").agg(F.count("*").alias("sessions"), F.sum("bought").alias("buying_sessions"))
    return out.withColumn("purchase_rate", S.ratio("buying_sessions", "sessions"))


def top_brands(events: DataFrame, n: int = 10) -> DataFrame:
    """The funnel of the n brands of most revenue, and of all others together as `__OTHER__`."""
    brands = funnel_by_brand(events).drop("view_to_purchase", "cart_to_purchase")
    rank = F.row_number().over(Window.orderBy(F.desc("revenue_minor"), "brand"))
    leaders = brands.select("brand", "revenue_minor").orderBy(F.desc("revenue_minor"), "brand").limit(n).withColumn("place", rank).drop("revenue_minor")
    named = brands.join(F.broadcast(leaders), "brand", "left")
    key = F.when(F.col("place").isNotNull(), F.col("brand")).otherwise(F.lit("__OTHER__"))
    columns = ["events", *KINDS, "revenue_minor"]
    return _with_ratios(named.groupBy(key.alias("brand")).agg(*[F.sum(c).alias(c) for c in columns]))
