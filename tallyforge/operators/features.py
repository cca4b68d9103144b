"""Product features and time-based labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S

from .metrics import KINDS

DESCRIPTIONS = ("category_id", "category_code", "category_root", "brand")


def product_stats(events: DataFrame, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Per product: counts by type, revenue, distinct users, median price and descriptions."""
    kind = F.col("event_type")
    rows = events.withColumn("category_root", S.category_root("category_code"))
    return rows.groupBy(*keys).agg(
        *[F.count_if(kind == KINDS[c]).alias(c) for c in ("views", "carts", "purchases")],
        F.coalesce(F.sum(F.when(kind == "purchase", F.col("price_minor"))), F.lit(0)).alias("revenue_minor"),
        F.count_distinct("user_id").alias("distinct_users"),
        (F.percentile_approx("price_minor", 0.5, 10_000) / 100).alias("median_price"),
        *[F.max(c).alias(c) for c in DESCRIPTIONS if c not in keys],
    )


def with_features(stats: DataFrame, min_views: int) -> DataFrame:
    """The products with enough views, with their features."""
    return stats.where(F.col("views") >= min_views).withColumns(S.feature_columns())


def quantiles(table: DataFrame, column: str, points: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99), accuracy: int = 10_000) -> DataFrame:
    """`(q, value)` of one column."""
    found = table.agg(F.percentile_approx(column, list(points), accuracy).alias("v"))
    return found.select(F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in points]).alias("q"), F.col("v").alias("value"))).alias("x")).select("x.q", "x.value")


def describe(table: DataFrame, columns: tuple[str, ...] = S.FEATURES) -> DataFrame:
    """A row a column: count, mean, standard deviation, least and greatest."""
    stats = table.agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("greatest")).alias(c) for c in columns])
    named = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in columns])
    return stats.select(F.explode(named).alias("x")).select("x.feature", "x.s.*")


def kept_counts(featured: DataFrame) -> DataFrame:
    return featured.agg(F.count("*").alias("kept"), F.count_if(F.col("category_code").isNotNull()).alias("with_code"), F.count_if(F.col("purchases") > 0).alias("with_purchase"))


def between(events: DataFrame, start: str, end: str) -> DataFrame:
    """Events of [start, end), dates as text; the date column is filtered too, so that partitions are pruned."""
    in_time = (F.col("event_time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("event_time") < F.lit(end).cast("timestamp_ntz"))
    return events.where(in_time & (F.col("event_date") >= F.lit(start).cast("date")) & (F.col("event_date") < F.lit(end).cast("date")))


def _shift(day: str, days: int) -> str:
    import datetime as dt

    return (dt.date.fromisoformat(day) + dt.timedelta(days=days)).isoformat()


def recent_views(events: DataFrame, t0: str, days: int, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Views per product in the days before t0."""
    return between(events, _shift(t0, -days), t0).where("event_type = 'view'").groupBy(*keys).agg(F.count("*").alias("recent_views"))


def future_purchases(events: DataFrame, t0: str, days: int, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Purchases per product in the days from t0 on."""
    return between(events, t0, _shift(t0, days)).groupBy(*keys).agg(F.count_if(F.col("event_type") == "purchase").alias("future_purchases"))


def coverage(events: DataFrame, t0: str, feature_days: int, label_days: int) -> DataFrame:
    """One row of what the two windows hold; raises where data do not cover them to the last day."""
    seen = events.agg(F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))
    fine = (F.col("first_date") <= F.lit(_shift(t0, -feature_days)).cast("date")) & (F.col("last_date") >= F.lit(_shift(t0, label_days - 1)).cast("date"))
    known = between(events, _shift(t0, -feature_days), t0).agg(F.count("*").alias("feature_events"), F.max("event_time").alias("last_feature_time"))
    future = between(events, t0, _shift(t0, label_days)).agg(F.count("*").alias("label_events"), F.min("event_time").alias("first_label_time"))
    row = seen.crossJoin(known).crossJoin(future)
    return row.where(F.assert_true(F.coalesce(fine, F.lit(False)), F.lit("a window is not covered by data")).isNull())


def snapshot(events: DataFrame, t0: str, feature_days: int, label_days: int, min_views: int, split: str, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Features from the days before t0 and the label from the days after: does the product sell?

    The counts of both windows are merged: all are dealt by the same keys, and a hash table of them is many times their shuffled size.
    """
    stats = product_stats(between(events, _shift(t0, -feature_days), t0), keys)
    seen = stats.join(recent_views(events, t0, label_days, keys).hint("merge"), list(keys), "left").na.fill(0, ["recent_views"])
    featured = with_features(seen, min_views).withColumn("recent_view_share", F.col("recent_views") / F.col("views"))
    out = featured.join(future_purchases(events, t0, label_days, keys).hint("merge"), list(keys), "left").na.fill(0, ["future_purchases"])
    return out.withColumns({"label": (F.col("future_purchases") > 0).cast("int"), "split": F.lit(split), "t0": F.lit(t0)})


def label_table(events: DataFrame, train_t0: str, test_t0: str, feature_days: int, label_days: int, min_views: int, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Train and test snapshots together; the test must start after the train labels end."""
    if test_t0 < _shift(train_t0, label_days):
        raise ValueError("the test snapshot overlaps the labels of the train snapshot")
    parts = [snapshot(events, t, feature_days, label_days, min_views, s, keys) for t, s in ((train_t0, "train"), (test_t0, "test"))]
    return parts[0].unionByName(parts[1])


def class_balance(labelled: DataFrame) -> DataFrame:
    out = labelled.groupBy("split").agg(F.count("*").alias("n_rows"), F.sum("label").alias("positives"))
    return out.withColumn("rate", S.ratio("positives", "n_rows"))
