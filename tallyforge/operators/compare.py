"""Comparing result tables group by group, and checking single ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALUES = ("sum_minor", "purchase_count", "total_revenue", "average_revenue")


def differences(left: DataFrame, right: DataFrame, key: str = "group_key", values: tuple[str, ...] = VALUES, tolerance: float = 0.0) -> DataFrame:
    """Keys that only one table has, or whose values differ: `(key, reason)`; numbers may differ by `tolerance`."""
    a, b = left.select(key, F.struct(*values).alias("l")), right.select(key, F.struct(*values).alias("r"))
    both = a.join(b, key, "full_outer")
    same = F.lit(True)
    for v in values:
        x, y = F.col(f"l.{v}"), F.col(f"r.{v}")
        same = same & (x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)) if tolerance else x.eqNullSafe(y))
    reason = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(~same, "values_differ")
    return both.select(key, reason.alias("reason")).where("reason is not null")


def parity(left: DataFrame, right: DataFrame, key: str = "group_key", values: tuple[str, ...] = VALUES) -> DataFrame:
    """One row: groups of either side, and how many are on one side only or differ."""
    found = differences(left, right, key, values).agg(*[F.count_if(F.col("reason") == r).alias(r) for r in ("only_left", "only_right", "values_differ")])
    return left.agg(F.count("*").alias("left_groups")).crossJoin(right.agg(F.count("*").alias("right_groups"))).crossJoin(found)


def first_differences(left: DataFrame, right: DataFrame, n: int = 50, **how) -> DataFrame:
    key = how.get("key", "group_key")
    return differences(left, right, **how).orderBy(key).limit(n)


def validate(revenues: DataFrame, expected_purchases: int | None = None) -> DataFrame:
    """One row of totals of a result; raises on repeated groups or another number of purchases than expected."""
    row = revenues.agg(F.count("*").alias("n_groups"), F.count_distinct("group_key").alias("n_keys"), F.sum("purchase_count").alias("purchases"), F.sum("sum_minor").alias("sum_minor"))
    sound = F.col("n_groups") == F.col("n_keys")
    if expected_purchases is not None:
        sound = sound & (F.coalesce("purchases", F.lit(0)) == expected_purchases)
    return row.where(F.assert_true(sound, F.lit("the result is not valid")).isNull())


def looked_up(rows: DataFrame, dictionary: DataFrame, key: str = "group_key") -> DataFrame:
    """Rows with the dense id of their key; a key that the dictionary lacks raises."""
    joined = rows.join(dictionary.select(key, "dense_id"), key, "left")
    return joined.where(F.assert_true(F.col("dense_id").isNotNull(), F.lit("a key is missing in the dictionary")).isNull())


def missing_keys(rows: DataFrame, dictionary: DataFrame, key: str = "group_key") -> DataFrame:
    return rows.select(key).distinct().join(dictionary.select(key), key, "left_anti")
