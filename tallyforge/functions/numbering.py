"""Row numbers and running sums in a total order without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import durable


def numbered(rows: DataFrame, *order: Column | str, name: str = "row") -> DataFrame:
    """Add a number from 0 in the given total order.

    Rows are range-partitioned and written; each partition numbers its own and starts after those before it.
    Only the partitions' sizes meet in one task.
    """
    parts = durable(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = parts.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return own.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_place") - 1).cast("bigint")).drop("_part", "_place", "_before")


def running_sums(rows: DataFrame, keys: tuple[str, ...], order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """Add `sums[column]`, the sum of a column over the row and those before it in `order`, within each of `keys`.

    Rows are range-partitioned and written, each partition adds up its own, and what the partitions before it hold is
    joined to it. `order` must tell the rows of a key apart; `keys` are not null.
    """
    parts = durable(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    down = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = parts.withColumns({f"_own_{c}": F.sum(c).over(down) for c in sums})
    totals = parts.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_all_{c}") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *keys, *[F.coalesce(F.sum(f"_all_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums])
    whole = own.join(before, ["_part", *keys]).withColumns({name: F.col(f"_own_{c}") + F.col(f"_before_{c}") for c, name in sums.items()})
    return whole.drop("_part", *[f"_{kind}_{c}" for c in sums for kind in ("own", "before")])
