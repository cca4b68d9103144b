"""The behaviour events that the queries run on, from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import classify

#: Windows of the label queries; a product of a user is the unit, so that both labels occur.
TRAIN_T0, TEST_T0, FEATURE_DAYS, LABEL_DAYS, MIN_VIEWS = "2024-01-15", "2024-01-23", 14, 7, 1
KEYS = ("product_id", "user_id")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def behaviour(spark: SparkSession, folder: str, merge: bool = False) -> DataFrame:
    """All events with their product's category, brand and price in cents; `error` events keep their unknown type.

    With `merge`, products are never broadcast: Spark goes by their compressed size, of which the hash table is many times.
    """
    e, p = table(spark, folder, "events"), table(spark, folder, "part")
    p = p.hint("merge") if merge else p
    product = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    kind = F.when(F.col("event_type") == "click", "cart").when(F.col("event_type") == "signup", "remove_from_cart").otherwise(F.col("event_type"))
    code = F.when(F.col("p_type") != "ECONOMY", F.concat(F.lower("p_type"), F.lit("."), F.replace(F.col("p_name"), F.lit(" "), F.lit("."))))
    user = F.col("user_id").cast("string")
    return e.join(p, product == p.p_partkey).select(
        "event_id",
        F.col("ts").alias("event_time"),
        F.to_date("ts").alias("event_date"),
        F.hour("ts").alias("event_hour"),
        kind.alias("event_type"),
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_size").cast("string").alias("category_id"),
        code.alias("category_code"),
        F.when(~F.col("p_brand").isin("Brand#1", "Brand#2"), F.lower("p_brand")).alias("brand"),
        F.round(F.col("value") * 100).cast("bigint").alias("price_minor"),
        user.alias("user_id"),
        F.concat(user, F.lit("-"), F.to_date("ts").cast("string")).alias("user_session"),
    )


def curated(spark: SparkSession, folder: str, merge: bool = False) -> DataFrame:
    return behaviour(spark, folder, merge).where(F.col("event_type") != "error")


BEHAVIOUR_SQL = """
behaviour AS (
  SELECT e.event_id, e.ts AS event_time, CAST(e.ts AS DATE) AS event_date, CAST(hour(e.ts) AS INTEGER) AS event_hour,
    CASE e.event_type WHEN 'click' THEN 'cart' WHEN 'signup' THEN 'remove_from_cart' ELSE e.event_type END AS event_type,
    CAST(p.p_partkey AS VARCHAR) AS product_id, CAST(p.p_size AS VARCHAR) AS category_id,
    CASE WHEN p.p_type <> 'ECONOMY' THEN lower(p.p_type) || '.' || replace(p.p_name, ' ', '.') END AS category_code,
    CASE WHEN p.p_brand NOT IN ('Brand#1', 'Brand#2') THEN lower(p.p_brand) END AS brand,
    CAST(round(e.value * 100) AS BIGINT) AS price_minor, CAST(e.user_id AS VARCHAR) AS user_id,
    e.user_id || '-' || CAST(CAST(e.ts AS DATE) AS VARCHAR) AS user_session
  FROM events e JOIN part p ON CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) = p.p_partkey),
curated AS (SELECT * FROM behaviour WHERE event_type <> 'error')
"""


def with_sql(body: str, *more: str) -> str:
    """A DuckDB statement over `behaviour`, `curated` and further common table expressions."""
    return "WITH " + ",\n".join([BEHAVIOUR_SQL.strip(), *more]) + "\n" + body


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as purchases: the larger fact table."""
    l, o, p = (table(spark, folder, n) for n in ("lineitem", "orders", "part"))
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    return rows.select(
        F.col("o_orderdate").alias("event_time"), F.lit("purchase").alias("event_type"), F.col("p_partkey").cast("string").alias("product_id"), F.col("p_size").cast("string").alias("category_id"),
        F.lower("p_type").alias("category_code"), F.lower("p_brand").alias("brand"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price_minor"), F.col("o_custkey").cast("string").alias("user_id"),
    )


SALES_SQL = """sales AS (
  SELECT CAST(p.p_size AS VARCHAR) AS category_id, lower(p.p_type) AS category_code, lower(p.p_brand) AS brand,
    CAST(round(l.l_extendedprice * 100) AS BIGINT) AS price_minor
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """The events as text lines `(event_id, file, value)`, damaged by fixed rules of the event id.

    Every 97th loses a field, every 89th gains one, every 83rd has three decimals, every 79th no product, every
    73rd a bad time, every 71st no category id, every 67th an unclosed quote; others have quoted commas or a CR.
    """
    rows = behaviour(spark, folder)
    hit = lambda n: F.col("event_id") % n == 0
    price = F.format_string("%d.%02d", F.expr("price_minor div 100"), F.col("price_minor") % 100)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = [
        F.when(hit(73), "yesterday").otherwise(F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))),
        F.col("event_type"),
        F.when(hit(79), "").otherwise(F.col("product_id")),
        F.when(hit(71), "").otherwise(F.col("category_id")),
        blank("category_code"),
        F.when(hit(67), '"open').when(hit(5), F.concat(F.lit('"a ""b"", '), blank("brand"), F.lit('"'))).otherwise(blank("brand")),
        F.when(hit(83), F.concat(price, F.lit("5"))).otherwise(price),
        F.col("user_id"),
        F.col("user_session"),
    ]
    line = F.when(hit(97), F.concat_ws(",", *fields[:8])).when(hit(89), F.concat_ws(",", *fields, F.lit("extra"))).otherwise(F.concat_ws(",", *fields))
    marked = rows.select("event_id", F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("file"), F.when(hit(7), F.concat(line, F.lit("\r"))).otherwise(line).alias("value"))
    heads = marked.select("file").distinct().select(F.lit(-1).cast("bigint").alias("event_id"), "file", F.lit("﻿" + classify.HEADER).alias("value"))
    return marked.unionByName(heads)


#: What the damage rules mean for either policy, from the event id alone.
LINES_SQL = """
damaged AS (
  SELECT *, CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 67 = 0 THEN 1 ELSE 0 END AS broken, 'f' || (event_id % 3) AS file FROM behaviour),
reasons AS (
  SELECT *,
    CASE WHEN broken = 1 THEN 'MALFORMED_CSV' WHEN event_type = 'error' THEN 'UNKNOWN_EVENT' WHEN event_type <> 'purchase' THEN 'NON_PURCHASE'
      WHEN event_id % 83 = 0 THEN 'INVALID_PRICE' WHEN event_id % 71 = 0 THEN 'INVALID_GROUP' ELSE 'VALID_PURCHASE' END AS reason,
    CASE WHEN broken = 1 THEN 'MALFORMED_CSV' WHEN event_id % 73 = 0 THEN 'INVALID_EVENT_TIME' WHEN event_type = 'error' THEN 'UNKNOWN_EVENT_TYPE'
      WHEN event_id % 79 = 0 THEN 'MISSING_PRODUCT_ID' WHEN event_id % 83 = 0 THEN 'INVALID_PRICE' END AS reject_reason
  FROM damaged)
"""
