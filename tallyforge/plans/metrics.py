"""Queries: quality reports, funnels and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import metrics, quality, revenue

from .base import query
from .behaviour import behaviour, curated, with_sql

COUNTERS = """count(*) AS events, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'cart') AS carts,
  count(*) FILTER (event_type = 'remove_from_cart') AS removes, count(*) FILTER (event_type = 'purchase') AS purchases,
  CAST(coalesce(sum(price_minor) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS revenue_minor"""
RATIOS = """CASE WHEN views > 0 THEN round(purchases / views, 6) END AS view_to_purchase,
  CASE WHEN carts > 0 THEN round(purchases / carts, 6) END AS cart_to_purchase"""
_DISTINCTS = ", ".join(f"count(DISTINCT {c}) AS distinct_{c}" for c in quality.DISTINCTS)
_NULLS = ", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in ("category_id", "category_code", "brand", "user_session"))


@query(with_sql(f"SELECT count(*) AS n_rows, min(event_time) AS first_time, max(event_time) AS last_time, {_NULLS}, count(*) FILTER (price_minor = 0) AS zero_prices, {_DISTINCTS} FROM curated"))
def quality_profile(spark, folder):
    return quality.profile(curated(spark, folder))


@query()
def quality_profile_approximate(spark, folder):
    return quality.profile(curated(spark, folder), approximate=True)


@query(with_sql("SELECT event_type, count(*) AS n_events FROM curated GROUP BY event_type"))
def events_per_type(spark, folder):
    return quality.events_per_type(curated(spark, folder))


@query(with_sql("SELECT count(*) FILTER (event_type = 'purchase' AND price_minor = 0) AS zero_price_purchases FROM curated"))
def zero_price_purchases(spark, folder):
    return quality.zero_price_purchases(curated(spark, folder))


@query(with_sql("SELECT count(*) AS ambiguous_categories FROM (SELECT category_id FROM curated GROUP BY category_id HAVING count(DISTINCT category_code) > 1)"))
def ambiguous_categories(spark, folder):
    return quality.ambiguous_categories(curated(spark, folder))


@query(with_sql("SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM curated GROUP BY product_id, user_session, event_type HAVING count(*) > 1)"))
def duplicate_actions(spark, folder):
    return quality.duplicates(curated(spark, folder), ("product_id", "user_session", "event_type"))


@query(
    with_sql(
        """SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM curated
GROUP BY event_time, event_type, product_id, category_id, category_code, brand, price_minor, user_id, user_session HAVING count(*) > 1)"""
    )
)
def duplicate_events(spark, folder):
    return quality.duplicates(curated(spark, folder))


@query(with_sql(f"SELECT *, {RATIOS} FROM (SELECT category_id, {COUNTERS}, max(category_code) AS category_code, count(DISTINCT category_code) AS distinct_codes FROM curated WHERE category_id IS NOT NULL GROUP BY category_id)"))
def funnel_by_category(spark, folder):
    return metrics.funnel_by_category(curated(spark, folder))


@query(with_sql(f"SELECT *, {RATIOS} FROM (SELECT coalesce(brand, '__UNKNOWN__') AS brand, {COUNTERS} FROM curated GROUP BY 1)"))
def funnel_by_brand(spark, folder):
    return metrics.funnel_by_brand(curated(spark, folder))


@query(with_sql(f"SELECT event_date, event_hour, {COUNTERS}, count(DISTINCT user_id) AS distinct_users FROM curated GROUP BY event_date, event_hour"))
def trend_by_hour(spark, folder):
    return metrics.trend_by_hour(curated(spark, folder))


@query(with_sql(f"SELECT event_date, {COUNTERS}, count(DISTINCT user_id) AS distinct_users FROM curated GROUP BY event_date"))
def trend_by_day(spark, folder):
    return metrics.trend_by_day(curated(spark, folder))


@query(
    with_sql(
        """SELECT count(*) AS input_events, count(*) AS funnel_events, count(*) FILTER (event_type = 'purchase') AS funnel_purchases,
  CAST(sum(price_minor) FILTER (event_type = 'purchase') AS BIGINT) AS funnel_revenue, count(*) FILTER (event_type = 'purchase') AS revenue_purchases,
  CAST(sum(price_minor) FILTER (event_type = 'purchase') AS BIGINT) AS revenue_minor FROM curated"""
    )
)
def totals_check(spark, folder):
    events = curated(spark, folder)
    return metrics.totals_check(events, metrics.funnel_by_category(events), revenue.revenue(events))


@query(
    with_sql(
        """SELECT category_root, count(*) AS sessions, CAST(sum(bought) AS BIGINT) AS buying_sessions, round(sum(bought) / count(*), 6) AS purchase_rate
FROM (SELECT user_session, split_part(coalesce(category_code, '__UNKNOWN__'), '.', 1) AS category_root, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS bought FROM curated GROUP BY 1, 2) GROUP BY category_root"""
    )
)
def session_purchase_rate(spark, folder):
    return metrics.session_purchase_rate(curated(spark, folder))


@query(
    with_sql(
        f"""SELECT *, {RATIOS} FROM (SELECT CASE WHEN place <= 10 THEN brand ELSE '__OTHER__' END AS brand, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("events", *metrics.KINDS, "revenue_minor"))}
FROM (SELECT *, row_number() OVER (ORDER BY revenue_minor DESC, brand) AS place FROM (SELECT coalesce(brand, '__UNKNOWN__') AS brand, {COUNTERS} FROM curated GROUP BY 1)) GROUP BY 1)"""
    )
)
def top_brands(spark, folder):
    return metrics.top_brands(curated(spark, folder), 10)


@query(with_sql("SELECT event_type, count(*) AS n_events FROM behaviour GROUP BY event_type"))
def all_event_types(spark, folder):
    return behaviour(spark, folder).groupBy("event_type").agg(F.count("*").alias("n_events"))
