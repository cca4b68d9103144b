"""Queries: lines, reasons, revenue, comparison, catalog and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import catalog, classify, compare, metrics, pages, revenue

from .base import query
from .behaviour import LINES_SQL, SALES_SQL, curated, lines, sales, table, with_sql

#: Finished revenue over `keyed(group_key, price_minor)`.
REVENUE = """SELECT group_key, CAST(s AS BIGINT) AS sum_minor, n AS purchase_count,
  CAST(s // 100 AS VARCHAR) || '.' || lpad(CAST(s % 100 AS VARCHAR), 2, '0') AS total_revenue,
  CAST(a // 100 AS VARCHAR) || '.' || lpad(CAST(a % 100 AS VARCHAR), 2, '0') AS average_revenue
FROM (SELECT *, (2 * s + n) // (2 * n) AS a FROM (SELECT group_key, sum(price_minor) AS s, count(*) AS n FROM keyed GROUP BY group_key))"""
KEYED = {
    "category_id": "category_id",
    "category_code": "coalesce(category_code, '__UNKNOWN__')",
    "category_root": "split_part(coalesce(category_code, '__UNKNOWN__'), '.', 1)",
}


def keyed(mode: str, source: str = "curated") -> str:
    return f"keyed AS (SELECT {KEYED[mode]} AS group_key, price_minor FROM {source} WHERE event_type = 'purchase')"


@query(with_sql(REVENUE, keyed("category_id")))
def revenue_by_category(spark, folder):
    return revenue.ordered(revenue.revenue(curated(spark, folder)), "group_key")


@query(with_sql(REVENUE, keyed("category_code")))
def revenue_by_code(spark, folder):
    return revenue.revenue(curated(spark, folder), "category_code")


@query(with_sql(REVENUE, keyed("category_root")))
def revenue_by_root(spark, folder):
    return revenue.revenue(curated(spark, folder), "category_root")


@query(with_sql(REVENUE, SALES_SQL, "keyed AS (SELECT category_id AS group_key, price_minor FROM sales)"))
def sales_revenue_by_category(spark, folder):
    return revenue.revenue(sales(spark, folder))


@query(with_sql(REVENUE, SALES_SQL, "keyed AS (SELECT split_part(category_code, '.', 1) AS group_key, price_minor FROM sales)"))
def sales_revenue_by_root(spark, folder):
    return revenue.revenue(sales(spark, folder), "category_root")


def _line_revenue(mode: str) -> str:
    return with_sql(REVENUE, LINES_SQL.strip(), f"keyed AS (SELECT {KEYED[mode]} AS group_key, price_minor FROM reasons WHERE reason = 'VALID_PURCHASE')")


@query(_line_revenue("category_id"))
def revenue_from_lines(spark, folder):
    return revenue.revenue_from_lines(lines(spark, folder))


#: By code and root a missing category id is no fault.
_BY_CODE = LINES_SQL.strip().replace("WHEN event_id % 71 = 0 THEN 'INVALID_GROUP' ", "")


@query(with_sql(REVENUE, _BY_CODE, f"keyed AS (SELECT {KEYED['category_root']} AS group_key, price_minor FROM reasons WHERE reason = 'VALID_PURCHASE')"))
def revenue_from_lines_by_root(spark, folder):
    return revenue.revenue_from_lines(lines(spark, folder), "category_root")


@query(with_sql("SELECT reason, count(*) AS n_rows FROM (SELECT reason FROM reasons UNION ALL SELECT 'HEADER' FROM (SELECT DISTINCT file FROM reasons)) GROUP BY reason", LINES_SQL.strip()))
def line_reasons(spark, folder):
    return classify.reason_counts(classify.classify_purchases(lines(spark, folder)), "reason")


@query(
    with_sql(
        "SELECT reason, count(*) AS n_rows FROM (SELECT coalesce(reject_reason, 'VALID') AS reason FROM reasons UNION ALL SELECT 'HEADER' FROM (SELECT DISTINCT file FROM reasons)) GROUP BY reason",
        LINES_SQL.strip(),
    )
)
def curation_reasons(spark, folder):
    return classify.reason_counts(classify.parse_events(lines(spark, folder)))


@query(
    with_sql(
        """SELECT strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, CAST(event_date AS VARCHAR) AS event_date, event_hour, event_type, product_id,
  CASE WHEN event_id % 71 = 0 THEN NULL ELSE category_id END AS category_id, category_code, split_part(category_code, '.', 1) AS category_root,
  CASE WHEN event_id % 5 = 0 THEN 'a "b", ' || coalesce(brand, '') ELSE brand END AS brand, price_minor, user_id, user_session
FROM reasons WHERE reject_reason IS NULL""",
        LINES_SQL.strip(),
    )
)
def curated_from_lines(spark, folder):
    rows = classify.curate(classify.parse_events(lines(spark, folder)))
    text = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")
    return rows.select(text.alias("event_time"), F.col("event_date").cast("string").alias("event_date"), "event_hour", "event_type", "product_id", "category_id", "category_code", "category_root", "brand", "price_minor", "user_id", "user_session")


@query(with_sql("SELECT count(*) AS missing_codes FROM reasons WHERE reason = 'VALID_PURCHASE' AND category_code IS NULL", LINES_SQL.strip()))
def missing_codes(spark, folder):
    return classify.missing_codes(classify.classify_purchases(lines(spark, folder)))


@query(
    with_sql(
        """SELECT file, count(*) + 1 AS n_lines, CAST(1 AS BIGINT) AS headers, true AS header_first, count(*) FILTER (reason = 'VALID_PURCHASE') AS valid_purchases,
  count(*) FILTER (reason = 'MALFORMED_CSV') AS malformed, count(*) FILTER (reason = 'INVALID_GROUP') AS invalid_groups, CAST(0 AS BIGINT) AS overlong_keys FROM reasons GROUP BY file""",
        LINES_SQL.strip(),
    )
)
def preflight(spark, folder):
    return catalog.preflight(lines(spark, folder), order="event_id")


@query(with_sql("SELECT event_id FROM reasons WHERE reason = 'MALFORMED_CSV' ORDER BY event_id LIMIT 20", LINES_SQL.strip()))
def first_malformed_lines(spark, folder):
    return catalog.first_errors(lines(spark, folder), "event_id").select("event_id")


@query(with_sql("SELECT category_id AS group_key, count(*) AS purchases FROM reasons WHERE reason = 'VALID_PURCHASE' GROUP BY category_id", LINES_SQL.strip()))
def group_profile(spark, folder):
    return catalog.group_profile(lines(spark, folder))


@query(with_sql("SELECT category_id AS group_key, row_number() OVER (ORDER BY category_id) - 1 AS dense_id FROM (SELECT DISTINCT category_id FROM curated)"))
def group_dictionary(spark, folder):
    return catalog.dictionary(curated(spark, folder).select(F.col("category_id").alias("group_key")))


@query(with_sql("SELECT count(*) AS n_keys, sha256(string_agg(category_id, chr(10) ORDER BY category_id)) AS checksum FROM (SELECT DISTINCT category_id FROM curated)"))
def dictionary_checksum(spark, folder):
    return catalog.dictionary_checksum(group_dictionary(spark, folder))


@query(
    with_sql(
        """SELECT d.dense_id, CAST(sum(price_minor) AS BIGINT) AS sum_minor, count(*) AS purchases FROM curated c
JOIN (SELECT category_id, row_number() OVER (ORDER BY category_id) - 1 AS dense_id FROM (SELECT DISTINCT category_id FROM curated)) d ON d.category_id = c.category_id
WHERE event_type = 'purchase' GROUP BY d.dense_id"""
    )
)
def revenue_by_dense_id(spark, folder):
    bought = curated(spark, folder).where("event_type = 'purchase'").select(F.col("category_id").alias("group_key"), "price_minor")
    rows = compare.looked_up(bought, group_dictionary(spark, folder))
    return rows.groupBy("dense_id").agg(F.sum("price_minor").alias("sum_minor"), F.count("*").alias("purchases"))


_HEAD = "('0x' || substr(sha256(line), 1, 15))::BIGINT::HUGEINT"


@query(
    f"""WITH lines AS (SELECT event_id || ',' || user_id || ',' || event_type || ',' || props AS line FROM events)
SELECT count(*) AS n_lines, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes, CAST(sum({_HEAD}) AS VARCHAR) AS digest_sum FROM lines"""
)
def fingerprint(spark, folder):
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("event_id", "user_id", "event_type", "props")])
    return catalog.fingerprint(table(spark, folder, "events").select(line.alias("value")))


def _bucket(text: str, buckets: int) -> str:
    head = f"('0x' || substr(sha256({text}), 1, 8))::BIGINT"
    return f"(((CASE WHEN {head} >= 2147483648 THEN {head} - 4294967296 ELSE {head} END) % {buckets}) + {buckets}) % {buckets}"


@query(f"SELECT event_id, user_id, event_type FROM events WHERE {_bucket('event_id || chr(0) || 42', 1_000_000)} < 100000")
def sampled_events(spark, folder):
    parts = [F.col("event_id").cast("string"), F.lit("42")]
    return catalog.sample_rows(table(spark, folder, "events"), parts, 0.1).select("event_id", "user_id", "event_type")


@query(f"SELECT user_id, count(*) AS n_events FROM events WHERE {_bucket('user_id || chr(0) || 1', 1_000_000)} < 200000 GROUP BY user_id")
def sampled_users(spark, folder):
    return catalog.sample_entities(table(spark, folder, "events"), "user_id", 0.2).groupBy("user_id").agg(F.count("*").alias("n_events"))


@query("SELECT event_id, user_id FROM events ORDER BY sha256('5:' || event_id), event_id LIMIT 100")
def capped_events(spark, folder):
    return catalog.capped(table(spark, folder, "events").select("event_id", "user_id"), "event_id", 100, 5)


@query(
    with_sql(
        """SELECT (SELECT count(*) FROM l) AS left_groups, (SELECT count(*) FROM r) AS right_groups,
  count(*) FILTER (r.k IS NULL) AS only_left, count(*) FILTER (l.k IS NULL) AS only_right, count(*) FILTER (l.k IS NOT NULL AND r.k IS NOT NULL AND (l.s <> r.s OR l.n <> r.n)) AS values_differ
FROM l FULL JOIN r ON l.k = r.k""",
        LINES_SQL.strip(),
        "l AS (SELECT category_id AS k, sum(price_minor) AS s, count(*) AS n FROM curated WHERE event_type = 'purchase' GROUP BY 1)",
        "r AS (SELECT category_id AS k, sum(price_minor) AS s, count(*) AS n FROM reasons WHERE reason = 'VALID_PURCHASE' GROUP BY 1)",
    )
)
def revenue_parity(spark, folder):
    return compare.parity(revenue_by_category(spark, folder), revenue_from_lines(spark, folder))


@query(with_sql("SELECT count(*) AS n_groups, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS purchases, CAST(sum(s) AS BIGINT) AS sum_minor FROM (SELECT count(*) AS n, sum(price_minor) AS s FROM curated WHERE event_type = 'purchase' GROUP BY category_id)"))
def validated_revenue(spark, folder):
    return compare.validate(revenue_by_category(spark, folder))


_FUNNEL_CODES = "codes AS (SELECT category_id, max(category_code) AS category_code FROM curated GROUP BY category_id)"


@query(with_sql(f"SELECT r.*, c.category_code FROM ({REVENUE}) r LEFT JOIN codes c ON c.category_id = r.group_key", keyed("category_id"), _FUNNEL_CODES))
def revenue_with_codes(spark, folder):
    events = curated(spark, folder)
    return revenue.with_codes(revenue.revenue(events), metrics.funnel_by_category(events))


@query(with_sql(f"SELECT * FROM ({REVENUE}) ORDER BY sum_minor DESC, group_key LIMIT 15", keyed("category_id")))
def top_categories(spark, folder):
    return pages.leaders(revenue.revenue(curated(spark, folder)), "sum_minor", "group_key", 15)


@query(with_sql(f"SELECT * FROM ({REVENUE}) ORDER BY CAST(total_revenue AS DOUBLE) DESC, total_revenue DESC, group_key LIMIT 10 OFFSET 5", keyed("category_id")))
def revenue_page(spark, folder):
    return pages.page(revenue.revenue(curated(spark, folder)), "total_revenue", descending=True, offset=5, limit=10, key="group_key")


@query(with_sql(f"SELECT count(*) AS total FROM ({REVENUE}) WHERE contains(lower(group_key), 'small') OR contains(lower(total_revenue), 'small') OR contains(lower(average_revenue), 'small')", keyed("category_code")))
def revenue_page_total(spark, folder):
    return pages.page_total(revenue.revenue(curated(spark, folder), "category_code"), "small")


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS minor FROM lineitem")
def money_round_trip(spark, folder):
    rows = table(spark, folder, "lineitem")
    text = S.money_text(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return rows.select("l_orderkey", "l_linenumber", S.money_minor(text).alias("minor"))
