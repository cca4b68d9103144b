"""Queries that write to a fresh folder and read it back: lines, runs, exports, bundles and records."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.functions.numbering import numbered
from tallyforge.functions.tables import durable, new_folder
from tallyforge.operators import catalog, classify, clusters, features, metrics, neighbours, quality, registry, revenue
from tallyforge.sources import lines as physical
from tallyforge.sources import readers, writers

from .base import query
from .behaviour import KEYS, LINES_SQL, MIN_VIEWS, curated, lines, with_sql
from .learning import _BOTH, _FEATURES, _stats, labels
from .metrics import COUNTERS, RATIOS
from .money import REVENUE, keyed


PRODUCTS = f"products AS (SELECT *, {_FEATURES} FROM ({_stats('curated', 'product_id, user_id')}) WHERE views >= {MIN_VIEWS})"


def written_lines(spark, folder):
    """The event lines as text files, a folder a file name, read back from disk."""
    read = readers.event_lines(spark, *_written(spark, folder), glob="part-*")
    return read.withColumn("file", F.regexp_extract("file", "file=(f[0-9])", 1))


@query(
    with_sql(
        """SELECT file, count(*) + 1 AS n_lines, CAST(1 AS BIGINT) AS headers, true AS header_first, count(*) FILTER (reason = 'VALID_PURCHASE') AS valid_purchases,
  count(*) FILTER (reason = 'MALFORMED_CSV') AS malformed, count(*) FILTER (reason = 'INVALID_GROUP') AS invalid_groups, CAST(0 AS BIGINT) AS overlong_keys FROM reasons GROUP BY file""",
        LINES_SQL.strip(),
    )
)
def preflight_of_files(spark, folder):
    return catalog.preflight(written_lines(spark, folder))


#: The text of each written line, its number and the bytes before it; a mark of three bytes and the header come first.
TEXT_SQL = f"""
texts AS (
  SELECT event_id, file, reason, concat_ws(',', CASE WHEN event_id % 73 = 0 THEN 'yesterday' ELSE strftime(event_time, '%Y-%m-%d %H:%M:%S') || ' UTC' END, event_type,
    CASE WHEN event_id % 79 = 0 THEN '' ELSE product_id END, CASE WHEN event_id % 71 = 0 THEN '' ELSE category_id END, coalesce(category_code, ''),
    CASE WHEN event_id % 67 = 0 THEN '"open' WHEN event_id % 5 = 0 THEN '"a ""b"", ' || coalesce(brand, '') || '"' ELSE coalesce(brand, '') END,
    printf('%d.%02d', price_minor // 100, price_minor % 100) || CASE WHEN event_id % 83 = 0 THEN '5' ELSE '' END, user_id,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_session END, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'extra' END)
    || CASE WHEN event_id % 7 = 0 THEN chr(13) ELSE '' END AS value FROM reasons),
located AS (
  SELECT *, 1 + row_number() OVER (PARTITION BY file ORDER BY event_id) AS line,
    {len(classify.HEADER) + 4} + CAST(coalesce(sum(strlen(value) + 1) OVER (PARTITION BY file ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM texts)
"""


#: Events by whose ids lines are put together before they are dealt to the file that holds them.
STRETCH = 4096


def _stretches(rows):
    """`(file, at, value)`: the lines `(event_id, file, value)` of each stretch of event ids as one text, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    lines_ = F.array_join(F.transform(ordered, lambda line: line["value"]), "\n")
    return rows.groupBy("file", F.floor(F.col("event_id") / STRETCH).alias("at")).agg(lines_.alias("value"))


def _write_lines(spark, folder):
    """The event lines as three text files, a task each: it sorts stretches of lines, not single ones."""
    where = new_folder(spark, "lines")
    each = _stretches(lines(spark, folder)).repartitionById(3, F.substring("file", 2, 1).cast("int"))
    each.sortWithinPartitions("file", "at").select("file", "value").write.partitionBy("file").text(where)
    return where


def _written(spark, folder):
    where = _write_lines(spark, folder)
    return [f"{where}/file=f{k}" for k in range(3)]


@query(with_sql("""SELECT file, line, "offset", reason AS error, value FROM located WHERE reason = 'MALFORMED_CSV' ORDER BY file, line LIMIT 20""", LINES_SQL.strip(), TEXT_SQL.strip()))
def first_errors_of_files(spark, folder):
    """The first twenty errors of the written files, by line number and byte offset."""
    found = physical.first_errors(physical.physical_lines(spark, *_written(spark, folder), glob="part-*"))
    return found.withColumn("file", F.regexp_extract("file", "file=(f[0-9])", 1))


_OFFSET_HEAD = """('0x' || substr(sha256(encode(file) || '\\x00'::BLOB || unhex('000000000000002A') || unhex(lpad(to_hex("offset"), 16, '0'))), 1, 8))::BIGINT"""


@query(
    with_sql(
        f"""SELECT file, line, "offset", value FROM (SELECT *, {_OFFSET_HEAD} AS head FROM located)
WHERE (((CASE WHEN head >= 2147483648 THEN head - 4294967296 ELSE head END) % 1000000) + 1000000) % 1000000 < 100000""",
        LINES_SQL.strip(),
        TEXT_SQL.strip(),
    )
)
def sampled_lines(spark, folder):
    """A tenth of the written lines by the digest of file, seed and byte offset."""
    located = physical.located_lines(spark, *_written(spark, folder), glob="part-*")
    return physical.sample_lines(located.withColumn("file", F.regexp_extract("file", "file=(f[0-9])", 1)), 0.1, 42).select("file", "line", "offset", "value")


@query(with_sql(REVENUE, LINES_SQL.strip(), "keyed AS (SELECT category_id AS group_key, price_minor FROM reasons WHERE reason = 'VALID_PURCHASE')"))
def revenue_from_files(spark, folder):
    return revenue.revenue_from_lines(written_lines(spark, folder))


@query(with_sql("SELECT CAST(3 AS BIGINT) AS n_files, (SELECT count(*) FROM reasons) + 3 AS n_lines, true AS digest_matches", LINES_SQL.strip()))
def manifest_of_files(spark, folder):
    """The manifest of the written lines, and whether its fingerprint is the same when taken again."""
    where = _write_lines(spark, folder)
    one, two = (catalog.manifest_fingerprint(catalog.input_manifest(spark, where).where("uri like '%part-%'")) for _ in range(2))
    n = readers.event_lines(spark, where, glob="part-*").agg(F.count("*").alias("n_lines"))
    both = one.select("n_files", "fingerprint").crossJoin(two.select(F.col("fingerprint").alias("again")))
    return both.crossJoin(n).select("n_files", "n_lines", (F.col("fingerprint") == F.col("again")).alias("digest_matches"))


@query(with_sql("SELECT group_key, total_revenue, purchase_count, average_revenue, sum_minor FROM (" + REVENUE + ")", keyed("category_id")))
def result_file(spark, folder):
    """Revenue written as tab-separated rows and read back with every amount derived again."""
    where = new_folder(spark, "result")
    own = revenue.revenue(curated(spark, folder)).select("group_key", "total_revenue", "purchase_count", "average_revenue")
    own.write.option("sep", "\t").csv(where)
    return readers.result_rows(spark, where)


@query(with_sql(REVENUE, keyed("category_id")))
def latest_revenue_run(spark, folder):
    """Two runs of small tables; the newest one is found and read."""
    root, events = new_folder(spark, "runs"), curated(spark, folder)
    writers.write_small(revenue.revenue(events, "category_code"), root, "20240101-a")
    writers.write_small(revenue.revenue(events), root, "20240102-b")
    return readers.run_table(spark, root, readers.latest_run(spark, root), ("group_key", "sum_minor"))


@query(with_sql("SELECT event_date, count(*) AS n_events, CAST(sum(price_minor) AS BIGINT) AS minor FROM reasons WHERE reject_reason IS NULL GROUP BY event_date", LINES_SQL.strip()))
def curated_run(spark, folder):
    """Curated lines written by date and read back."""
    path = writers.write_curated(classify.curate(classify.parse_events(lines(spark, folder))), new_folder(spark, "runs"), "r1")
    return spark.read.parquet(path).groupBy("event_date").agg(F.count("*").alias("n_events"), F.sum("price_minor").alias("minor"))


@query(with_sql("SELECT count(*) + 3 AS lines_in, count(*) FILTER (reject_reason IS NULL) AS accepted, count(*) FILTER (reject_reason IS NOT NULL) + 3 AS rejected, count(*) FILTER (reject_reason IS NULL) AS written FROM reasons", LINES_SQL.strip()))
def run_quality_conservation(spark, folder):
    """No line is lost between the input and what is read back from the written run."""
    parsed, root = classify.parse_events(lines(spark, folder)), new_folder(spark, "runs")
    writers.write_curated(classify.curate(parsed), root, "r1")
    return quality.conservation(parsed, readers.run_table(spark, root, "r1"))


@query(with_sql("SELECT split, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives FROM labelled GROUP BY split", *_BOTH))
def label_run(spark, folder):
    path = writers.write_labels(labels(spark, folder), new_folder(spark, "runs"), "r1")
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n_rows"), F.sum("label").alias("positives"))


@query(
    with_sql(
        f"""SELECT category_id, CAST(revenue_minor AS VARCHAR) AS revenue_minor, category_code, CAST(revenue_minor // 100 AS VARCHAR) || '.' || lpad(CAST(revenue_minor % 100 AS VARCHAR), 2, '0') AS revenue
FROM (SELECT *, {RATIOS} FROM (SELECT category_id, {COUNTERS}, max(category_code) AS category_code FROM curated GROUP BY category_id))"""
    )
)
def exported_funnel(spark, folder):
    """The funnel exported as one ordered CSV file with its revenue as an amount, read back as text."""
    where = new_folder(spark, "export")
    writers.export_csv(metrics.funnel_by_category(curated(spark, folder)), where, "category_id", money=("revenue_minor",))
    return spark.read.option("header", True).csv(where).select("category_id", "revenue_minor", "category_code", "revenue")


@query(with_sql("SELECT 'ok' AS status, (SELECT count(*) FROM curated) AS n_rows"))
def run_record(spark, folder):
    where = new_folder(spark, "record")
    writers.write_record(spark, where, status="ok", rows=curated(spark, folder).count())
    return spark.read.json(where).select("status", F.col("rows").cast("bigint").alias("n_rows"))


@query(
    with_sql(
        """SELECT name, CAST(n AS BIGINT) AS n_rows, true AS matches FROM (SELECT 'revenue' AS name, count(DISTINCT category_id) FILTER (event_type = 'purchase') AS n FROM curated
UNION ALL SELECT 'funnel_by_category', count(DISTINCT category_id) FROM curated UNION ALL SELECT 'funnel_by_brand', count(DISTINCT coalesce(brand, '__UNKNOWN__')) FROM curated
UNION ALL SELECT 'trend_by_hour', count(*) FROM (SELECT DISTINCT event_date, event_hour FROM curated) UNION ALL SELECT 'parity', 1 UNION ALL SELECT 'quality', 1
UNION ALL SELECT 'parity_differences', 0 UNION ALL SELECT 'events_per_type', count(DISTINCT event_type) FROM curated)"""
    )
)
def published_run(spark, folder):
    """A whole bundle published, then every file held against the manifest. Events meet their products once for all tables."""
    events = durable(curated(spark, folder, merge=True))
    path = writers.publish(spark, new_folder(spark, "serving"), "r1", writers.serving_tables(events, revenue.revenue(events)))
    listed = spark.read.parquet(f"{path}/_manifest_table")
    held = readers.verified_files(spark, path, listed).select("path", "matches")
    return listed.join(held.hint("merge"), "path").where("rows is not null").groupBy("name").agg(F.max("rows").alias("n_rows"), F.bool_and("matches").alias("matches"))


def model_runs(spark, folder, events):
    """A K-Means run of the K that the sweep chooses and a neighbour run, written with their tables; and the labelled rows."""
    rows = durable(features.with_features(features.product_stats(events, KEYS), MIN_VIEWS).withColumn("item", F.concat_ws("/", *KEYS)))
    scaling = clusters.scaler(rows)
    scaled = scaling.transform(rows)
    summary = durable(clusters.sweep_summary(clusters.sweep(durable(scaled.select("item", "z")), (2, 3, 4), (1, 2))))
    k = clusters.choose(summary).first().k
    model = clusters.fit(scaled, k, 1)
    assigned = model.transform(scaled)
    kmeans = {
        "assignments": assigned.select("item", "cluster"),
        "profile": clusters.profile(assigned, ("views", "carts", "purchases")),
        "sweep": summary,
        "centers": clusters.centers(model, spark),
        "scaling": clusters.scaler_parameters(rows),
    }
    root = new_folder(spark, "models")
    paths = {"kmeans": writers.write_model(spark, root, "a-kmeans", "kmeans", {"scaler": scaling, "kmeans": model}, kmeans, k=k)}
    known = durable(labels(spark, folder, events).withColumn("item", F.concat_ws("/", *KEYS)))
    train = durable(numbered(known.where("split = 'train'"), *KEYS))
    parameters = clusters.scaler_parameters(train)
    saved = {r.feature: (r.mean, r.std) for r in parameters.collect()}
    asked = registry.standardize(known.where("split = 'test'"), saved, "item").withColumnRenamed("item", "query_id")
    near = neighbours.exact(registry.standardize(train, saved, "row", F.col("item").alias("id")), asked, 15)
    predictions = neighbours.vote_share(near, train.select(F.col("row").alias("neighbour_row"), "label"), 15, 0.4)
    paths["knn"] = writers.write_model(spark, root, "b-knn", "knn", {}, {"train_set": train.select("row", "item", "label", *S.FEATURES), "scaling": parameters, "predictions": predictions}, k=15, threshold=0.4)
    return paths, known.where("split = 'test'").select("item", "label", *[c for c in ("views", "carts", "purchases", "median_price", "distinct_users", "recent_views") if c in known.columns], *S.FEATURES)


def published(spark, folder):
    """The root and the path of the published run, and the events, which meet their products once for all tables and models."""
    events = durable(curated(spark, folder, merge=True))
    paths, tested = model_runs(spark, folder, events)
    root = new_folder(spark, "serving")
    return root, writers.publish(spark, root, "r1", {"revenue": revenue.revenue(events).orderBy("group_key")}, paths, tested), events


@query(
    with_sql(
        """SELECT name, CAST(n AS BIGINT) AS n_rows, true AS matches FROM (SELECT 'revenue' AS name, count(DISTINCT category_id) FILTER (event_type = 'purchase') AS n FROM curated
UNION ALL SELECT 'ml/kmeans/assignments', count(*) FROM products UNION ALL SELECT 'ml/kmeans/sweep', 3 UNION ALL SELECT 'ml/kmeans/scaling', (SELECT count(*) FROM (SELECT unnest("""
        + str(list(S.FEATURES))
        + """)))
UNION ALL SELECT 'ml/knn/train_set', count(*) FROM train_snapshot UNION ALL SELECT 'ml/knn/products', count(*) FROM test_snapshot
UNION ALL SELECT 'ml/knn/predictions', count(*) FROM test_snapshot
UNION ALL SELECT 'all files', 0)""",
        *_BOTH,
        PRODUCTS,
    )
)
def published_models(spark, folder):
    """Tables and two model runs published as one; rows of the tables, and how many files of the manifest have changed."""
    root, path, _ = published(spark, folder)
    if readers.latest_run(spark, root) != "r1":
        raise ValueError("the published run is not the latest one")
    listed = durable(spark.read.parquet(f"{path}/_manifest_table"))
    held = durable(readers.verified_files(spark, path, listed))
    own = listed.join(held.select("path", "matches").hint("merge"), "path").where("rows is not null and name not in ('ml/kmeans/profile', 'ml/kmeans/centers', 'ml/knn/scaling')")
    tables = own.groupBy("name").agg(F.max("rows").alias("n_rows"), F.bool_and("matches").alias("matches"))
    return tables.unionByName(held.agg(F.lit("all files").alias("name"), F.count_if(~F.col("matches")).alias("n_rows"), F.bool_and("matches").alias("matches")))


@query(with_sql("SELECT CAST(0 AS BIGINT) AS differing, count(*) AS n_rows FROM products", PRODUCTS))
def kmeans_replay(spark, folder):
    """The saved scaler and K-Means models of a published run, loaded and applied again: rows whose cluster is another one."""
    _, path, events = published(spark, folder)
    rows = features.with_features(features.product_stats(events, KEYS), MIN_VIEWS).withColumn("item", F.concat_ws("/", *KEYS))
    scaling, model = PipelineModel.load(f"{path}/ml/kmeans/model_scaler"), KMeansModel.load(f"{path}/ml/kmeans/model_kmeans")
    again = model.transform(scaling.transform(rows)).select("item", F.col("cluster").cast("double").alias("cluster"))
    saved = spark.read.option("header", True).csv(f"{path}/ml/kmeans/assignments").select("item", F.col("cluster").cast("double").alias("cluster"))
    wrong = registry.replay(saved, again, "item", ("cluster",))
    return wrong.agg(F.count("*").alias("differing")).crossJoin(saved.agg(F.count("*").alias("n_rows")))


@query(with_sql("SELECT event_type, CAST(sum(price_minor) AS BIGINT) AS minor FROM curated GROUP BY event_type"))
def money_columns(spark, folder):
    """Amounts as text and back, summed by type."""
    rows = curated(spark, folder).select("event_type", S.money_minor(S.money_text("price_minor")).alias("minor"))
    return rows.groupBy("event_type").agg(F.sum("minor").alias("minor"))
