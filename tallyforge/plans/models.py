"""Queries: clusters, neighbours, model records and scoring."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.functions.numbering import numbered
from tallyforge.functions.tables import durable, new_folder
from tallyforge.operators import catalog, clusters, evaluate, features, neighbours, pages, registry
from tallyforge.sources import writers

from .base import query
from .behaviour import KEYS, MIN_VIEWS, curated, table, with_sql
from .files import PRODUCTS
from .learning import _BOTH, labels

_PRODUCTS = PRODUCTS


def products(spark, folder):
    rows = features.with_features(features.product_stats(curated(spark, folder), KEYS), MIN_VIEWS)
    return rows.withColumn("item", F.concat_ws("/", *KEYS))


@query(with_sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM products" for c in S.FEATURES), _PRODUCTS))
def scaler_parameters(spark, folder):
    return clusters.scaler_parameters(products(spark, folder)).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_TILED = [_PRODUCTS, "tiled AS (SELECT *, CAST(ntile(4) OVER (ORDER BY median_price, product_id || '/' || user_id) - 1 AS INTEGER) AS cluster FROM products)"]


def tiled(spark, folder):
    return clusters.price_groups(products(spark, folder), 4, "median_price", "item")


@query(with_sql("SELECT product_id || '/' || user_id AS item, cluster FROM tiled", *_TILED))
def price_groups(spark, folder):
    return tiled(spark, folder).select("item", "cluster")


@query(with_sql("SELECT cluster, count(*) AS size, round(avg(views), 6) AS mean_views, round(avg(carts), 6) AS mean_carts, round(avg(purchases), 6) AS mean_purchases, round(avg(CASE WHEN purchases > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS purchase_share FROM tiled GROUP BY cluster", *_TILED))
def cluster_profile(spark, folder):
    return clusters.profile(tiled(spark, folder), ("views", "carts", "purchases"))


@query(
    with_sql(
        """SELECT cluster, category_root, products, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY products DESC, category_root) AS place
FROM (SELECT cluster, coalesce(category_root, '__UNKNOWN__') AS category_root, count(*) AS products FROM tiled GROUP BY 1, 2)) WHERE place <= 3""",
        *_TILED,
    )
)
def top_roots(spark, folder):
    return clusters.top_roots(tiled(spark, folder))


@query(with_sql("SELECT cluster, quantile_disc(revenue_minor, 0.25) AS p25, quantile_disc(revenue_minor, 0.5) AS p50, quantile_disc(revenue_minor, 0.75) AS p75 FROM tiled GROUP BY cluster", *_TILED))
def cluster_quantiles(spark, folder):
    return clusters.quantile_profile(tiled(spark, folder), "revenue_minor")


def _scaled(spark, folder):
    rows = durable(products(spark, folder))
    return clusters.scaler(rows).transform(rows)


@query()
def kmeans_sweep(spark, folder):
    """Every K from 2 to 10 with three seeds, and the one that is chosen."""
    rows = durable(_scaled(spark, folder).select("item", "z"))
    summary = clusters.sweep_summary(clusters.sweep(rows, tuple(range(2, 11)), (1, 2, 3)))
    chosen = clusters.choose(summary).select("k", F.lit(True).alias("chosen"))
    return summary.join(F.broadcast(chosen), "k", "left").na.fill(False, ["chosen"])


@query()
def kmeans_clusters(spark, folder):
    rows = _scaled(spark, folder)
    model = clusters.fit(rows, 2, 1)
    return model.transform(rows).select("item", "cluster", *S.FEATURES)


@query(with_sql("SELECT count(*) AS n_rows, 1.0::DOUBLE AS agreement FROM products", _PRODUCTS))
def kmeans_parity(spark, folder):
    """Assignments by the model and by its saved centers, which must be the same."""
    rows = _scaled(spark, folder)
    model = clusters.fit(rows, 2, 1)
    again = clusters.assign(clusters.as_features(rows, "item"), clusters.centers(model, spark), "item").withColumnRenamed("cluster", "again")
    both = model.transform(rows).select("item", "cluster").join(again, "item")
    return both.agg(F.count("*").alias("n_rows"), F.avg((F.col("cluster") == F.col("again")).cast("double")).alias("agreement"))


@query()
def kmeans_names(spark, folder):
    rows = _scaled(spark, folder)
    return clusters.named(clusters.profile(clusters.fit(rows, 2, 1).transform(rows), ("views", "purchases")))


@query()
def kmeans_baselines(spark, folder):
    """Silhouettes of the same K on permuted columns and of price groups."""
    rows = _scaled(spark, folder)
    mixed = durable(clusters.permuted(rows, S.FEATURES, "item", 5))
    shuffled = clusters.scaler(mixed).transform(mixed)
    scores = [("permuted", clusters._silhouette(clusters.fit(shuffled, 2, 1).transform(shuffled))), ("price", clusters._silhouette(durable(clusters.price_groups(rows, 2, "median_price", "item"))))]
    return spark.createDataFrame([(n, float(s)) for n, s in scores], "baseline string, silhouette double")


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("row"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


_CENTERS = "centers AS (SELECT label AS cluster, list(m ORDER BY i) AS center FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"
_DISTANCE = "list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@query(f"WITH {_CENTERS} SELECT vec_id, arg_min(cluster, d) AS cluster, round(min(d), 6) AS distance FROM (SELECT e.vec_id, c.cluster, {_DISTANCE.format('e.embedding::DOUBLE[]', 'c.center')} AS d FROM embeddings e, centers c) GROUP BY vec_id")
def nearest_center(spark, folder):
    rows = vectors(spark, folder)
    means = rows.select("label", F.posexplode("features").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    center = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    found = clusters.assign(rows, means.groupBy(F.col("label").alias("cluster")).agg(center.alias("center")), "id")
    return found.select(F.col("id").alias("vec_id"), "cluster", F.round(F.array_min("distances"), 6).alias("distance"))


#: All pairs of a vector and another one, in order of distance.
_NEAR = f"""pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, b.label, a.label AS own, {_DISTANCE.format('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS place FROM pairs)"""


def near_vectors(spark, folder, k):
    """The k nearest vectors of every one, among all; they travel as they are given and are widened where they meet."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row"), F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return neighbours.exact(rows, rows.select(F.col("id").alias("query_id"), "features"), k, exclude_self=True)


@query(f"WITH {_NEAR} SELECT query_id, neighbour_id, CAST(place AS INTEGER) AS place, round(d, 6) AS distance FROM near WHERE place <= 20")
def nearest_vectors(spark, folder):
    return near_vectors(spark, folder, 20).select("query_id", "neighbour_id", "place", F.round("distance", 6).alias("distance"))


@query(f"WITH {_NEAR} SELECT query_id, list(neighbour_id ORDER BY place)[1] AS first_id, count(*) AS n FROM near WHERE place <= 10 GROUP BY query_id")
def neighbour_lists(spark, folder):
    """The precomputed neighbours of every vector."""
    found = neighbours.listed(near_vectors(spark, folder, 10))
    return found.select("query_id", F.col("neighbours")[0]["id"].alias("first_id"), F.size("neighbours").cast("long").alias("n"))


_VOTES = f"{_NEAR}, votes AS (SELECT query_id, max(CASE WHEN own < 3 THEN 1 ELSE 0 END) AS label, avg(CASE WHEN label < 3 THEN 1.0::DOUBLE ELSE 0 END) AS vote_share FROM near WHERE place <= 15 GROUP BY query_id)"


def votes(spark, folder):
    truth = vectors(spark, folder).select(F.col("row").alias("neighbour_row"), (F.col("label") < 3).cast("int").alias("label"))
    found = neighbours.vote_share(near_vectors(spark, folder, 15), truth, 15, 0.4)
    return found.join(truth.withColumnRenamed("neighbour_row", "query_id"), "query_id")


@query(f"WITH {_VOTES} SELECT query_id, label, round(vote_share, 9) AS vote_share, CASE WHEN vote_share >= 0.4 THEN 1 ELSE 0 END AS prediction FROM votes")
def knn_votes(spark, folder):
    return votes(spark, folder).select("query_id", "label", F.round("vote_share", 9).alias("vote_share"), "prediction")


@query(f"WITH {_VOTES} SELECT label, CASE WHEN vote_share >= 0.4 THEN 1 ELSE 0 END AS prediction, count(*) AS n_rows FROM votes GROUP BY 1, 2")
def knn_confusion(spark, folder):
    return evaluate.confusion(votes(spark, folder))


_SWEEP = f"""{_NEAR}, ks AS (SELECT unnest([3, 5, 9, 15]) AS k),
scored AS (SELECT k, query_id, max(CASE WHEN own < 3 THEN 1 ELSE 0 END) AS label, avg(CASE WHEN label < 3 THEN 1.0::DOUBLE ELSE 0 END) AS score FROM near JOIN ks ON place <= k GROUP BY k, query_id),
each AS (SELECT k, round(score, 9) AS score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1, 2),
curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY k) AS all_pos FROM each WINDOW w AS (PARTITION BY k ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
best AS (SELECT * FROM (SELECT k, score AS threshold, round(2 * tp / (tp + fp + all_pos), 12) AS f1, row_number() OVER (PARTITION BY k ORDER BY round(2 * tp / (tp + fp + all_pos), 12) DESC, score DESC) AS r FROM curve) WHERE r = 1)"""


@query(f"WITH {_SWEEP} SELECT k, threshold, f1, row_number() OVER (ORDER BY f1 DESC, k) = 1 AS chosen FROM best")
def knn_sweep(spark, folder):
    """The best threshold of several K from one neighbour search, the chosen one first."""
    truth = vectors(spark, folder).select(F.col("row").alias("neighbour_row"), (F.col("label") < 3).cast("int").alias("label"))
    scored = neighbours.vote_sweep(near_vectors(spark, folder, 15), truth, (3, 5, 9, 15)).withColumn("score", F.round("score", 9))
    labelled = scored.join(truth.withColumnRenamed("neighbour_row", "query_id"), "query_id")
    table_ = evaluate.best_threshold(labelled, "k")
    chosen = evaluate.choose_k(table_).select("k", F.lit(True).alias("chosen"))
    return table_.join(F.broadcast(chosen), "k", "left").na.fill(False, ["chosen"])


@query(f"WITH {_NEAR}, ks AS (SELECT unnest([5, 10, 20]) AS k), each AS (SELECT k, query_id, avg(CASE WHEN label = own THEN 1.0::DOUBLE ELSE 0 END) AS s FROM near JOIN ks ON place <= k GROUP BY k, query_id) SELECT k, round(avg(s), 6) AS agreement, count(*) AS queries FROM each GROUP BY k")
def label_agreement(spark, folder):
    codes = vectors(spark, folder).select("id", F.col("label").alias("code"))
    return neighbours.agreement(near_vectors(spark, folder, 20), codes).withColumn("agreement", F.round("agreement", 6))


_DRAWN = "('0x' || substr(sha256('3:' || query_id || ':' || place), 1, 12))::BIGINT % (SELECT count(*) FROM embeddings)"
_BASELINES = f"""WITH asked AS (SELECT vec_id AS query_id, label AS own FROM embeddings), places AS (SELECT *, unnest(range(1, 21)) AS place FROM asked),
drawn AS (SELECT 'random' AS baseline, p.query_id, p.own, p.place, e.label FROM (SELECT *, {_DRAWN} AS row FROM places) p JOIN embeddings e ON e.vec_id = p.row),
most AS (SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 21),
popular AS (SELECT 'popular' AS baseline, query_id, own, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS place, label FROM asked JOIN most ON vec_id <> query_id),
found AS (SELECT * FROM drawn UNION ALL SELECT * FROM popular WHERE place <= 20), ks AS (SELECT unnest([5, 10, 20]) AS k),
each AS (SELECT baseline, k, query_id, avg(CASE WHEN label = own THEN 1.0::DOUBLE ELSE 0 END) AS share FROM found JOIN ks ON place <= k GROUP BY baseline, k, query_id)
SELECT baseline, k, round(avg(share), 6) AS agreement, count(*) AS queries FROM each GROUP BY baseline, k"""


@query(_BASELINES)
def agreement_baselines(spark, folder):
    """Agreement of random neighbours and of the smallest ids taken as the popular ones."""
    rows = vectors(spark, folder)
    asked, codes = rows.select(F.col("id").alias("query_id")), rows.select("id", F.col("label").alias("code"))
    popular = pages.leaders(rows.select("id", (-F.col("id")).alias("views")), "views", "id", 21).withColumn("place", F.col("id") + 1)
    found = {"random": neighbours.random_neighbours(asked, rows, 20), "popular": neighbours.popular_neighbours(asked, popular.select("id", "place"), 20)}
    parts = [neighbours.agreement(n, codes).withColumns({"baseline": F.lit(name), "agreement": F.round("agreement", 6)}) for name, n in found.items()]
    return parts[0].unionByName(parts[1])


@query()
def lsh_recall(spark, folder):
    """Recall of a hash search for every hundredth product's neighbours in the features, and how many distances it computed."""
    rows = durable(numbered(_scaled(spark, folder).select("item", vector_to_array("z").alias("features")), "item").select("row", F.col("row").alias("id"), "features"))
    asked = rows.where("row % 100 = 0").select(F.col("id").alias("query_id"), "features")
    found, counts = neighbours.lsh(rows, asked, 10, width=2.0, tables=6, functions=4, probes=6, exclude_self=True)
    return neighbours.recall(found, neighbours.exact(rows, asked, 10, exclude_self=True)).crossJoin(F.broadcast(counts))


@query()
def search_visits(spark, folder):
    """How many pairs of a query and a block of rows an exact search for every product's neighbours in the features meets."""
    rows = durable(numbered(_scaled(spark, folder).select("item", vector_to_array("z").alias("features")), "item").select("row", F.col("row").alias("id"), "features"))
    return neighbours.exact_with_visits(rows, rows.select(F.col("id").alias("query_id"), "features"), 20, True, block_numbers=64 * len(S.FEATURES))[1]


@query(with_sql("SELECT product_id, views FROM (SELECT product_id, count(*) FILTER (event_type = 'view') AS views FROM curated GROUP BY product_id) ORDER BY views DESC, product_id LIMIT 21"))
def popular_products(spark, folder):
    return pages.leaders(features.product_stats(curated(spark, folder)).select("product_id", "views"), "views", "product_id", 21)


@query(with_sql("SELECT product_id, brand, category_code FROM (SELECT product_id, max(brand) AS brand, max(category_code) AS category_code FROM curated GROUP BY product_id) WHERE contains(lower(product_id), 'small') OR contains(brand, 'small') OR contains(category_code, 'small') ORDER BY product_id LIMIT 20"))
def product_lookup(spark, folder):
    return pages.find_products(features.product_stats(curated(spark, folder)), "small", 20).select("product_id", "brand", "category_code")


@query("SELECT model_type, model_run, serving_run FROM (SELECT *, row_number() OVER (PARTITION BY model_type, model_run ORDER BY serving_run DESC) AS r FROM (SELECT o_orderpriority AS model_type, o_custkey AS model_run, o_orderkey AS serving_run FROM orders)) WHERE r = 1")
def latest_records(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("model_type"), F.col("o_custkey").alias("model_run"), F.col("o_orderkey").alias("serving_run"))
    return registry.latest(rows)


@query()
def raw_scores(spark, folder):
    """Clusters for raw counts by saved parameters, with warnings."""
    known = _scaled(spark, folder)
    parameters = {r.feature: (r.mean, r.std) for r in clusters.scaler_parameters(known, S.FEATURES).collect()}
    model = clusters.fit(known, 2, 1)
    raw = features.product_stats(curated(spark, folder), KEYS).where("views > 0").withColumns({"recent_views": F.col("views"), "item": F.concat_ws("/", *KEYS)})
    return registry.score_raw(raw, parameters, clusters.centers(model, spark), 2, "item").select("item", "cluster", "warnings", "out_of_domain")


@query(
    with_sql(
        f"""SELECT item, concat_ws(',', CASE WHEN views < 2 THEN 'views_below_minimum' END, CASE WHEN carts > views THEN 'carts_above_views' END, CASE WHEN purchases > views THEN 'purchases_above_views' END) AS warnings,
  views < 2 OR carts > views OR purchases > views AS out_of_domain, round(CASE WHEN s > 0 THEN (ln(1 + views) - m) * (1.0::DOUBLE / s) ELSE 0 END, 9) AS z_log_views
FROM (SELECT product_id || '/' || user_id AS item, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'cart') AS carts, count(*) FILTER (event_type = 'purchase') AS purchases FROM curated GROUP BY product_id, user_id) raw,
(SELECT avg(ln(1 + views)) AS m, stddev_samp(ln(1 + views)) AS s FROM products) WHERE views > 0""",
        _PRODUCTS,
    )
)
def scoring_warnings(spark, folder):
    """The rules that raw counts break, whether they are out of domain, and a feature standardized with saved parameters."""
    saved = {r.feature: (r.mean, r.std) for r in clusters.scaler_parameters(products(spark, folder), ("log_views",)).collect()}
    raw = features.product_stats(curated(spark, folder), KEYS).where("views > 0").withColumns({"recent_views": F.col("views"), "item": F.concat_ws("/", *KEYS)})
    marked = raw.withColumns(S.feature_columns()).withColumn("warnings", S.domain_warnings(2))
    z = F.round(S.standardized("log_views", *saved["log_views"]), 9)
    return marked.select("item", F.array_join("warnings", ",").alias("warnings"), (F.size("warnings") > 0).alias("out_of_domain"), z.alias("z_log_views"))


@query()
def logistic_reference(spark, folder):
    """Test metrics of logistic regression, fitted on the fit part, at the threshold of the best F1 among 201 quantiles of the validation scores."""
    rows = durable(catalog.fit_validation(labels(spark, folder), "product_id", 11)).withColumn("item", F.concat_ws("/", *KEYS))
    columns = (*S.FEATURES, "recent_view_share")
    scaled = clusters.scaler(rows.where("part = 'fit'"), columns).transform(rows)
    model = registry.fit_logistic(scaled.where("part = 'fit'").select("z", "label"))
    scored = durable(registry.logistic_scores(model, scaled, "item", "part", "label"))
    validation = scored.where("part = 'validation'")
    best = evaluate.at_thresholds(validation, registry.quantile_thresholds(validation)).orderBy(F.desc("f1"), F.desc("threshold")).limit(1).select("threshold")
    judged = scored.where("part = 'test'").crossJoin(F.broadcast(best)).withColumn("prediction", (F.col("score") >= F.col("threshold")).cast("int"))
    return evaluate.binary_metrics(judged, "threshold")


@query()
def raw_votes(spark, folder):
    """Vote shares for raw counts by a neighbour model with saved parameters, with warnings."""
    known = durable(catalog.final_train_set(catalog.fit_validation(labels(spark, folder), "product_id", 11), *KEYS).withColumn("item", F.concat_ws("/", *KEYS)))
    parameters = {r.feature: (r.mean, r.std) for r in clusters.scaler_parameters(known, S.FEATURES).collect()}
    train = registry.standardize(known, parameters, "row").join(known.select("row", F.col("item").alias("id"), "label"), "row")
    raw = features.product_stats(curated(spark, folder), KEYS).withColumns({"recent_views": F.col("views"), "item": F.concat_ws("/", *KEYS)})
    return registry.score_raw_neighbours(raw, parameters, train, 15, 0.4, 2, "item").select("item", "vote_share", "prediction", "warnings", "out_of_domain")


@query(with_sql("SELECT CAST(0 AS BIGINT) AS differing, count(*) AS n_rows FROM test_snapshot", *_BOTH))
def classifier_replay(spark, folder):
    """A neighbour model written as artifacts, read back and scored again: how many votes differ by more than 1e-12."""
    rows = durable(labels(spark, folder).withColumn("item", F.concat_ws("/", *KEYS)))
    known = durable(numbered(rows.where("split = 'train'"), *KEYS))
    parameters = clusters.scaler_parameters(known, S.FEATURES)

    def scores(train, scaling):
        saved = {r.feature: (r.mean, r.std) for r in scaling.collect()}
        asked = registry.standardize(rows.where("split = 'test'"), saved, "item").withColumnRenamed("item", "query_id")
        points = registry.standardize(train, saved, "row").join(train.select("row", F.col("item").alias("id")), "row")
        return neighbours.vote_share(neighbours.exact(points, asked, 15), train.select(F.col("row").alias("neighbour_row"), "label"), 15, 0.4)

    path = writers.write_model(spark, new_folder(spark, "models"), "m1", "knn", {}, {"train": known, "scaling": parameters, "predictions": scores(known, parameters)}, k=15, threshold=0.4)
    saved = {name: spark.read.parquet(f"{path}/{name}") for name in ("train", "scaling", "predictions")}
    wrong = registry.replay(saved["predictions"], scores(saved["train"], saved["scaling"]), "query_id", ("vote_share", "prediction"))
    return wrong.agg(F.count("*").alias("differing")).crossJoin(saved["predictions"].agg(F.count("*").alias("n_rows")))


@query()
def projection(spark, folder):
    """Two principal components of the standardized features."""
    rows = _scaled(spark, folder)
    out = PCA(k=2, inputCol="z", outputCol="p").fit(rows).transform(rows)
    return out.select("item", vector_to_array("p")[0].alias("x"), vector_to_array("p")[1].alias("y"))
