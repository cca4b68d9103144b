"""Queries: product features, labels and the evaluation of predictions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import catalog, evaluate, features

from .base import query
from .behaviour import FEATURE_DAYS, KEYS, LABEL_DAYS, MIN_VIEWS, TEST_T0, TRAIN_T0, curated, with_sql


def _stats(source: str, keys: str) -> str:
    rest = ", ".join(f"max({c}) AS {c}" for c in features.DESCRIPTIONS if c not in keys)
    return f"""SELECT {keys}, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'cart') AS carts, count(*) FILTER (event_type = 'purchase') AS purchases,
  CAST(coalesce(sum(price_minor) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS revenue_minor, count(DISTINCT user_id) AS distinct_users,
  quantile_disc(price_minor, 0.5) / 100 AS median_price, {rest} FROM (SELECT *, split_part(category_code, '.', 1) AS category_root FROM {source}) GROUP BY {keys}"""


_FEATURES = """round(ln(1 + views), 9) AS log_views, round(ln(1 + carts), 9) AS log_carts, round(ln(1 + purchases), 9) AS log_purchases,
  round(carts / views, 9) AS cart_rate, round(purchases / views, 9) AS purchase_rate, round(ln(1 + median_price), 9) AS log_median_price, round(ln(1 + distinct_users), 9) AS log_distinct_users"""


def rounded(df, columns=S.FEATURES):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(with_sql(_stats("curated", "product_id")))
def product_stats(spark, folder):
    return features.product_stats(curated(spark, folder))


@query(with_sql(f"SELECT *, {_FEATURES} FROM ({_stats('curated', 'product_id, user_id')}) WHERE views >= {MIN_VIEWS}"))
def product_features(spark, folder):
    return rounded(features.with_features(features.product_stats(curated(spark, folder), KEYS), MIN_VIEWS))


@query(with_sql("SELECT unnest([0.5, 0.75, 0.9, 0.95, 0.99])::DOUBLE AS q, unnest(quantile_disc(views, [0.5, 0.75, 0.9, 0.95, 0.99])) AS value FROM (SELECT count(*) FILTER (event_type = 'view') AS views FROM curated GROUP BY product_id)"))
def view_quantiles(spark, folder):
    return features.quantiles(features.product_stats(curated(spark, folder)), "views")


_ONE = "SELECT '{0}' AS feature, count({0}) AS n, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, round(min({0}), 6) AS least, round(max({0}), 6) AS greatest FROM f"


@query(with_sql(" UNION ALL ".join(_ONE.format(c) for c in S.FEATURES), f"f AS (SELECT *, {_FEATURES} FROM ({_stats('curated', 'product_id, user_id')}) WHERE views >= {MIN_VIEWS})"))
def feature_summary(spark, folder):
    found = features.describe(features.with_features(features.product_stats(curated(spark, folder), KEYS), MIN_VIEWS))
    return found.select("feature", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "greatest")])


@query(with_sql(f"SELECT count(*) AS kept, count(category_code) AS with_code, count(*) FILTER (purchases > 0) AS with_purchase FROM ({_stats('curated', 'product_id, user_id')}) WHERE views >= {MIN_VIEWS}"))
def kept_counts(spark, folder):
    return features.kept_counts(features.with_features(features.product_stats(curated(spark, folder), KEYS), MIN_VIEWS))


def _window(name: str, start: str, end: str) -> str:
    return f"{name} AS (SELECT * FROM curated WHERE event_time >= TIMESTAMP '{start} 00:00:00' AND event_time < TIMESTAMP '{end} 00:00:00')"


@query(with_sql("SELECT product_id, count(*) AS recent_views FROM w WHERE event_type = 'view' GROUP BY product_id", _window("w", features._shift(TRAIN_T0, -LABEL_DAYS), TRAIN_T0)))
def recent_views(spark, folder):
    return features.recent_views(curated(spark, folder), TRAIN_T0, LABEL_DAYS)


@query(with_sql("SELECT product_id, count(*) FILTER (event_type = 'purchase') AS future_purchases FROM w GROUP BY product_id", _window("w", TRAIN_T0, features._shift(TRAIN_T0, LABEL_DAYS))))
def future_purchases(spark, folder):
    return features.future_purchases(curated(spark, folder), TRAIN_T0, LABEL_DAYS)


def _snapshot(split: str, t0: str) -> list[str]:
    keys = ", ".join(KEYS)
    on = lambda t: " AND ".join(f"{t}.{k} = s.{k}" for k in KEYS)
    return [
        _window(f"{split}_known", features._shift(t0, -FEATURE_DAYS), t0),
        _window(f"{split}_recent", features._shift(t0, -LABEL_DAYS), t0),
        _window(f"{split}_future", t0, features._shift(t0, LABEL_DAYS)),
        f"{split}_r AS (SELECT {keys}, count(*) AS recent_views FROM {split}_recent WHERE event_type = 'view' GROUP BY {keys})",
        f"{split}_f AS (SELECT {keys}, count(*) FILTER (event_type = 'purchase') AS future_purchases FROM {split}_future GROUP BY {keys})",
        f"""{split}_snapshot AS (SELECT s.*, coalesce(r.recent_views, 0) AS recent_views, {_FEATURES}, round(coalesce(r.recent_views, 0) / views, 9) AS recent_view_share,
  coalesce(f.future_purchases, 0) AS future_purchases, CASE WHEN coalesce(f.future_purchases, 0) > 0 THEN 1 ELSE 0 END AS label, '{split}' AS split, '{t0}' AS t0
FROM ({_stats(f"{split}_known", keys)}) s LEFT JOIN {split}_r r ON {on("r")} LEFT JOIN {split}_f f ON {on("f")} WHERE views >= {MIN_VIEWS})""",
    ]


_BOTH = [*_snapshot("train", TRAIN_T0), *_snapshot("test", TEST_T0), "labelled AS (SELECT * FROM train_snapshot UNION ALL BY NAME SELECT * FROM test_snapshot)"]


def labels(spark, folder, events=None):
    """The labelled table of the folder's events, or of those that are given."""
    return features.label_table(curated(spark, folder) if events is None else events, TRAIN_T0, TEST_T0, FEATURE_DAYS, LABEL_DAYS, MIN_VIEWS, KEYS)


@query(with_sql("SELECT * FROM train_snapshot", *_BOTH))
def label_snapshot(spark, folder):
    out = features.snapshot(curated(spark, folder), TRAIN_T0, FEATURE_DAYS, LABEL_DAYS, MIN_VIEWS, "train", KEYS)
    return rounded(out, (*S.FEATURES, "recent_view_share"))


@query(with_sql("SELECT * FROM labelled", *_BOTH))
def label_table(spark, folder):
    return rounded(labels(spark, folder), (*S.FEATURES, "recent_view_share"))


@query(with_sql("SELECT split, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives, round(sum(label) / count(*), 6) AS rate FROM labelled GROUP BY split", *_BOTH))
def class_balance(spark, folder):
    return features.class_balance(labels(spark, folder))


@query(
    with_sql(
        """SELECT (SELECT min(event_date) FROM curated) AS first_date, (SELECT max(event_date) FROM curated) AS last_date,
  (SELECT count(*) FROM train_known) AS feature_events, (SELECT max(event_time) FROM train_known) AS last_feature_time,
  (SELECT count(*) FROM train_future) AS label_events, (SELECT min(event_time) FROM train_future) AS first_label_time""",
        *_snapshot("train", TRAIN_T0)[:3],
    )
)
def label_coverage(spark, folder):
    return features.coverage(curated(spark, folder), TRAIN_T0, FEATURE_DAYS, LABEL_DAYS)


def predictions(spark, folder):
    """The history rule on all labelled rows, with a graded score beside it."""
    rows = evaluate.history_rule(labels(spark, folder))
    return rows.withColumn("score", F.round((F.col("purchases") + 1) / (F.col("views") + 2) + F.col("carts") / 100, 6))


_PREDICTED = [*_BOTH, "predicted AS (SELECT *, CASE WHEN purchases > 0 THEN 1 ELSE 0 END AS prediction, round((purchases + 1) / (views + 2) + carts / 100, 6) AS score FROM labelled)"]
_COUNTS = """SELECT split, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM {} GROUP BY split"""
_RATES = """CASE WHEN tp + fp + fn + tn > 0 THEN round((tp + tn) / (tp + fp + fn + tn), 9) ELSE 0 END AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 9) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 9) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 9) ELSE 0 END AS f1,
  round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / 2, 9) AS balanced_accuracy"""
_RATE_NAMES = ("accuracy", "precision", "recall", "f1", "balanced_accuracy")


@query(with_sql(f"SELECT *, {_RATES} FROM ({_COUNTS.format('predicted')})", *_PREDICTED))
def history_rule_metrics(spark, folder):
    return rounded(evaluate.binary_metrics(predictions(spark, folder), "split"), _RATE_NAMES)


@query(with_sql(f"SELECT *, {_RATES} FROM ({_COUNTS.format('m')})", *_PREDICTED, "m AS (SELECT split, label, (SELECT CASE WHEN avg(label) > 0.5 THEN 1 ELSE 0 END FROM labelled) AS prediction FROM labelled)"))
def majority_metrics(spark, folder):
    return rounded(evaluate.binary_metrics(evaluate.majority(labels(spark, folder)), "split"), _RATE_NAMES)


@query(with_sql("SELECT label, prediction, count(*) AS n_rows FROM predicted GROUP BY label, prediction", *_PREDICTED))
def confusion_matrix(spark, folder):
    return evaluate.confusion(predictions(spark, folder))


_CURVE = [
    *_PREDICTED,
    "each AS (SELECT split, score, sum(label) AS pos, sum(1 - label) AS neg FROM predicted GROUP BY split, score)",
    """curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY split) AS all_pos FROM each
  WINDOW w AS (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING))""",
]


@query(with_sql("SELECT split, CASE WHEN max(all_pos) > 0 THEN round(sum(pos * tp / (tp + fp)) / max(all_pos), 9) ELSE 0 END AS average_precision FROM curve GROUP BY split", *_CURVE))
def average_precision(spark, folder):
    return rounded(evaluate.average_precision(predictions(spark, folder), "split"), ("average_precision",))


@query(with_sql("SELECT split, score AS threshold, f1 FROM (SELECT *, round(2 * tp / (tp + fp + all_pos), 12) AS f1, row_number() OVER (PARTITION BY split ORDER BY round(2 * tp / (tp + fp + all_pos), 12) DESC, score DESC) AS r FROM curve) WHERE r = 1", *_CURVE))
def best_threshold(spark, folder):
    return evaluate.best_threshold(predictions(spark, folder), "split")


REPLICATES = 1000


def _test_rows(spark, folder):
    """Test rows with the history rule, a cut of the graded score as another rule, and a key."""
    rows = predictions(spark, folder).where("split = 'test'")
    return rows.select(F.concat_ws("/", *KEYS).alias("i"), "label", "prediction", "score", (F.col("score") >= 0.5).cast("int").alias("other"))


_CUMULATIVE = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
_WEIGHT = " + ".join(f"CASE WHEN u >= {c!r}::DOUBLE THEN 1 ELSE 0 END" for c in _CUMULATIVE)
_DRAWS = [
    *_PREDICTED,
    "t AS (SELECT product_id || '/' || user_id AS i, label, prediction, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS other FROM predicted WHERE split = 'test')",
    f"u AS (SELECT b.b, t.*, ('0x' || substr(sha256('7:' || b.b || ':' || t.i), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM t, (SELECT unnest(range({REPLICATES})) AS b) b)",
    f"d AS (SELECT *, {_WEIGHT} AS w FROM u)",
    """counts AS (SELECT b, coalesce(sum(w) FILTER (label = 1 AND prediction = 1), 0) AS tp, coalesce(sum(w) FILTER (label = 0 AND prediction = 1), 0) AS fp, coalesce(sum(w) FILTER (label = 1 AND prediction = 0), 0) AS fn,
  coalesce(sum(w) FILTER (label = 1 AND other = 1), 0) AS tp2, coalesce(sum(w) FILTER (label = 0 AND other = 1), 0) AS fp2, coalesce(sum(w) FILTER (label = 1 AND other = 0), 0) AS fn2, sum(w * score) / sum(w) AS mean FROM d GROUP BY b)""",
    """f AS (SELECT b, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
  CASE WHEN 2 * tp2 + fp2 + fn2 > 0 THEN 2 * tp2 / (2 * tp2 + fp2 + fn2) ELSE 0 END AS other_f1, mean FROM counts)""",
]


@query(with_sql("SELECT CAST(b AS INTEGER) AS b, round(f1, 9) AS f1 FROM f", *_DRAWS))
def bootstrap_f1(spark, folder):
    return rounded(evaluate.bootstrap_f1(_test_rows(spark, folder), REPLICATES, 7), ("f1",))


@query(with_sql("SELECT round(quantile_cont(f1, 0.025), 9) AS low, round(quantile_cont(f1, 0.975), 9) AS high FROM f", *_DRAWS))
def bootstrap_interval(spark, folder):
    return rounded(evaluate.interval(evaluate.bootstrap_f1(_test_rows(spark, folder), REPLICATES, 7), "f1"), ("low", "high"))


@query(with_sql("SELECT round(quantile_cont(f1 - other_f1, 0.025), 9) AS low, round(quantile_cont(f1 - other_f1, 0.975), 9) AS high FROM f", *_DRAWS))
def bootstrap_difference_interval(spark, folder):
    return rounded(evaluate.interval(evaluate.bootstrap_difference(_test_rows(spark, folder), "other", REPLICATES, 7), "difference"), ("low", "high"))


@query(with_sql("SELECT round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM f", *_DRAWS))
def bootstrap_mean_interval(spark, folder):
    values = _test_rows(spark, folder).withColumnRenamed("score", "value")
    return rounded(evaluate.interval(evaluate.bootstrap_mean(values, REPLICATES, 7), "mean"), ("low", "high"))


_AP = [
    *_DRAWS,
    "s AS (SELECT b, score, sum(w * label) AS pos, sum(w * (1 - label)) AS neg FROM d WHERE w > 0 GROUP BY b, score)",
    """c AS (SELECT *, sum(pos) OVER v AS tp, sum(neg) OVER v AS fp, sum(pos) OVER (PARTITION BY b) AS all_pos FROM s WINDOW v AS (PARTITION BY b ORDER BY score DESC ROWS UNBOUNDED PRECEDING))""",
    "ap AS (SELECT b, CASE WHEN max(all_pos) > 0 THEN sum(pos * tp / (tp + fp)) / max(all_pos) ELSE 0 END AS ap FROM c GROUP BY b)",
]


@query(with_sql("SELECT round(quantile_cont(ap, 0.025), 9) AS low, round(quantile_cont(ap, 0.975), 9) AS high FROM ap", *_AP))
def bootstrap_precision_interval(spark, folder):
    return rounded(evaluate.interval(evaluate.bootstrap_average_precision(_test_rows(spark, folder), REPLICATES, 7), "average_precision"), ("low", "high"))


_BUCKET = "('0x' || substr(sha256(product_id || chr(0) || '11'), 1, 8))::BIGINT"
_PARTS = [*_BOTH, f"parted AS (SELECT *, CASE WHEN split = 'test' THEN 'test' WHEN (((CASE WHEN {_BUCKET} >= 2147483648 THEN {_BUCKET} - 4294967296 ELSE {_BUCKET} END) % 100) + 100) % 100 < 20 THEN 'validation' ELSE 'fit' END AS part FROM labelled)"]


@query(with_sql("SELECT part, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives FROM parted GROUP BY part", *_PARTS))
def fit_validation_parts(spark, folder):
    parts = catalog.fit_validation(labels(spark, folder), "product_id", 11, portable=True)
    return parts.groupBy("part").agg(F.count("*").alias("n_rows"), F.sum("label").alias("positives"))


@query(with_sql("SELECT product_id, user_id, part, row_number() OVER (ORDER BY product_id, user_id) - 1 AS row FROM parted WHERE part <> 'test'", *_PARTS))
def final_train_set(spark, folder):
    parts = catalog.fit_validation(labels(spark, folder), "product_id", 11, portable=True)
    return catalog.final_train_set(parts, *KEYS).select("product_id", "user_id", "part", "row")
