"""Model records, and batch scoring of raw counts from saved parameters."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S

from . import compare, neighbours
from .clusters import assign


def latest(records: DataFrame, kind: str | None = None) -> DataFrame:
    """One row per model run, of the newest serving run that holds it: `(model_type, model_run, serving_run, ...)`."""
    rows = records.where(F.col("model_type") == kind) if kind else records
    rank = F.row_number().over(Window.partitionBy("model_type", "model_run").orderBy(F.desc("serving_run")))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def find(records: DataFrame, kind: str, run: str | None = None) -> DataFrame:
    """The record of a model run, or of the latest one."""
    rows = latest(records, kind)
    return rows.where(F.col("model_run") == run) if run else rows.orderBy(F.desc("model_run")).limit(1)


def standardize(rows: DataFrame, parameters: dict[str, tuple[float, float]], *keep: Column | str) -> DataFrame:
    """`(*keep, features)`: raw features standardized with saved means and deviations, in their order, beside the columns to keep."""
    return rows.select(*keep, F.array(*[S.standardized(c, m, s) for c, (m, s) in parameters.items()]).alias("features"))


def score_raw(raw: DataFrame, parameters: dict[str, tuple[float, float]], center_table: DataFrame, min_views: int, key: str = "product_id") -> DataFrame:
    """Clusters for a table of raw counts, with the rules each row breaks and whether it is out of domain."""
    featured = raw.withColumns(S.feature_columns())
    marked = featured.withColumn("warnings", S.domain_warnings(min_views))
    found = assign(standardize(featured, parameters, key), center_table, key)
    return marked.join(found, key).withColumn("out_of_domain", F.size("warnings") > 0)


def score_raw_neighbours(raw: DataFrame, parameters: dict[str, tuple[float, float]], train: DataFrame, k: int, threshold: float, min_views: int, key: str = "product_id") -> DataFrame:
    """Vote shares and labels for a table of raw counts by `train(row, id, features, label)`, with the rules each row breaks.

    A row whose features are undefined (no views) gets no vote.
    """
    featured = raw.where("views > 0").withColumns(S.feature_columns())
    asked = standardize(featured, parameters, key).withColumnRenamed(key, "query_id")
    found = neighbours.exact(train.select("row", "id", "features"), asked, k)
    votes = neighbours.vote_share(found, train.select(F.col("row").alias("neighbour_row"), "label"), k, threshold).withColumnRenamed("query_id", key)
    marked = raw.withColumn("warnings", S.domain_warnings(min_views))
    return marked.join(votes, key, "left").withColumn("out_of_domain", F.size("warnings") > 0)


def replay(saved: DataFrame, again: DataFrame, key: str, values: tuple[str, ...], tolerance: float = 1e-12) -> DataFrame:
    """Rows of saved predictions that scoring once more doesn't give within the tolerance: `(key, reason)`, none if all is well."""
    return compare.differences(saved, again, key, values, tolerance)


def fit_logistic(rows: DataFrame) -> LogisticRegressionModel:
    """The plain logistic reference on `z` and `label`, without regularization."""
    return LogisticRegression(featuresCol="z", labelCol="label", maxIter=100, regParam=0.0).fit(rows)


def logistic_scores(model: LogisticRegressionModel, rows: DataFrame, *keep: str) -> DataFrame:
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("score"))


def quantile_thresholds(scored: DataFrame, n: int = 201) -> DataFrame:
    """`(threshold)`: n evenly spaced quantiles of the validation scores."""
    points = [i / (n - 1) for i in range(n)]
    return scored.agg(F.percentile("score", points).alias("t")).select(F.explode(F.array_distinct("t")).alias("threshold"))
