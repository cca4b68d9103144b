"""K-Means on standardized features: sweeps, baselines, profiles and assignment from saved parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.functions.numbering import numbered


def scaler(rows: DataFrame, columns: tuple[str, ...] = S.FEATURES) -> PipelineModel:
    """Assemble and standardize: mean 0 and n-1 standard deviation 1, fitted on `rows` alone."""
    stages = [VectorAssembler(inputCols=list(columns), outputCol="assembled"), StandardScaler(inputCol="assembled", outputCol="z", withMean=True, withStd=True)]
    return Pipeline(stages=stages).fit(rows)


def scaler_parameters(rows: DataFrame, columns: tuple[str, ...] = S.FEATURES) -> DataFrame:
    """`(feature, mean, std)`, which any engine can apply."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")) for c in columns]
    return rows.agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("x")).select("x.*")


def _silhouette(rows: DataFrame, label: str = "cluster") -> float:
    return ClusteringEvaluator(featuresCol="z", predictionCol=label, metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(rows)


def fit(rows: DataFrame, k: int, seed: int) -> KMeansModel:
    return KMeans(featuresCol="z", predictionCol="cluster", k=k, seed=seed, initMode="k-means||", maxIter=50).fit(rows)


def sweep(rows: DataFrame, ks: tuple[int, ...], seeds: tuple[int, ...]) -> DataFrame:
    """`(k, seed, inertia, silhouette, iterations, least_size)` of every fit.

    `rows` should be a written table, not a cached one: a fit holds the vectors of its iterations itself only if its input is not cached.
    """
    out = []
    for k in ks:
        for seed in seeds:
            model = fit(rows, k, seed)
            out.append((k, seed, float(model.summary.trainingCost), float(_silhouette(model.transform(rows))), int(model.summary.numIter), int(min(model.summary.clusterSizes))))
    return rows.sparkSession.createDataFrame(out, "k int, seed int, inertia double, silhouette double, iterations int, least_size long")


def sweep_summary(table: DataFrame) -> DataFrame:
    return table.groupBy("k").agg(F.avg("silhouette").alias("mean_silhouette"), F.stddev_samp("silhouette").alias("std_silhouette"), F.avg("inertia").alias("mean_inertia"), F.min("least_size").alias("least_size"))


def choose(summary: DataFrame) -> DataFrame:
    """The row of the highest mean silhouette at six places; ties to the smaller k."""
    return summary.orderBy(F.desc(F.round("mean_silhouette", 6)), "k").limit(1)


def centers(model: KMeansModel, spark: SparkSession, columns: tuple[str, ...] = S.FEATURES) -> DataFrame:
    """`(cluster, center)` in standardized space, a row a cluster."""
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")


def assign(rows: DataFrame, center_table: DataFrame, key: str, vector: str = "features") -> DataFrame:
    """Nearest center of each row from saved centers, with all distances; ties to the lower cluster.

    The center table has one row a cluster and is joined as a broadcast array.
    """
    packed = center_table.agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("centers"))
    distances = F.transform("centers", lambda c: F.struct(S.squared_distance(F.col(vector), c["center"]).alias("d"), c["cluster"].alias("c")))
    out = rows.select(key, vector).crossJoin(F.broadcast(packed)).withColumn("ds", distances)
    return out.select(key, F.array_min("ds")["c"].alias("cluster"), F.transform("ds", lambda x: x["d"]).alias("distances"))


def as_features(rows: DataFrame, *keep: str) -> DataFrame:
    """The scaled vector as an array column beside the columns to keep."""
    return rows.select(*keep, vector_to_array("z").alias("features"))


def permuted(rows: DataFrame, columns: tuple[str, ...], key: str, seed: int) -> DataFrame:
    """Every column permuted on its own by a hash order, so that only their joint structure is lost.

    The columns' values meet by their places in one aggregate; joins would send those that are small enough to the driver.
    """
    parts = []
    for c in columns:
        own = numbered(rows.select(F.col(key).alias("_key"), c), F.xxhash64("_key", F.lit(c), F.lit(seed)), "_key")
        parts.append(own.select("row", *[F.col(x) if x == c else F.lit(None).cast(rows.schema[x].dataType).alias(x) for x in columns]))
    return reduce(DataFrame.unionByName, parts).groupBy("row").agg(*[F.max(c).alias(c) for c in columns])


def price_groups(rows: DataFrame, k: int, price: str, key: str) -> DataFrame:
    """k groups of equal size by price: the cut is at the exact ranks, without a window over all rows."""
    ranked = numbered(rows, price, key, name="_row")
    n = rows.agg(F.count("*").alias("_n"))
    small, left = F.floor(F.col("_n") / k), F.col("_n") % k
    edge = left * (small + 1)
    tile = F.when(F.col("_row") < edge, F.floor(F.col("_row") / (small + 1))).otherwise(left + F.floor((F.col("_row") - edge) / F.greatest(small, F.lit(1))))
    return ranked.crossJoin(F.broadcast(n)).withColumn("cluster", tile.cast("int")).drop("_row", "_n")


def profile(assigned: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Size, rounded means and share of products that sold, of each cluster."""
    return assigned.groupBy("cluster").agg(F.count("*").alias("size"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in columns], F.round(F.avg((F.col("purchases") > 0).cast("double")), 6).alias("purchase_share"))


def top_roots(assigned: DataFrame, n: int = 3) -> DataFrame:
    """The n most frequent category roots of each cluster; ties in order of root."""
    counts = assigned.groupBy("cluster", S.or_unknown("category_root").alias("category_root")).agg(F.count("*").alias("products"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("products"), "category_root"))
    return counts.withColumn("place", rank).where(F.col("place") <= n)


def quantile_profile(assigned: DataFrame, column: str) -> DataFrame:
    points = F.percentile_approx(column, [0.25, 0.5, 0.75], 10_000)
    return assigned.groupBy("cluster").agg(points.alias("p")).select("cluster", *[F.col("p")[i].alias(name) for i, name in enumerate(("p25", "p50", "p75"))])


def named(profiles: DataFrame) -> DataFrame:
    """Names of two clusters, hot and normal, if views and purchase share agree which is hotter; else none."""
    both = profiles.agg(F.count("*").alias("n"), F.max_by("cluster", "mean_views").alias("by_views"), F.max_by("cluster", "purchase_share").alias("by_share"))
    sure = (F.col("n") == 2) & (F.col("by_views") == F.col("by_share"))
    return profiles.crossJoin(F.broadcast(both)).select("cluster", F.when(sure, F.when(F.col("cluster") == F.col("by_views"), "hot").otherwise("normal")).alias("name"))
