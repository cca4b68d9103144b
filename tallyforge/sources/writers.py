"""Writing runs once and for all: tables by date or split, small exports, records, and bundles with a manifest."""

from __future__ import annotations

import json

from pyspark.ml.util import JavaMLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.functions.tables import path_exists
from tallyforge.operators import compare, metrics, quality, revenue

from .commits import create, new_run, run_path
from .digests import file_digests


def require_new(spark: SparkSession, path: str) -> None:
    """Raise if the path exists, before any work is done."""
    if path_exists(spark, path):
        raise FileExistsError(path)


def write_curated(events: DataFrame, root: str, run_id: str) -> str:
    """Curated events by date. Rows are rebalanced by date: small dates share a task, a large date is split over many."""
    with new_run(events.sparkSession, root, run_id) as staged:
        events.hint("rebalance", "event_date").write.partitionBy("event_date").parquet(staged)
    return run_path(root, run_id)


def write_small(table: DataFrame, root: str, run_id: str) -> str:
    """An aggregate of at most a few thousand rows, as one file."""
    with new_run(table.sparkSession, root, run_id) as staged:
        table.coalesce(1).write.parquet(staged)
    return run_path(root, run_id)


def write_labels(labels: DataFrame, root: str, run_id: str) -> str:
    with new_run(labels.sparkSession, root, run_id) as staged:
        labels.write.partitionBy("split").parquet(staged)
    return run_path(root, run_id)


def export_csv(table: DataFrame, folder: str, *order: str, money: tuple[str, ...] = ()) -> None:
    """A small table as one ordered CSV file with a header; nulls are empty.

    For each `<name>_minor` column of `money` a column `<name>` shows the cents as an amount.
    """
    shown = table.withColumns({c.removesuffix("_minor"): S.money_text(c) for c in money}) if money else table
    shown.orderBy(*order).coalesce(1).write.mode("errorifexists").option("header", True).option("nullValue", "").option("escape", "\"").csv(folder)


def write_record(spark: SparkSession, folder: str, **record) -> None:
    """A run record as one JSON row: parameters, stages, counts, status."""
    row = spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "record string")
    row.coalesce(1).write.mode("errorifexists").text(folder)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A small JSON document as one file of that name, which must not exist."""
    if not create(spark, path, json.dumps(value, sort_keys=True, indent=1, default=str)):
        raise FileExistsError(path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """`(path, bytes, sha256)` of every file below a folder: data, model files, JSON and markers."""
    return file_digests(spark, folder)


def serving_tables(events: DataFrame, other_revenue: DataFrame) -> dict[str, DataFrame]:
    """The tables of a published run, each in order: revenue with codes, funnels, trend, parity with another result, quality."""
    own, funnel = revenue.revenue(events), metrics.funnel_by_category(events)
    return {
        "revenue": revenue.with_codes(own, funnel).orderBy("group_key"),
        "funnel_by_category": funnel.orderBy("category_id"),
        "funnel_by_brand": metrics.funnel_by_brand(events).orderBy("brand"),
        "trend_by_hour": metrics.trend_by_hour(events).orderBy("event_date", "event_hour"),
        "parity": compare.parity(own, other_revenue),
        "parity_differences": compare.first_differences(own, other_revenue),
        "quality": quality.profile(events),
        "events_per_type": quality.events_per_type(events).orderBy("event_type"),
    }


def _counted(spark: SparkSession, folder: str, tables: dict[str, str]) -> DataFrame | None:
    """`(name, rows)` of the tables of a bundle, by name and format."""
    counts = None
    for name, kind in tables.items():
        rows = spark.read.format(kind).option("header", True).option("multiLine", True).option("escape", "\"").load(f"{folder}/{name}")
        one = rows.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


def _with_manifest(spark: SparkSession, staged: str, tables: dict[str, str]) -> None:
    """The manifest of a bundle, written last: `(path, name, bytes, sha256, rows)` of every file, paths below the run's folder."""
    below = F.regexp_extract("path", f"/{staged.rsplit('/', 1)[-1]}/(.*)$", 1)
    listed = manifest(spark, staged).withColumn("path", below).withColumn("name", F.regexp_replace("path", "/[^/]*$", ""))
    counts = _counted(spark, staged, tables)
    whole = listed.join(counts.hint("merge"), "name", "left") if counts is not None else listed.withColumn("rows", F.lit(None).cast("long"))
    whole.select("path", "name", "bytes", "sha256", "rows").coalesce(1).write.parquet(f"{staged}/_manifest_table")


def publish(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame], models: dict[str, str] | None = None, labels: DataFrame | None = None, key: str = "item") -> str:
    """Publish small result tables and model runs as one run: it appears whole, with a manifest of every file.

    `models` names folders of `write_model` by kind. Of each the record, the Spark models and the tables are taken:
    tables of few rows and those with an order as CSV in that order, predictions joined to `labels` by `key` and `split`.
    `ml/models.json` lists the records.
    """
    with new_run(spark, root, run_id) as staged:
        for name, table in tables.items():
            table.coalesce(1).write.parquet(f"{staged}/{name}")
        kinds, records = dict.fromkeys(tables, "parquet"), []
        for kind, path in (models or {}).items():
            record = json.loads(spark.read.text(f"{path}/record").first().value)
            write_json(spark, f"{staged}/ml/{kind}/metadata.json", record)
            records.append(record)
            for name in record["models"]:
                copy_folder(spark, f"{path}/model_{name}", f"{staged}/ml/{kind}/model_{name}")
            for name in record["tables"]:
                rows = spark.read.parquet(f"{path}/{name}")
                flat = rows.select([F.to_json(c).alias(c) if rows.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in rows.columns])
                export_csv(flat, f"{staged}/ml/{kind}/{name}", *[c for c in ("row", key, "k", "cluster", "feature") if c in rows.columns][:1] or rows.columns[:1])
                kinds[f"ml/{kind}/{name}"] = "csv"
            if "predictions" in record["tables"] and labels is not None:
                shown = spark.read.parquet(f"{path}/predictions").withColumnRenamed("query_id", key).join(labels.hint("merge"), key)
                export_csv(shown, f"{staged}/ml/{kind}/products", key)
                kinds[f"ml/{kind}/products"] = "csv"
        write_json(spark, f"{staged}/ml/models.json", records)
        _with_manifest(spark, staged, kinds)
    return run_path(root, run_id)


def copy_folder(spark: SparkSession, source: str, target: str) -> None:
    """Copy a model's small files as they are."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    a, b = hadoop.Path(source), hadoop.Path(target)
    hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def write_model(spark: SparkSession, root: str, run_id: str, kind: str, models: dict[str, JavaMLWritable], tables: dict[str, DataFrame], **record) -> str:
    """Write a model run: Spark ML models and tables (scaler parameters, centers, assignments, train set, predictions) by
    name, and their record."""
    with new_run(spark, root, run_id) as staged:
        for name, model in models.items():
            model.write().save(f"{staged}/model_{name}")
        for name, table in tables.items():
            table.write.parquet(f"{staged}/{name}")
        write_record(spark, f"{staged}/record", model_type=kind, model_run=run_id, models=sorted(models), tables=sorted(tables), **record)
    return run_path(root, run_id)
