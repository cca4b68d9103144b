"""Reading event lines, curated runs, feature tables, results and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S

from .commits import pointed
from .digests import file_digests
from .lines import physical_lines


def event_lines(spark: SparkSession, *paths: str, glob: str = "*.csv") -> DataFrame:
    """`(value, file, place)`: physical lines of the files below the paths that match `glob`; a trailing CR stays.

    `place` orders the lines of a file. No file, or a file that two paths name or hold, is an error.
    """

    lines = physical_lines(spark, *paths, glob=glob)
    return lines.select("value", "file", F.struct("block", "at").alias("place"))


def run_table(spark: SparkSession, root: str, run_id: str, required: tuple[str, ...] = ()) -> DataFrame:
    """The Parquet table of one run; lacking a required column is an error."""
    table = spark.read.parquet(f"{root}/run_id={run_id}")
    missing = [c for c in required if c not in table.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return table


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The published runs below a folder, newest first."""
    return spark.read.parquet(root).select(F.col("run_id").cast("string").alias("run_id")).distinct().orderBy(F.desc("run_id"))


def latest_run(spark: SparkSession, root: str) -> str | None:
    """The newest run by the root's pointer; a root without one is looked through."""
    if run := pointed(spark, root):
        return run
    row = runs(spark, root).first()
    return row.run_id if row else None


def result_rows(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated result, `group, total, count, average`; every amount is derived again and must agree."""
    rows = spark.read.schema("group_key string, total_revenue string, purchase_count long, average_revenue string").option("sep", "\t").csv(path)
    checked = rows.withColumn("sum_minor", S.money_minor("total_revenue"))
    right = S.money_text("sum_minor") == F.col("total_revenue")
    right = right & (S.money_text(S.average_minor("sum_minor", "purchase_count")) == F.col("average_revenue"))
    return checked.where(F.assert_true(F.coalesce(right, F.lit(False)), F.lit("a result row is wrong")).isNull())


def repeated_groups(results: DataFrame) -> DataFrame:
    return results.groupBy("group_key").agg(F.count("*").alias("n")).where("n > 1")


def verified_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """`(path, bytes, sha256, matches)`: the manifest's files as they are now below the folder; a lost or changed file doesn't match."""
    below = F.regexp_extract("path", f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/(.*)$", 1)
    now = file_digests(spark, folder).select(below.alias("_p"), F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    joined = manifest.join(now.hint("merge"), manifest.path == F.col("_p"), "left")
    return joined.select("path", "bytes", "sha256", F.coalesce((F.col("_s") == F.col("sha256")) & (F.col("_b") == F.col("bytes")), F.lit(False)).alias("matches"))


def workload(spark: SparkSession, rows: int, groups: int, mode: str = "uniform", skew: float = 0.0, purchase_rate: float = 1.0, seed: int = 1) -> DataFrame:
    """Synthetic event lines, `(value)`: keys uniform, skewed to one key, or a key a row.

    Each field hangs on the row's number alone, so the lines don't depend on the partitioning.
    """
    share = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1_000_000
    spread = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(1)), F.lit(groups))
    if mode == "cardinality":
        key = F.col("id")
    elif mode in ("uniform", "skew"):
        key = F.when(share(2) < (skew if mode == "skew" else 0.0), F.lit(0)).otherwise(spread)
    else:
        raise ValueError(f"unknown mode {mode}")
    kind = F.when(share(3) < purchase_rate, "purchase").otherwise("view")
    price = F.format_string("%d.%02d", F.pmod(F.xxhash64("id", F.lit(seed), F.lit(4)), F.lit(500)), F.pmod(F.xxhash64("id", F.lit(seed), F.lit(5)), F.lit(100)))
    line = F.concat_ws(",", F.lit("2019-10-01 00:00:00 UTC"), kind, F.concat(F.lit("p"), key.cast("string")), (key + 1).cast("string"), F.lit("a.b"), F.lit("brand"), price, F.lit("u1"), F.lit("s1"))
    return spark.range(rows).select(line.alias("value"))
