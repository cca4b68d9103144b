"""What a data set holds before a job runs on it: preflight, profile, group dictionary, fingerprint, samples."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.functions.numbering import numbered
from tallyforge.sources.digests import file_digests, manifest_digest

from .classify import FIELDS, MAX_LINE_BYTES, classify_purchases


def preflight(lines: DataFrame, mode: str = "category_id", file_col: str = "file", line_col: str = "value", order: str = "place") -> DataFrame:
    """Per file: lines, headers, whether its first line by `order` is the header, valid purchases, malformed lines,
    and invalid keys apart from over-long ones."""
    rows = classify_purchases(lines, mode, line_col)
    is_reason = lambda r: F.col("reason") == r
    long_key = is_reason("INVALID_GROUP") & S.overlong_key(mode, "category_id", "category_code")
    return rows.groupBy(file_col).agg(
        F.count("*").alias("n_lines"),
        F.count_if(is_reason("HEADER")).alias("headers"),
        F.min_by(is_reason("HEADER"), order).alias("header_first"),
        F.count_if(is_reason("VALID_PURCHASE")).alias("valid_purchases"),
        F.count_if(is_reason("MALFORMED_CSV")).alias("malformed"),
        F.count_if(is_reason("INVALID_GROUP") & ~long_key).alias("invalid_groups"),
        F.count_if(long_key).alias("overlong_keys"),
    )


def first_errors(lines: DataFrame, order: str, n: int = 20, line_col: str = "value") -> DataFrame:
    """The first malformed lines by `order`; for lines of files see `sources.lines.first_errors`."""
    bad = classify_purchases(lines, "category_id", line_col).where("reason = 'MALFORMED_CSV'")
    return bad.orderBy(order).limit(n).select(order, line_col)


def group_profile(lines: DataFrame, mode: str = "category_id", max_keys: int = 100_000, line_col: str = "value") -> DataFrame:
    """Valid purchases per group; raises if there are more than `max_keys` groups."""
    counts = classify_purchases(lines, mode, line_col).where("group_key is not null").groupBy("group_key").agg(F.count("*").alias("purchases"))
    n = counts.agg(F.count("*").alias("n_keys"))
    return counts.crossJoin(F.broadcast(n)).where(F.assert_true(F.col("n_keys") <= max_keys, F.lit("too many groups")).isNull()).drop("n_keys")


def dictionary(keys: DataFrame, key: str = "group_key") -> DataFrame:
    """`(key, dense_id)`: the distinct keys in order with ids from 0."""
    return numbered(keys.select(key).where(F.col(key).isNotNull()).distinct(), key, name="dense_id")


def dictionary_checksum(words: DataFrame, key: str = "group_key", max_keys: int = 100_000) -> DataFrame:
    """SHA-256 over the ordered keys of a dictionary; one of more than `max_keys` keys raises before they are gathered."""
    if words.limit(max_keys + 1).count() > max_keys:
        raise ValueError(f"the dictionary has more than {max_keys} keys")
    ordered = F.sort_array(F.collect_list(F.struct("dense_id", key)))
    return words.agg(F.count("*").alias("n_keys"), F.sha2(F.array_join(F.transform(ordered, lambda x: x[key]), "\n"), 256).alias("checksum"))


def input_manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """`(uri, bytes, sha256)` of every input file below the paths, of any size; names of `_` or `.` are no input."""
    name = F.element_at(F.split("path", "/"), -1)
    return file_digests(spark, *paths).where(~F.substring(name, 1, 1).isin("_", ".")).select(F.col("path").alias("uri"), "bytes", "sha256")


def manifest_fingerprint(manifest: DataFrame) -> DataFrame:
    """One row `(n_files, n_bytes, fingerprint)`: a digest of the manifest in order of uri, of any number of files."""
    return manifest_digest(manifest)


def policy_hash(mode: str) -> str:
    """A digest of what decides which lines count: fields, event types, limits and the group mode."""
    rules = {"fields": FIELDS, "types": S.EVENT_TYPES, "line_bytes": MAX_LINE_BYTES, "key_bytes": S.MAX_KEY_BYTES, "unknown": S.UNKNOWN, "time": S.TIME_FORMAT, "mode": mode}
    return hashlib.sha256(json.dumps(rules, sort_keys=True).encode()).hexdigest()


def fingerprint(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Order-insensitive fingerprint of a data set: lines, bytes and a sum of 60-bit digests of the lines."""
    head = F.conv(F.substring(F.sha2(line_col, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return lines.agg(F.count("*").alias("n_lines"), F.sum(F.octet_length(line_col)).alias("n_bytes"), F.sum(head).cast("string").alias("digest_sum"))


def sample_rows(rows: DataFrame, parts: list[Column], rate: float) -> DataFrame:
    """The rows whose digest of `parts` falls below the rate; the same rows whatever the partitioning."""
    return rows.where(S.digest_bucket(parts, 1_000_000) < int(rate * 1_000_000))


def sample_entities(rows: DataFrame, key: str, rate: float, seed: int = 1) -> DataFrame:
    """All rows of a sample of keys, so that sessions and users stay whole."""
    return sample_rows(rows, [F.col(key).cast("string"), F.lit(str(seed))], rate)


def capped(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows, those of the smallest seeded SHA-256 digest of their key."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(n)


def fit_validation(rows: DataFrame, key: str, seed: int, validation_percent: int = 20, portable: bool = False) -> DataFrame:
    """Add `part`: fit or validation by the key's hash; rows of the test split stay test.

    The hash is Spark's 64-bit one or, if `portable`, a digest that any engine has.
    """
    bucket = S.digest_bucket([F.col(key).cast("string"), F.lit(str(seed))], 100) if portable else S.hash_bucket(key, seed)
    part = F.when(F.col("split") == "test", "test").when(bucket < validation_percent, "validation").otherwise("fit")
    return rows.withColumn("part", part)


def final_train_set(parts: DataFrame, *order: str) -> DataFrame:
    """The fit and validation parts together, with a `row` number from 0 in the given total order."""
    both = parts.where("part = 'fit'").unionByName(parts.where("part = 'validation'"))
    return numbered(both, *order)
