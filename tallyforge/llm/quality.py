"""Quality selection by importance resampling.

Two generative models over hashed word n-grams, one of target text and one of all text, weigh each document by
the ratio of its probabilities; Gumbel noise on the logarithm and an exact threshold draw the best k without
replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import durable, utf8
from .words import gram_hashes, word_hashes

BUCKETS, SMOOTHING, FRACTION, SEED = 10_000, 1.0, 0.5, 17
#: Bound of the labelled documents that make up the target model.
TARGET_ROWS = 50_000


def buckets_of(text: bytes) -> np.ndarray:
    """The buckets of all words and word pairs of a text."""
    words = word_hashes(text)
    return np.concatenate([words % np.uint64(BUCKETS), gram_hashes(words, 2) % np.uint64(BUCKETS)]).astype(np.int64)


def ngram_counts(docs: DataFrame, text_col: str, target_col: str) -> DataFrame:
    """`(bucket, raw, target)`: counts over all texts and over those where `target_col` is true."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for text, wanted in zip(b.text, b.wanted):
                grams = np.bincount(buckets_of(text), minlength=BUCKETS)
                raw += grams
                if wanted:
                    target += grams
        some = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": some, "raw": raw[some], "target": target[some]})

    rows = docs.select(utf8(F.col(text_col)).alias("text"), F.coalesce(F.col(target_col), F.lit(False)).alias("wanted"))
    return rows.mapInPandas(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | all), smoothed; BUCKETS numbers, whatever the corpus."""
    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for r in counts.collect():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, ratios: np.ndarray, text_col: str = "text") -> DataFrame:
    """Add `log_weight`, the log of the ratio of a document's probabilities; a null or empty text has 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf(T.DoubleType())
    def weigh(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([float(shared.value[buckets_of(t)].sum()) for t in batch], dtype="float64")

    return docs.withColumn("log_weight", weigh(utf8(F.col(text_col))))


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise drawn from a hash of `key`, so that a rerun draws the same."""
    u = (F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, few: int = 2000, bins: int = 1024) -> float | None:
    """The k-th largest value of `column`, by narrowing histograms; `bins` counts a round reach the driver."""
    part = df.select(F.col(column).alias("v"))
    while True:
        s = part.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        if k < 1 or not s.n:
            return None
        if s.n <= few or s.lo == s.hi:
            return part.orderBy(F.desc("v")).limit(min(k, s.n)).agg(F.min("v")).first()[0] if s.lo != s.hi else s.lo
        bin_of = F.least(F.floor((F.col("v") - s.lo) / ((s.hi - s.lo) / bins)), F.lit(bins - 1))
        for r in part.groupBy(bin_of.alias("b")).count().orderBy(F.desc("b")).collect():
            if k <= r["count"]:
                part = part.where(bin_of == r.b)
                break
            k -= r["count"]
        else:
            return s.lo


def resample(docs: DataFrame, target_ids: DataFrame, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row per document: `(doc_id, log_weight, gumbel_key, selected)`.

    `target_ids(doc_id)` names the documents of the target model; of more than `target_rows` ids, those with the
    smallest hashes are used, so that they can be broadcast and no text is shuffled. The raw model counts all. The
    ceil(fraction * rows) largest keys are selected, and those that tie with the last. Null texts weigh 0;
    repeated rows share a key. Without target documents the weights only follow the raw model. An empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    named = target_ids.select("doc_id").where("doc_id is not null").distinct()
    wanted = named.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(target_rows).withColumn("target", F.lit(True))
    ratios = log_ratios(ngram_counts(rows.join(F.broadcast(wanted), "doc_id", "left"), "text", "target"))
    scored = log_weights(rows, ratios).select("doc_id", "log_weight")
    keyed = durable(scored.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)))
    least = kth_largest(keyed, "gumbel_key", int(np.ceil(fraction * keyed.count())))
    return keyed.withColumn("selected", F.col("gumbel_key") >= F.lit(least).cast("double") if least is not None else F.lit(False))
