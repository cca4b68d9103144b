"""Reproducible shuffling and sharding by a permutation of global row numbers.

Rows are numbered in a total order of their own columns. A Feistel network permutes the numbers: it permutes the
smallest domain of a power of two that holds them, and a number that leaves the range walks on along its cycle until it
is in range again. Shard and slot are the remainder and the quotient of the permuted number, so that either way can be
computed without a table: a row's shard and slot, and the row that stands at a shard's slot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.numbering import numbered

from .shared import durable
from .words import mix

ROUNDS = 8
#: Names that the operator adds.
PLACES = ("row", "shard", "slot")


class Permutation:
    """A seeded permutation of the numbers from 0 to n - 1, and its inverse, over whole arrays."""

    def __init__(self, n: int, seed: int = 0):
        self.n, bits = n, max(2, (max(n, 2) - 1).bit_length())
        self.low, self.high = np.uint64(bits // 2), np.uint64(bits - bits // 2)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % (1 << 64)))

    def _widths(self, r: int) -> tuple[np.uint64, np.uint64]:
        """Bits of the left and of the right part before round r; the parts change places in every round."""
        return (self.high, self.low) if r % 2 == 0 else (self.low, self.high)

    def _noise(self, half: np.ndarray, r: int, bits: np.uint64) -> np.ndarray:
        return mix(mix(half + self.keys[r]) + self.keys[r]) >> (np.uint64(64) - bits)

    def _there(self, x: np.ndarray) -> np.ndarray:
        for r in range(ROUNDS):
            left_bits, right_bits = self._widths(r)
            left, right = x >> right_bits, x & ((np.uint64(1) << right_bits) - np.uint64(1))
            x = (right << left_bits) | (left ^ self._noise(right, r, left_bits))
        return x

    def _back(self, x: np.ndarray) -> np.ndarray:
        for r in reversed(range(ROUNDS)):
            left_bits, right_bits = self._widths(r)
            right, mixed = x >> left_bits, x & ((np.uint64(1) << left_bits) - np.uint64(1))
            x = ((mixed ^ self._noise(right, r, left_bits)) << right_bits) | right
        return x

    def _walk(self, step: Callable, numbers: np.ndarray) -> np.ndarray:
        if len(numbers) and (numbers.min() < 0 or numbers.max() >= self.n):
            raise ValueError(f"a number is not between 0 and {self.n - 1}")
        x = step(numbers.astype(np.uint64))
        while len(outside := np.flatnonzero(x >= np.uint64(self.n))):
            x[outside] = step(x[outside])
        return x.astype(np.int64)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The place of each row number in the shuffled order."""
        return self._walk(self._there, rows)

    def row(self, places: np.ndarray) -> np.ndarray:
        """The row number at each place of the shuffled order."""
        return self._walk(self._back, places)


def shard_and_slot(row: Column, n: int, shards: int, seed: int = 0) -> Column:
    """A struct of the shard and the slot of a row number out of n."""
    order = Permutation(n, seed)

    @F.pandas_udf("shard int, slot long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            place = order.place(b.to_numpy())
            yield pd.DataFrame({"shard": (place % shards).astype(np.int32), "slot": place // shards})

    return run(row)


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int = 0) -> Column:
    """The row number that stands at a shard's slot, computed without a look at the data."""
    order = Permutation(n, seed)

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(order.row(b.to_numpy()))

    return run(slot.cast("long") * shards + shard)


def assign(rows: DataFrame, order: tuple[str, ...], shards: int, seed: int = 0) -> DataFrame:
    """Add `row`, `shard` and `slot` to each row; shard sizes are at most one apart and slots count from 0 without gaps.

    Rows are numbered from 0 by the columns of `order`, nulls first, whatever their partitioning. Rows equal in `order`
    are numbered in any order, so name enough columns to tell apart what must be reproducible. Repeated rows are all
    placed. A number of the source row breaks ties, so that many equal rows spread over many partitions, and rows are
    written before they are numbered. Columns named row, shard or slot are replaced; an empty table stays empty.
    """
    if shards < 1:
        raise ValueError("there must be a shard at least")
    kept = durable(rows.drop(*PLACES).withColumn("_tf_source", F.monotonically_increasing_id()))
    n = kept.count()
    placed = numbered(kept, *order, "_tf_source").withColumn("_tf_place", shard_and_slot(F.col("row"), n, shards, seed))
    return placed.withColumns({"shard": F.col("_tf_place.shard"), "slot": F.col("_tf_place.slot")}).drop("_tf_source", "_tf_place")


def shard_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, size, text_crc32)`: UTF-8 bytes of the text plus 8, and its unsigned crc32; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def write_shards(rows: DataFrame, path: str, order: tuple[str, ...], shards: int, seed: int = 0, files: int = 1) -> None:
    """Write whole rows as Parquet, a folder a shard, in order of their slots; `files` parts a shard, each a range of slots."""
    placed = assign(rows, order, shards, seed)
    most = -(-placed.count() // shards)
    part = F.col("shard") * files + F.floor(F.col("slot") * files / F.lit(max(1, most))).cast("int")
    dealt = placed.withColumn("_tf_part", part).repartitionByRange(shards * files, "_tf_part").sortWithinPartitions("shard", "slot")
    dealt.drop("_tf_part").write.partitionBy("shard").parquet(path)
