"""Near-duplicate detection by SimHash fingerprints and deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints differ in at most three bits, one
of their segments differs in at most one, so both have a signature in common: the segment itself, or the
segment with that one bit left out. Signatures are indexed, joined for equality and verified. Classes need no more links
than join them, so fingerprints of a signature that many share are compared block by block and linked as stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import durable, utf8

BITS, HALF, REACH, WORDS = 64, 32, 3, 3
#: Fingerprints of one signature that are paired at once, and of a block that meets another one.
FEW, BLOCK = 8, 2048


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the unsigned 64-bit hashes have, as a signed integer."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_of(text: bytes) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= WORDS else [b" ".join(words)]
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype="<u8"))


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint_of(t) for t in batch], dtype="int64")


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint of the whole text as a long; null and blank texts get zero."""
    return docs.withColumn(name, _fingerprints(utf8(F.col(text_col))))


def _signatures(distinct: DataFrame, fp: str) -> DataFrame:
    """`(fp, slot, part, whole, side)`: each segment of each fingerprint, whole and with each bit left out; `side` is that bit."""
    slots = distinct.select(F.col(fp).alias("fp"), F.explode(F.sequence(F.lit(0), F.lit(2 * HALF + 1))).alias("slot"))
    halves = slots.selectExpr("fp", "slot", f"slot % {HALF + 1} as bit", f"if(slot <= {HALF}, fp & 4294967295L, shiftrightunsigned(fp, {HALF})) as half")
    return halves.selectExpr("fp", "slot", f"bit = {HALF} as whole", f"if(bit = {HALF}, half, half & ~shiftleft(1L, bit)) as part", "shiftrightunsigned(half, bit) & 1 as side")


def _pairs(parts: DataFrame) -> DataFrame:
    """Pairs `(a, b)` of near fingerprints with a signature in common.

    A signature that leaves out a bit meets only across that bit's two values, and a whole segment meets only itself, so
    a pair comes up at most once a segment. The join's condition verifies the distance before a row leaves it.
    """
    left = parts.where("whole or side = 0").select(F.col("fp").alias("a"), "slot", "part", "whole")
    right = parts.where("whole or side = 1").select(F.col("fp").alias("b"), "slot", "part")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= REACH
    return left.join(right, ["slot", "part"]).where(near & (~F.col("whole") | (F.col("a") < F.col("b")))).select("a", "b")


def near_pairs(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """All pairs `(a, b)` of different fingerprints that differ in at most three bits, from a table of distinct ones."""
    return _pairs(_signatures(distinct, fp))


def _stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(center, member): what near pairs between two blocks join, each component as a star about its smallest fingerprint."""
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    near = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= REACH
    label, own, other = np.arange(len(names)), at[: len(left)], at[len(left) :]
    for i in range(len(left)):
        found = np.append(label[other[near[i]]], label[own[i]])
        low = found.min()
        if (found != low).any():
            label[np.isin(label, found)] = low
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[label[moved]], names[moved]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for left, right in zip(batch.column(0), batch.column(1)):
            a, b = _stars(left.values.to_numpy(), right.values.to_numpy())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _few(slot: np.ndarray, fp: np.ndarray, bucket: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of small buckets. A signature that leaves out a bit counts across that bit's two values only, a whole segment always."""
    bit = slot % (HALF + 1)
    half = np.where(slot <= HALF, fp & 0xFFFFFFFF, (fp >> HALF) & 0xFFFFFFFF)
    side = (half >> np.minimum(bit, HALF - 1)) & 1
    out = []
    for lag in range(1, FEW):
        i = np.flatnonzero((bucket[lag:] == bucket[:-lag]) & (size[lag:] <= FEW))
        i = i[((bit[i] == HALF) | (side[i] != side[i + lag])) & (np.bitwise_count(fp[i].view(np.uint64) ^ fp[i + lag].view(np.uint64)) <= REACH)]
        out.append((fp[i], fp[i + lag]))
    return tuple(np.concatenate(x) for x in zip(*out))


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("slot", pa.int32()), ("part", pa.int64()), ("block", pa.int32()), ("fps", pa.list_(pa.int64()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows `(slot, part, fp)` in order: links of the buckets, and the blocks of buckets that are larger than one."""

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), f.type) for f in list(_FOUND)[2:])], schema=_FOUND)

    def blocks(slot: int, part: int, number: int, fps: np.ndarray) -> pa.RecordBatch:
        cuts = [fps[at : at + BLOCK] for at in range(0, len(fps), BLOCK)]
        values = [None] * len(cuts), [None] * len(cuts), [slot] * len(cuts), [part] * len(cuts), range(number, number + len(cuts)), cuts
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _FOUND)], schema=_FOUND)

    def whole(slot: np.ndarray, part: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero((np.diff(slot, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        sizes = np.diff(np.append(starts, len(fp)))
        yield links(*_few(slot, fp, np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes)))
        for at, size in zip(starts[sizes > FEW], sizes[sizes > FEW]):
            own = fp[at : at + size]
            yield links(*_stars(own, own)) if size <= 2 * BLOCK else blocks(int(slot[at]), int(part[at]), 0, own)

    held, number = [np.empty(0, np.int64)] * 3, 0
    for b in batches:
        rows = [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, b.columns)]
        if not len(rows[0]):
            continue
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        last = len(same) - int(same.sum())
        if last and number:  # the bucket whose first blocks were given out ends in these rows
            end = int(((rows[0] == rows[0][0]) & (rows[1] == rows[1][0])).sum())
            yield blocks(int(rows[0][0]), int(rows[1][0]), number, rows[2][:end])
            rows, last, number = [r[end:] for r in rows], last - end, 0
        if last:
            yield from whole(*(r[:last] for r in rows))
        held = [r[last:] for r in rows]
        while len(held[0]) >= 2 * BLOCK:
            yield blocks(int(held[0][0]), int(held[1][0]), number, held[2][:BLOCK])
            held, number = [h[BLOCK:] for h in held], number + 1
    if number:
        yield blocks(int(held[0][0]), int(held[1][0]), number, held[2])
    elif len(held[0]):
        yield from whole(*held)


def near_links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """Links `(a, b)` that join the same fingerprints as all near pairs do, but number a few a fingerprint.

    Signatures are sorted, so that those of a bucket follow each other: a few are paired, more are joined as stars, and a
    bucket larger than two blocks is given out in blocks, each two of which meet in another task.
    """
    rows = _signatures(distinct, fp).select("slot", "part", "fp").repartition("slot", "part").sortWithinPartitions("slot", "part", "fp")
    found = durable(rows.mapInArrow(_scan, "a long, b long, slot int, part long, block int, fps array<long>"))
    blocks = found.where("fps is not null").select("slot", "part", "block", "fps")
    number = blocks.groupBy("slot", "part").agg(F.max("block").alias("last"))
    left = blocks.join(number, ["slot", "part"]).select("slot", "part", F.col("fps").alias("left"), F.explode(F.expr("sequence(block, last)")).alias("block"))
    met = left.join(blocks.withColumnRenamed("fps", "right"), ["slot", "part", "block"]).select("left", "right")
    return durable(found.where("a is not null").select("a", "b").unionByName(met.mapInArrow(_met, "a long, b long")).distinct())


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, h) of every row, written once: h tells apart rows that share an id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return durable(fingerprints(rows).select("doc_id", "fp", F.xxhash64("text").alias("h")))


def _classes(marked: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every fingerprint."""
    known = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(near_links(known.select("fp")))
    linked = known.join(roots, known.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return linked.select("fp", "root").join(smallest, "root")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `(doc_id, fp, component_id)`.

    component_id is the smallest non-null id among all rows whose fingerprints the row's fingerprint reaches
    over links of at most three bits. Null or blank texts share fingerprint zero and are linked like any other.
    Repeated rows are all returned, a null id keeps its row, and an empty table gives an empty result. Texts of any
    length are taken whole; other columns don't matter, whatever their names.
    """
    marked = _marked(docs, id_col, text_col)
    return marked.join(_classes(marked), "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without near duplicates: of each class the row with the smallest id stays.

    Null ids come last; rows that repeat the id and the text keep one of them. All columns stay, in order.
    """
    marked = _marked(docs, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("w")
    of_fp = marked.groupBy("fp").agg(first)
    best = _classes(marked).join(of_fp, "fp").groupBy("root").agg(F.min("w").alias("w"))
    return rows_of(docs, best, id_col, text_col)


def rows_of(docs: DataFrame, best: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` that `best(w)` names by id and text hash, each once; no id is taken for a null one."""
    key = lambda c: F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c.cast("string")))
    winners = best.select(key(F.col("w.doc_id")).alias("_tf_id"), F.col("w.h").alias("_tf_h"))
    keyed = docs.withColumns({"_tf_id": key(F.col(id_col)), "_tf_h": F.xxhash64(F.col(text_col))})
    kept = keyed.join(winners, ["_tf_id", "_tf_h"], "left_semi")
    return kept.dropDuplicates(["_tf_id", "_tf_h"]).select(*docs.columns)
