"""Packed token matrices: best-fit-decreasing with a segment tree over free capacities.

Documents become token ids, overlong ones are split without loss, and the pieces of a block of bounded bytes are
packed into rows of fixed length. A row carries its ids, the cumulative lengths of its segments and the position
at which each segment starts (0 where a document starts, more where a split document goes on).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bestfit import token_pieces
from .tokens import encoder

CAPACITY, PAD_ID = 2048, 0
#: A block holds this many documents or bytes of text on average.
BLOCK_DOCS, BLOCK_BYTES = 2048, 8 << 20
#: Tasks that pack at once; beyond as many blocks, a task packs several one after the other.
MOST_TASKS = 20_000


class CapacityTree:
    """A segment tree over free sizes 0..capacity; a node counts the open bins below it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, bin_id: int) -> None:
        self.open[room].append(bin_id)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) of an open bin with the least room of at least `size`."""
        node, count = size + self.leaves, self.count
        while not count[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:
                return None
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size; larger sizes are placed first, equal ones in order."""
    tree, bins, used = CapacityTree(capacity), np.empty(len(sizes), dtype=np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        spot = tree.take(size)
        if spot is None:
            room, b, used = capacity, used, used + 1
        else:
            room, b = spot
        bins[i] = b
        if room > size:
            tree.put(room - size, b)
    return bins


def pack_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """All documents as packed rows.

    Returns `(sequence_id, n_tokens, ids, cu_seqlens, position_starts, doc_ids, pieces)`: ids is `capacity`
    little-endian integers (2 bytes each for vocabularies up to 65,536, else 4), padded with PAD_ID; segment k is
    ids[cu_seqlens[k]:cu_seqlens[k+1]] and starts at token position_starts[k] of document doc_ids[k]. Every
    document ends with the end id, so an empty or null text has one token. Repeated rows and null ids are
    documents of their own; an empty table gives no rows.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("b")).first()
    blocks = max(1, -(-size.n // BLOCK_DOCS), -(-(size.b or 0) // BLOCK_BYTES))
    pieces = token_pieces(docs, id_col, text_col, capacity, path, with_ids=True).withColumn("_block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
            T.StructField("position_starts", T.ArrayType(T.LongType())),
            T.StructField("doc_ids", T.ArrayType(kind)),
            T.StructField("pieces", T.ArrayType(T.LongType())),
        ]
    )

    def rows(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("uid").combine_chunks()
        length, start, piece = (group[c].to_numpy() for c in ("length", "start", "piece"))
        bins = best_fit_decreasing(length, capacity)
        order = np.argsort(bins, kind="stable")
        firsts = np.append(np.flatnonzero(np.diff(bins[order], prepend=-1)), len(order))
        ids, within = group["ids"], length[order].cumsum() - length[order]
        pad = np.array([PAD_ID], dtype=f"<u{len(ids[0].as_py()) // int(length[0])}").tobytes()
        packed, used, ends = [], [], []
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            total = int(length[order[a:b]].sum())
            packed.append(b"".join(ids[i].as_py() for i in order[a:b].tolist()) + pad * (capacity - total))
            used.append(total)
            ends.append([*(within[a:b] - within[a]).tolist(), total])
        listed = lambda values, kind: pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), values.cast(kind))
        named = group["doc_id"].combine_chunks().take(pa.array(order))
        columns = [
            pa.array((int(key[0].as_py()) << 24) + bins[order[firsts[:-1]]]), pa.array(used, pa.int32()), pa.array(packed, pa.binary()), pa.array(ends, pa.list_(pa.int32())),
            listed(pa.array(start[order]), pa.int64()), listed(named, named.type), listed(pa.array(piece[order]), pa.int64()),
        ]
        return pa.Table.from_arrays(columns, names=schema.names)

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks, MOST_TASKS))
    dealt = pieces.select("_block", "doc_id", "piece", "start", "length", "uid", "ids").repartition(parts, "_block")
    return dealt.groupBy("_block").applyInArrow(rows, schema)


def write_rows(packed: DataFrame, folder: str) -> None:
    """Write packed rows as compressed Parquet with binary id rows; fails if the folder exists."""
    packed.write.mode("errorifexists").option("compression", "zstd").parquet(folder)


def texts_of(packed: DataFrame, path: str | None = None) -> DataFrame:
    """The documents again, `(doc_id, text)`, from packed rows of distinct document ids."""
    at, end = F.slice("cu_seqlens", 1, F.size("doc_ids")), F.slice("cu_seqlens", 2, F.size("doc_ids"))
    segments = packed.select("ids", F.explode(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("position_starts").alias("start"), at.alias("at"), end.alias("end"))).alias("s"))
    whole = segments.groupBy("s.doc_id").agg(F.sort_array(F.collect_list(F.struct("s.start", "s.at", "s.end", "ids"))).alias("parts"))
    kind = whole.schema["doc_id"].dataType

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for b in batches:
            texts = []
            for parts in b.column(1).to_pylist():
                ids = np.concatenate([np.frombuffer(p["ids"], dtype=coder.dtype)[p["at"] : p["end"]] for p in parts])
                texts.append(coder.tokenizer.decode(ids[:-1].tolist(), skip_special_tokens=False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return whole.mapInArrow(decode, T.StructType([T.StructField("doc_id", kind), T.StructField("text", T.StringType())]))
