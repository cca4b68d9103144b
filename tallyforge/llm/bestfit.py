"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Pieces are dealt to blocks of bounded size. Each block is evolved on several islands, as rows of a table: a
crossover puts whole well-filled bins of one parent into the other, removes the bins that hold the same pieces
and best-fits what that displaces. After an epoch the islands of a block trade their elites through a shuffle.
The bins that stay poorly filled are dissolved and packed again across blocks, for as long as that leaves fewer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import durable, utf8
from .tokens import END_ID, as_u32, encoder

CAPACITY, BLOCK, ISLANDS, EPOCHS, POPULATION, CHILDREN = 1024, 8192, 3, 2, 4, 8
#: Bins below this part of the capacity are packed once more across blocks.
POOR = 0.97
#: Packing across blocks goes on while a level leaves at most this part of its pieces in poor bins.
PROGRESS = 0.9


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole pieces of `capacity`, the first may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))] if length else []


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str | None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: `(doc_id, piece, start, length, ids_crc32, uid[, ids])`; uid numbers the rows.

    A document is the ids of its whole text (null: empty) and END_ID. ids are little-endian integers of 2 or 4
    bytes, as the vocabulary needs. The result must be written before uid is used twice.
    """
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32", "uid"))]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, uid = encoder(path), TaskContext.get().partitionId() << 33
        end = np.array([END_ID], dtype=coder.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), []
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = coder.encode(text.decode("utf-8", "replace")) + end
                    for k, (start, n) in enumerate(cut(len(ids) // coder.width, capacity)):
                        piece = ids[start * coder.width : (start + n) * coder.width]
                        rows.append((row, k, start, n, zlib.crc32(as_u32(piece, coder.width)), uid, piece))
                        uid += 1
                columns = list(zip(*rows))
                numbers = [pa.array(c, pa.int64()) for c in columns[1:6]]
                pieces = [pa.array(columns[6], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(columns[0], pa.int64())), *numbers, *pieces], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text")).mapInArrow(split, schema)


class Grouping:
    """One block's pieces and the moves of the grouping genetic algorithm on them; a packing is a bin a piece."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity, self.rng = sizes, capacity, np.random.default_rng(seed)
        self.plain = sizes.tolist()

    def loads(self, packing: np.ndarray) -> np.ndarray:
        return np.bincount(packing, weights=self.sizes).astype(np.int64)

    def fitness(self, packing: np.ndarray) -> tuple[int, float]:
        """Fewer bins first; among equals, those with fuller bins."""
        loads = self.loads(packing)
        return -len(loads), float(((loads / self.capacity) ** 2).mean())

    def best_fit(self, packing: np.ndarray, pieces: np.ndarray, loads: list[int]) -> np.ndarray:
        """Put `pieces`, in order, each where it leaves least room; a bit set of the free sizes finds the bin."""
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        free = 0
        for b, load in enumerate(loads):
            if load < self.capacity:
                room[self.capacity - load].append(b)
                free |= 1 << (self.capacity - load)
        for i in pieces.tolist():
            size = self.plain[i]
            fits = free >> size
            if fits:
                r = size + (fits & -fits).bit_length() - 1
                b = room[r].pop()
                if not room[r]:
                    free ^= 1 << r
            else:
                r, b = self.capacity, len(loads)
                loads.append(0)
            packing[i] = b
            loads[b] += size
            if r > size:
                room[r - size].append(b)
                free |= 1 << (r - size)
        return packing

    def descending(self, pieces: np.ndarray, noise: float = 0.0) -> np.ndarray:
        weight = self.sizes[pieces] * (1 + noise * self.rng.random(len(pieces)))
        return pieces[np.argsort(-weight, kind="stable")]

    def first(self, noise: float) -> np.ndarray:
        every = np.arange(len(self.sizes))
        return self.best_fit(np.empty(len(every), dtype=np.int64), self.descending(every, noise), [])

    def _rebuilt(self, packing: np.ndarray, gone: np.ndarray, displaced: np.ndarray, noise: float) -> np.ndarray:
        """`packing` without the bins `gone`, with the pieces `displaced` best-fitted into what is left."""
        number = np.cumsum(~gone) - 1
        child = number[packing]
        held = np.ones(len(packing), dtype=bool)
        held[displaced] = False
        loads = np.bincount(child[held], weights=self.sizes[held], minlength=int((~gone).sum())).astype(np.int64).tolist()
        return self.best_fit(child, self.descending(displaced, noise), loads)

    def crossover(self, into: np.ndarray, donor: np.ndarray) -> np.ndarray:
        """Inject whole well-filled bins of `donor`, drop the bins of `into` they overlap, best-fit the displaced."""
        fill = self.loads(donor) / self.capacity
        chosen = (fill >= np.quantile(fill, 0.5)) & (self.rng.random(len(fill)) < self.rng.uniform(0.1, 0.5))
        injected = chosen[donor]
        hit = np.zeros(into.max() + 1, dtype=bool)
        hit[into[injected]] = True
        both = np.where(injected, donor + len(hit), into)
        gone = np.concatenate([hit, ~chosen])
        return self._rebuilt(both, gone, np.flatnonzero(hit[into] & ~injected), 0.0)

    def mutation(self, packing: np.ndarray) -> np.ndarray:
        """Dissolve the emptiest bins and a few others, and best-fit their pieces in a perturbed order."""
        fill = self.loads(packing) / self.capacity
        gone = (fill <= np.quantile(fill, 0.05)) & (fill < 1) | (self.rng.random(len(fill)) < 0.05)
        return self._rebuilt(packing, gone, np.flatnonzero(gone[packing]), 0.1)

    def evolve(self, elites: list[np.ndarray], children: int) -> list[np.ndarray]:
        """An epoch: the elites and new starts breed; returns the two best packings, the best first."""
        people = list(elites)
        while len(people) < POPULATION:
            people.append(self.first(0.0 if not people else 0.2 * self.rng.random()))
        ranked = sorted(((self.fitness(p), k, p) for k, p in enumerate(people)), key=lambda x: x[:2], reverse=True)
        floor = -(-int(self.sizes.sum()) // self.capacity)
        for n in range(children):
            if -ranked[0][0][0] <= floor:
                break
            a, b = self.rng.choice(len(ranked), 2, replace=False)
            child = self.mutation(self.crossover(ranked[a][2], ranked[b][2])) if n % 2 else self.crossover(ranked[min(a, b)][2], ranked[max(a, b)][2])
            ranked = sorted([*ranked, (self.fitness(child), len(people) + n, child)], key=lambda x: x[:2], reverse=True)[:POPULATION]
        return [p for _, _, p in ranked[:2]]


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, level: int = 0) -> DataFrame:
    """Sequence and offset of each piece: `pieces(uid, length, ...)` with `sequence_id` and `offset` added.

    `pieces` must be durable, with lengths of 1 to `capacity`. Pieces of full length are sequences of their own.
    """
    n = pieces.where(F.col("length") < capacity).count()
    whole = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -F.col("uid") - 1, "offset": F.lit(0).cast("long")})
    if not n:
        return whole
    blocks = max(1, round(n / block))
    fields = [c for c in pieces.columns]
    part = pieces.where(F.col("length") < capacity).withColumn("_block", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)))
    item = F.struct(F.col("length").alias("_n"), *fields)
    table = durable(part.groupBy("_block").agg(F.sort_array(F.collect_list(item)).alias("items")))
    sizes = F.transform("items", lambda x: x["_n"].cast("int"))
    state = table.select("_block", sizes.alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.expr("cast(array() as array<binary>)").alias("elites"))
    tasks = min(blocks * ISLANDS, 20_000)
    schema = "_block long, sizes array<int>, island int, bins int, elites array<binary>"

    def epoch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for block_id, sizes_, island, elites in zip(b["_block"], b["sizes"], b["island"], b["elites"]):
                group = Grouping(np.asarray(sizes_, dtype=np.int64), capacity, (int(block_id) * 31 + int(island)) * 7 + len(elites))
                best = group.evolve([np.frombuffer(e, dtype="<i4").astype(np.int64) for e in elites], CHILDREN)
                rows.append((block_id, sizes_, island, int(best[0].max()) + 1, [p.astype("<i4").tobytes() for p in best]))
            yield pd.DataFrame(rows, columns=["_block", "sizes", "island", "bins", "elites"])

    for n_epoch in range(EPOCHS):
        evolved = state.repartition(tasks, "_block", "island").mapInPandas(epoch, schema)
        if n_epoch < EPOCHS - 1:
            met = evolved.groupBy("_block").agg(F.first("sizes").alias("sizes"), F.map_from_entries(F.collect_list(F.struct("island", "elites"))).alias("all"))
            ring = met.select("_block", "sizes", "all", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
            state = ring.select("_block", "sizes", "island", F.concat(F.element_at("all", F.col("island")), F.slice(F.element_at("all", F.pmod(F.col("island") + 1, F.lit(ISLANDS))), 1, 1)).alias("elites"))
    best = evolved.groupBy("_block").agg(F.min_by(F.element_at("elites", 1), F.struct("bins", "island")).alias("packing"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for block_id, sizes_, packing in zip(b["_block"], b["sizes"], b["packing"]):
                bins, lengths = np.frombuffer(packing, dtype="<i4"), np.asarray(sizes_, dtype=np.int64)
                order = np.argsort(bins, kind="stable")
                ends = lengths[order].cumsum()
                starts = np.zeros(bins.max() + 1, dtype=np.int64)
                firsts = np.flatnonzero(np.diff(bins[order], prepend=-1))
                starts[bins[order][firsts]] = ends[firsts] - lengths[order][firsts]
                offsets = np.empty(len(bins), dtype=np.int64)
                offsets[order] = ends - lengths[order] - starts[bins[order]]
                loads = np.bincount(bins, weights=lengths).astype(np.int64)
                rows.append((block_id, bins.astype(np.int64), offsets, loads[bins]))
            yield pd.DataFrame(rows, columns=["_block", "bin", "offset", "load"])

    spots = table.select("_block", sizes.alias("sizes")).join(best, "_block").mapInPandas(place, "_block long, bin array<long>, offset array<long>, load array<long>")
    rows = table.join(spots, "_block").select("_block", F.explode(F.arrays_zip("items", "bin", "offset", "load")).alias("x"))
    placed = rows.select(*[F.col(f"x.items.{c}").alias(c) for c in fields], (F.col("_block") * (1 << 20) + F.col("x.bin")).alias("sequence_id"), F.col("x.offset").alias("offset"), F.col("x.load").alias("_load"))
    numbered = placed.withColumn("sequence_id", F.col("sequence_id") + F.lit(level) * (1 << 56))
    if blocks == 1:
        return whole.unionByName(numbered.drop("_load"))
    numbered = durable(numbered)
    poor = F.col("_load") < POOR * capacity
    left = numbered.where(poor).count()
    if not left or left > PROGRESS * n:
        return whole.unionByName(numbered.drop("_load"))
    good = numbered.where(~poor).drop("_load")
    return whole.unionByName(good).unionByName(pack(durable(numbered.where(poor).select(*fields)), capacity, block, level + 1))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """All documents as token pieces in sequences of at most `capacity` tokens.

    Returns `(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`, a row a piece. A null or empty text
    is the end id alone. Repeated rows and null ids are documents of their own. An empty table gives no rows.
    """
    pieces = durable(token_pieces(docs, id_col, text_col, capacity, path))
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
