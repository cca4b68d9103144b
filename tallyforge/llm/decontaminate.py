"""Benchmark decontamination: documents that hold a benchmark item, whole or edited.

Texts are sequences of word hashes. A random walk (CGK) embeds a sequence so that edits become a bounded number of
differing places: at each step it writes the current word and goes on to the next one if a random function of
step and word says so. Every item-sized window of a document is embedded by several walks; hash tables over sampled
places of each embedding are looked up in the index of all items, and an exact edit distance verifies what collides.

Windows start at every STRIDE-th part of their length; the index holds an item's windows from each of as many words
on, so that some window of a document is aligned with one of the index wherever the item stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import durable, utf8
from .words import mix, word_hashes

SIMILARITY = 0.8
#: Walks, tables over each walk (as many again for every further 32 words), places a table samples, and windows that
#: start in a window's length.
WALKS, TABLES, SAMPLED, STRIDE = 4, 8, 4, 4
#: Of an item with the most edits allowed; test_recall_at_the_most_edits measures it.
TARGET_RECALL = 0.95
#: Keys of an index that may be broadcast (12 bytes each); a larger one is joined. Bits of the filter before that join.
BROADCAST_KEYS, FILTER_BITS = 2_000_000, 1 << 23
_END = np.uint64(0)
_CHUNK = 1 << 16
_ODD = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def edits_allowed(words: int, similarity: float = SIMILARITY) -> int:
    return int(words * (1 - similarity) + 1e-9)


@lru_cache(maxsize=4096)
def window_of(words: int) -> int:
    """The window's length for an item: the item's own up to eight words, then the nearest of 8, 12, 16, 24, 32, 48... below."""
    size = 8
    while words > 8 and (larger := size * 3 // 2 if size & (size - 1) == 0 else size * 4 // 3) <= words:
        size = larger
    return size if words > 8 else words


@lru_cache(maxsize=512)
def _plan(window: int) -> tuple[int, np.ndarray]:
    """The stride of a window's starts and the sampled places, walks x tables x places.

    The first table of each walk samples steps that cannot leave the window, so an unedited item always collides.
    """
    stride = max(1, window // STRIDE)
    inside = window - stride + 1
    tables = TABLES * max(1, window // 32)
    rng, places = np.random.default_rng(window), np.zeros((WALKS, tables, min(SAMPLED, inside)), dtype=np.int64)
    for walk in range(WALKS):
        for table in range(tables):
            steps = inside if table == 0 else max(inside, 3 * (window - stride) // 2)
            places[walk, table] = np.sort(rng.choice(steps, places.shape[2], replace=False))
    return stride, places


@lru_cache(maxsize=4096)
def _salt(walk: int, block: int) -> np.uint64:
    return mix(np.array([(walk << 20) + block + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]


def embed_keys(words: np.ndarray, starts: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """`(window, keys)` of the windows that begin at `starts[window]`, for each table; `words` ends with END.

    A walk stays where it meets END. All windows of a walk step together, and 63 steps share one mix of the words.
    A key sums the sampled words, each times an odd number of its own.
    """
    inside = words != _END
    for walk in range(WALKS):
        coins: dict[int, np.ndarray] = {}
        for window, first in starts.items():
            places = _plan(window)[1][walk]
            sampled, at, coin = set(places.ravel().tolist()), first.copy(), np.empty_like(first)
            written: dict[int, np.ndarray] = {}
            for step in range(max(sampled) + 1):
                if step in sampled:
                    written[step] = np.take(words, at)
                block, bit = divmod(step, 63)
                if block not in coins:
                    coins[block] = (mix(words ^ _salt(walk, block)) * inside).view(np.int64)
                np.take(coins[block], at, out=coin, mode="clip")
                np.right_shift(coin, bit, out=coin)
                np.bitwise_and(coin, 1, out=coin)
                np.add(at, coin, out=at)
            for table, chosen in enumerate(places.tolist()):
                key = np.full(len(first), _salt(window << 16, walk * len(places) + table))
                for step, odd in zip(chosen, _ODD):
                    key += written[step] * odd
                yield window, key


def item_keys(words: np.ndarray) -> np.ndarray:
    """All keys under which an item is indexed: of its windows from each word of the first stride on."""
    window = window_of(len(words))
    first = np.arange(_plan(window)[0])
    return np.unique(np.concatenate([k for _, k in embed_keys(np.append(words, _END), {window: first})]))


def infix_distances(item: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The least number of word edits between `item` and any stretch of each row of `texts`."""
    steps = np.arange(texts.shape[1] + 1)
    row = np.zeros((len(texts), texts.shape[1] + 1), dtype=np.int64)
    for k, word in enumerate(item):
        best = np.empty_like(row)
        best[:, 0] = k + 1
        best[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (texts != word))
        row = np.minimum.accumulate(best - steps, axis=1) + steps
    return row.min(axis=1)


def infix_distance(item: np.ndarray, text: np.ndarray) -> int:
    return int(infix_distances(item, np.asarray(text)[None, :])[0])


def verified(item: np.ndarray, texts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The edits of each row, or -1 where they are more than allowed; rows that share too few words are not compared."""
    allowed, out = edits_allowed(len(item), similarity), np.full(len(texts), -1, dtype=np.int64)
    for at in range(0, len(texts), 1024):
        part = texts[at : at + 1024]
        likely = np.flatnonzero(np.isin(part, item).sum(axis=1) >= len(item) - allowed)
        if len(likely):
            edits = infix_distances(item, part[likely])
            out[at + likely] = np.where(edits <= allowed, edits, -1)
    return out


def _joined(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`(words, owner)` of some of the texts, one after the other with END between them, and the text of each word."""
    words, owners, size = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)], 0
    for k, text in enumerate(texts):
        own = word_hashes(text, marks=True)
        words += [own, np.zeros(1, np.uint64)]
        owners.append(np.full(len(own) + 1, k))
        size += len(own)
        if size >= _CHUNK or k == len(texts) - 1:
            yield np.concatenate(words), np.concatenate(owners)
            words, owners, size = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)], 0


def _stretch(words: np.ndarray, owner: np.ndarray, starts: np.ndarray, before: int, after: int) -> np.ndarray:
    """The words from `before` words ahead of each start to `after` behind it; END for what is of another text."""
    spots = starts[:, None] + np.arange(-before, after)
    near = np.clip(spots, 0, len(words) - 1)
    return np.where((near == spots) & (owner[near] == owner[starts][:, None]), words[near], _END)


def _around(size: int, similarity: float) -> tuple[int, int]:
    """Words before and after a window's start in which an item of that size may stand."""
    slack = edits_allowed(size, similarity)
    return _plan(window_of(size))[0] + slack, size + slack


class ItemIndex:
    """Items by their keys in every table: sorted keys, the item of each, and a bit set of the keys' low bits."""

    def __init__(self, items: list[np.ndarray], similarity: float = SIMILARITY):
        self.items, self.similarity = items, similarity
        own = [item_keys(w) for w in items]
        keys, names = np.concatenate([np.empty(0, np.uint64), *own]), np.repeat(np.arange(len(items), dtype=np.int32), [len(k) for k in own])
        order = np.argsort(keys, kind="stable")
        self.keys, self.names = keys[order], names[order]
        bits = max(16, min(23, (len(keys) * 32).bit_length()))
        self.shift, self.filter = np.uint64(64 - bits), np.zeros(1 << bits, dtype=bool)
        self.filter[self.keys >> self.shift] = True
        self.windows = sorted({window_of(len(w)) for w in items})

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """`(window, start, item)` of the windows and items that share a key."""
        starts = {w: np.arange(0, len(words), _plan(w)[0]) for w in self.windows}
        for window, keys in embed_keys(words, starts):
            maybe = np.flatnonzero(np.take(self.filter, (keys >> self.shift).view(np.int64)))
            some = keys[maybe]
            low = np.searchsorted(self.keys, some, "left")
            same = np.flatnonzero(np.take(self.keys, low, mode="clip") == some)
            if len(same):
                low, maybe = low[same], maybe[same]
                hits = np.searchsorted(self.keys, some[same], "right") - low
                at = np.repeat(low - np.concatenate([[0], hits.cumsum()[:-1]]), hits) + np.arange(hits.sum())
                yield window, np.repeat(starts[window][maybe], hits), self.names[at]

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text, item, edits) of each item that a text holds within the similarity, with the least edits found."""
        found: dict[tuple[int, int], int] = {}
        for words, owner in _joined(texts):
            pairs = [item.astype(np.int64) * len(words) + start for _, start, item in self.candidates(words)]
            both = np.unique(np.concatenate([np.empty(0, np.int64), *pairs]))
            names, starts = both // len(words), both % len(words)
            for part in np.split(np.arange(len(both)), np.flatnonzero(np.diff(names)) + 1) if len(both) else ():
                item = self.items[names[part[0]]]
                for at in range(0, len(part), 4096):
                    rows = starts[part[at : at + 4096]]
                    edits = verified(item, _stretch(words, owner, rows, *_around(len(item), self.similarity)), self.similarity)
                    for k in np.flatnonzero(edits >= 0).tolist():
                        spot = int(owner[rows[k]]), int(names[part[0]])
                        found[spot] = min(int(edits[k]), found.get(spot, len(item)))
        return [(text, item, e) for (text, item), e in found.items()]


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """`(number, item_id, words, size)` of the different items that have words, written once; words as 64-bit hashes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            own = [word_hashes(t, marks=True) for t in b.column(1).to_pylist()]
            kept = pa.array([k for k, w in enumerate(own) if len(w)], pa.int64())
            words = [own[k].tobytes() for k in kept.to_pylist()]
            names = np.arange(number, number + len(words))
            number += len(words)
            yield pa.RecordBatch.from_arrays([pa.array(names), b.column(0).take(kept), pa.array(words, pa.binary()), pa.array([len(w) // 8 for w in words], pa.int32())], names=["number", "item_id", "words", "size"])

    rows = benchmark.select(F.col(item_col).alias("item_id"), utf8(F.col(text_col)).alias("text")).distinct()
    kind = benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("item_id", kind), T.StructField("words", T.BinaryType()), T.StructField("size", T.IntegerType())])
    return durable(rows.mapInArrow(hashed, schema))


def _few(items: DataFrame) -> list | None:
    """The items in order, if the index of all of them is small enough to broadcast; else None."""
    keys = F.ceil(F.col("size") / STRIDE) * F.ceil(F.col("size") / 32) * (WALKS * TABLES)
    count = items.agg(F.sum(keys).alias("n")).first().n
    return items.orderBy("number").collect() if (count or 0) <= BROADCAST_KEYS else None


def _words_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint64)


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`(row, number, edits)` for `docs(row, text)` by an equality join of keys, one pass whatever the number of items.

    A bit set of FILTER_BITS keeps windows without any key of the index out of the shuffle. Each colliding window
    carries the words around it to the items it may hold.
    """

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [item_keys(_words_of(w)) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), [len(k) for k in own]))], names=["key", "number"])

    index = durable(items.select("number", "words").mapInArrow(indexed, "key long, number long"))
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    spot = F.pmod("key", F.lit(FILTER_BITS))
    for r in index.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {FILTER_BITS}) & 63 as int))")).alias("set")).toLocalIterator():
        bits[r["at"]] = np.uint64(r["set"] & 0xFFFFFFFFFFFFFFFF)
    windows = sorted({window_of(r["size"]) for r in items.select("size").distinct().toLocalIterator()})
    shared = docs.sparkSession.sparkContext.broadcast(np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool))

    def colliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            rows = b.column(0)
            for words, owner in _joined(b.column(1).to_pylist()):
                starts = {w: np.arange(0, len(words), _plan(w)[0]) for w in windows}
                for window, keys in embed_keys(words, starts):
                    hit = np.flatnonzero(known[(keys % np.uint64(FILTER_BITS)).view(np.int64)])
                    if len(hit):
                        at = starts[window][hit]
                        near = _stretch(words, owner, at, window, 2 * window + 2)
                        yield pa.RecordBatch.from_arrays([rows.take(pa.array(owner[at])), pa.array(keys[hit].view(np.int64)), pa.array([n.tobytes() for n in near], pa.binary())], names=["row", "key", "near"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edits = []
            for n, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                item, window = _words_of(w), window_of(len(w) // 8)
                before, after = _around(len(item), SIMILARITY)
                edits.append(int(verified(item, _words_of(n)[None, max(0, window - before) : window + after])[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(edits, pa.int32())], names=["row", "number", "edits"])

    met = docs.mapInArrow(colliding, "row long, key long, near binary").join(index, "key").select("row", "number", "near").distinct()
    edits = met.join(items.select("number", "words"), "number").select("row", "number", "near", "words").mapInArrow(verify, "row long, number long, edits int")
    return edits.where("edits >= 0").groupBy("row", "number").agg(F.min("edits").alias("edits"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """`(doc_id, item_id, edits, item_words, similarity)` of each document and each item it holds.

    An item is held if some stretch of the document is within 20 % of the item's words by word edits; case and
    ASCII punctuation don't count. Items under five words must stand unedited; items and documents that are
    null or without words match nothing. Repeated documents are reported row by row; repeated items once.
    Ids of any type come back unchanged, nulls included.
    """
    items = _items(benchmark, item_col, item_text)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    few = _few(items)
    if few is None:
        rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))
        hits = _by_join(rows.select("row", "text"), items).join(rows.select("row", "doc_id"), "row")
    else:
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex([_words_of(r.words) for r in few]))
        numbers = np.array([r.number for r in few], dtype=np.int64)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    hits = index.value.leaks(part.column(1).to_pylist())
                    found = np.array(hits, dtype=np.int64).reshape(-1, 3)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(found[:, 0])), pa.array(numbers[found[:, 1]]), pa.array(found[:, 2].astype(np.int32))], names=["doc_id", "number", "edits"])

        schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("number", T.LongType()), T.StructField("edits", T.IntegerType())])
        hits = rows.mapInArrow(search, schema)
    named = hits.join(items.select("number", "item_id", F.col("size").alias("item_words")), "number")
    return named.select("doc_id", "item_id", "edits", "item_words", (1 - F.col("edits") / F.col("item_words")).alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no benchmark item, by the rules of `find_leaks`; all columns stay, in order.

    Whether a row goes depends on its text alone, so repeated rows go or stay together whatever their ids; null and
    empty texts stay. An empty benchmark drops nothing. With an index that may be broadcast nothing is shuffled.
    """
    items = _items(benchmark, item_col, item_text)
    few = _few(items)
    if few is None:
        pair = {"_tf_a": F.xxhash64(text_col), "_tf_b": F.xxhash64(F.lit(2), text_col)}
        rows = durable(docs.where(F.col(text_col).isNotNull()).withColumns(pair).select("_tf_a", "_tf_b", utf8(F.col(text_col)).alias("text")).withColumn("row", F.monotonically_increasing_id()))
        held = rows.join(_by_join(rows.select("row", "text"), items).select("row").distinct(), "row").select("_tf_a", "_tf_b").distinct()
        return docs.withColumns(pair).join(held, ["_tf_a", "_tf_b"], "left_anti").select(*docs.columns)
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex([_words_of(r.words) for r in few]))

    @F.arrow_udf(T.BooleanType())
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.zeros(len(batch), dtype=bool)
            for at in range(0, len(batch), 1024):
                found[[at + d for d, _, _ in index.value.leaks(batch.slice(at, 1024).to_pylist())]] = True
            yield pa.array(found)

    return docs.where(~holds(utf8(F.col(text_col))))
