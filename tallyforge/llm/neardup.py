"""Near duplicates by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 at least.

Texts are first linked by fingerprints of their shingles (SimHash), as in `simhash`: signatures with one bit left out find
those that differ in at most three bits. What lies beyond that reach is found by bands of minima (MinHash): with 32 bands
of five, a pair at similarity 0.8 is missed about three times in a million. Every candidate is verified on the whole sets,
and texts that fingerprints have joined are not compared again. In each bucket all texts are compared with one of
them first, then with one, two, four... of those outside the bucket's largest component, as long as each round joins at
least half of what is outside; a large group of near copies so costs a few comparisons a member. What stays outside,
such as many texts of one template that are a little too different, is compared in blocks: the sizes of all intersections
of two blocks are one matrix product over the shingles they share, and only links that join components leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import durable, utf8
from .simhash import majority, near_links, rows_of
from .words import gram_hashes, mix, word_hashes

WORDS, LEAST = 5, 0.8
BANDS, MINIMA = 32, 5
#: Pairs a member of the open buckets that may be compared at once.
FEW_PAIRS = 4
#: Shingles of a block of texts that meets another one, as how many a short text counts at least, and columns of a matrix product.
BLOCK_SHINGLES, SHORT, COLUMNS = 200_000, 200, 4096
_rng = np.random.default_rng(17)
_FACTORS = _rng.integers(0, 1 << 31, size=(BANDS * MINIMA, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _rng.integers(0, 1 << 32, size=(BANDS * MINIMA, 1), dtype=np.uint32)


def shingles_of(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The different shingles of a text's word hashes, sorted; a shorter text is one shingle, a blank one none."""
    return np.unique(gram_hashes(hashes, min(words, len(hashes)))) if len(hashes) else hashes


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """A signed 64-bit signature of each band of minima."""
    low, mixed = np.full(BANDS * MINIMA, 0xFFFFFFFF, dtype=np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(mixed), 1024):
        np.minimum(low, (mixed[at : at + 1024] * _FACTORS + _OFFSETS).min(axis=1), out=low)
    out = np.zeros(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, MINIMA).T:
        out = mix(out * np.uint64(0x100000001B3) + column)
    return out.view(np.int64)


def _marked(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, h, key, size, fp, bands) of every row, written once: key names the text's words, h tells rows of one id apart."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, sizes, fps, bands = [], [], [], []
            for t in b.text:
                hashes = word_hashes(t)
                shingles = shingles_of(hashes, words)
                keys.append(xxhash.xxh3_128_hexdigest(hashes.tobytes()))
                sizes.append(len(shingles))
                fps.append(majority(shingles) if len(shingles) else 0)
                bands.append(bands_of(shingles) if len(shingles) > 1 else np.empty(0, np.int64))
            yield pd.DataFrame({"doc_id": b.doc_id, "h": b.h, "key": keys, "size": sizes, "fp": fps, "bands": bands})

    doc_id = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.xxhash64(text_col).alias("h"), utf8(F.col(text_col)).alias("text"))
    marked = rows.mapInPandas(mark, "doc_id string, h long, key string, size long, fp long, bands array<long>")
    return durable(marked.withColumn("doc_id", F.col("doc_id").cast(doc_id)))


def _sets(docs: DataFrame, needed: DataFrame, text_col: str, words: int) -> DataFrame:
    """(node, shingles) of the nodes in `needed(h, h2, node)`."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                yield pd.DataFrame({"node": part.node, "shingles": [shingles_of(word_hashes(t), words).view(np.int64) for t in part.text]})

    texts = docs.select(F.xxhash64(text_col).alias("h"), utf8(F.col(text_col)).alias("text"))
    found = texts.join(needed, "h").dropDuplicates(["node"]).select("node", "text")
    return durable(found.mapInPandas(cut, "node long, shingles array<long>"))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    counted = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n"), (F.size("sa") + F.size("sb")).alias("m"))
    return durable(counted.where(F.col("n") >= F.lit(least) * (F.col("m") - F.col("n")) - 1e-9).select("a", "b"))


def _spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links of a matrix, enough to join what all of them join; `left` and `right` are the components so far."""
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    label, own, other = np.arange(len(names)), at[: len(left)], at[len(left) :]
    out = []
    for i in np.flatnonzero(near.any(axis=1)):
        linked = np.flatnonzero(near[i])
        found, first = np.unique(label[other[linked]], return_index=True)
        new = found != label[own[i]]
        if new.any():
            out.extend((i, linked[j]) for j in first[new])
            label[np.isin(label, found)] = label[own[i]]
    return (np.array([i for i, _ in out], dtype=np.int64), np.array([j for _, j in out], dtype=np.int64))


def _intersections(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """How many shingles each set of `left` shares with each of `right`."""
    sizes = [np.asarray(x.value_lengths()) for x in (left, right)]
    flat = [x.flatten().to_numpy() for x in (left, right)]
    _, column = np.unique(np.concatenate(flat), return_inverse=True)
    columns = column[: len(flat[0])], column[len(flat[0]) :]
    n = int(column.max(initial=-1)) + 1
    shared = (np.bincount(columns[0], minlength=n) > 0) & (np.bincount(columns[1], minlength=n) > 0)
    number = np.cumsum(shared) - 1
    sides = []
    for c, size in zip(columns, sizes):
        kept = shared[c]
        row, col = np.repeat(np.arange(len(size)), size)[kept], number[c[kept]]
        order = np.argsort(col, kind="stable")
        sides.append((row[order], col[order]))
    out = np.zeros((len(sizes[0]), len(sizes[1])), dtype=np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        parts = []
        for (row, col), size in zip(sides, sizes):
            a, z = np.searchsorted(col, (at, at + COLUMNS))
            part = np.zeros((len(size), COLUMNS), dtype=np.float32)
            part[row[a:z], col[a:z] - at] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _by_blocks(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links between different components in the buckets of `rest(band, part, node, size, root, main)`.

    A bucket's texts outside its main component are dealt into blocks of bounded size, as are all of its texts; each pair
    of such blocks meets in one task. Buckets of the same texts are taken once.
    """
    same = rest.groupBy("band", "part").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"))
    once = same.groupBy("n", "s").agg(F.min(F.struct("band", "part")).alias("k")).select("k.band", "k.part")
    rows = rest.join(once, ["band", "part"])
    blocks = lambda size: F.greatest(F.ceil(F.sum(size) / BLOCK_SHINGLES), F.lit(1)).cast("int")
    counted = F.greatest("size", F.lit(SHORT))
    outside = F.when(F.col("root") != F.col("main"), counted).otherwise(0)
    totals = rows.groupBy("band", "part").agg(blocks(counted).alias("rights"), blocks(outside).alias("lefts"))
    whole = durable(rows.join(totals, ["band", "part"]).join(sets, "node"))
    items = F.collect_list(F.struct("node", "root", "shingles"))
    right = whole.groupBy("band", "part", F.pmod(F.xxhash64("node"), F.col("rights")).cast("int").alias("j")).agg(items.alias("right"))
    left = whole.where("root <> main").groupBy("band", "part", "rights", F.pmod(F.xxhash64("node", F.lit(7)), F.col("lefts")).alias("i")).agg(items.alias("left"))
    met = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))).join(right, ["band", "part", "j"]).select("left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for left, right in zip(b.column(0), b.column(1)):
                (a, roots_a, one), (c, roots_c, two) = ([x.values.field("node").to_numpy(), x.values.field("root").to_numpy(), x.values.field("shingles")] for x in (left, right))
                n, m = _intersections(one, two), np.add.outer(np.asarray(one.value_lengths()), np.asarray(two.value_lengths()))
                near = (n >= least * (m - n) - 1e-9) & (roots_a[:, None] != roots_c[None, :])
                i, j = _spanning(near, roots_a, roots_c)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(c[j])], names=["a", "b"])

    return durable(met.mapInArrow(compare, "a long, b long"))


def _close(a: Column | str, b: Column | str, least: float) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) >= F.lit(least) * F.greatest(a, b) - 1e-9


def _by_fingerprints(nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of `nodes(node, size, fp)` to verify, whose fingerprints are equal or linked over at most three bits.

    Each fingerprint stands by its smallest node, so that there are a few pairs a node.
    """
    rows = nodes.where("size > 1").select("node", "size", "fp")
    first = durable(rows.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("s")).select("fp", "s.node", "s.size"))
    side = lambda x: first.select(F.col("fp").alias(f"fp_{x}"), F.col("node").alias(x), F.col("size").alias(f"size_{x}"))
    near = near_links(first.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(side("a"), "fp_a").join(side("b"), "fp_b")
    equal = rows.select("fp", F.col("node").alias("b"), F.col("size").alias("size_b")).join(side("a"), F.col("fp") == F.col("fp_a")).where("a <> b")
    pairs = near.select("a", "b", "size_a", "size_b").unionByName(equal.select("a", "b", "size_a", "size_b"))
    return durable(pairs.where(_close("size_a", "size_b", least)).select("a", "b"))


def _links(docs: DataFrame, nodes: DataFrame, text_col: str, words: int, least: float) -> DataFrame:
    """(a, b): links that join all nodes `(node, h, size, fp, bands)` which similar pairs connect."""
    proposed = _by_fingerprints(nodes, least)
    rows = nodes.where("size > 1").select("node", "size", F.posexplode("bands").alias("band", "part"))
    shared = rows.groupBy("band", "part").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1").drop("n")
    members = durable(rows.join(shared, ["band", "part"]))
    needed = members.select("node").unionByName(proposed.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets = _sets(docs, nodes.select("node", "h").join(needed, "node"), text_col, words)
    edges = _verified(proposed, sets, least)
    joined = durable(connected_components(edges))
    sizes = nodes.select(F.col("node").alias("hub"), F.col("size").alias("hub_size")).join(joined.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left")
    pairs = members.where("node <> hub").select("hub", "node", "size").distinct().join(joined, "node", "left").join(sizes, "hub")
    apart = F.coalesce(F.col("root") != F.col("hub_root"), F.lit(True))
    first = pairs.where(apart & _close("size", "hub_size", least)).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    edges = edges.unionByName(_verified(first, sets, least))

    tried, hubs, outside = shared.select("band", "part", F.col("hub").alias("node")), 1, None
    while True:
        roots = connected_components(edges)
        placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        counts = placed.groupBy("band", "part", "root").agg(F.count("*").alias("n"))
        mixed = counts.groupBy("band", "part").agg(F.count("*").alias("kinds"), F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("members")).where("kinds > 1")
        rest = durable(placed.join(mixed, ["band", "part"]).join(tried, ["band", "part", "node"], "left_anti").select("band", "part", "members", "node", "size", "root", "main"))
        waiting = rest.where("root <> main")
        buckets = waiting.groupBy("band", "part").agg(F.count("*").alias("n"), F.first("members").alias("members"))
        work = buckets.agg(F.sum(F.col("n") * F.col("members")).alias("pairs"), F.sum("members").alias("members"), F.sum("n").alias("n")).first()
        if not work.pairs:
            return edges
        left = waiting.select("band", "part", F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("root").alias("root_a"))
        right = rest.select("band", "part", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"), "main")
        apart = (F.col("root_a") != F.col("root_b")) & _close("size_a", "size_b", least)
        if work.pairs <= FEW_PAIRS * work.members:
            once = (F.col("root_b") == F.col("main")) | (F.col("a") < F.col("b"))
            second = left.join(right, ["band", "part"]).where(apart & once).select("a", "b").distinct()
            return edges.unionByName(_verified(second, sets, least))
        if outside and 2 * work.n > outside:
            return edges.unionByName(_by_blocks(rest, sets, least))
        outside = work.n
        order = F.row_number().over(Window.partitionBy("band", "part").orderBy(F.xxhash64("a"), "a"))
        chosen = durable(left.withColumn("r", order).where(F.col("r") <= hubs).drop("r"))
        pairs = chosen.join(right, ["band", "part"]).where(apart).select("a", "b").distinct()
        edges = edges.unionByName(_verified(pairs, sets, least))
        tried, hubs = tried.unionByName(chosen.select("band", "part", F.col("a").alias("node"))), 2 * hubs


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The marked rows, and (key, root) of every different text."""
    marked = _marked(docs, id_col, text_col, words)
    nodes = durable(marked.dropDuplicates(["key"]).select("key", "h", "size", "fp", "bands").withColumn("node", F.monotonically_increasing_id()))
    roots = connected_components(_links(docs, nodes, text_col, words, least))
    return marked, nodes.join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row per input row: `(doc_id, component_id)`, the smallest non-null id that links of similar texts reach.

    Texts of the same words are one text; blank and null texts are one class. An empty table gives an empty result.
    Texts of any length are taken whole; other columns don't matter, whatever their names.
    """
    marked, classes = _classes(docs, id_col, text_col, words, least)
    rooted = marked.select("doc_id", "key").join(classes, "key")
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(smallest, "root").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """The rows of `docs` without near duplicates: of each class the row with the smallest id stays.

    Null ids come last; rows that repeat the id and the text keep one of them. All columns stay, in order.
    """
    marked, classes = _classes(docs, id_col, text_col, words, least)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("w")
    of_key = marked.groupBy("key").agg(first)
    best = of_key.join(classes, "key").groupBy("root").agg(F.min("w").alias("w"))
    return rows_of(docs, best, id_col, text_col)
