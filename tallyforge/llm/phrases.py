"""Frequent phrases with association scores, counted by suffix subtrees over a vertical partition of the text.

Three steps. A first scan counts words and, in a table of fixed size, how many suffixes begin with each cell of two-word
prefixes. Cells are put together into groups of bounded size, a cell above the bound by itself and cut further by its
following words. A second scan sends every suffix, cut after four words or before a rare one, to its prefix's group;
equal ones of a task travel as one with their number. Each group then builds its depth-truncated subtree by itself: its
suffixes in order are the leaves, and a node's count is the sum of its leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.numbering import numbered

from .shared import durable, utf8
from .words import mix

DEPTH = 4
#: Suffixes that one group may hold: what a task needs in memory.
BUDGET = 1_000_000
#: Prefix cells of the first scan, and bits of the set of frequent words; both are fixed.
CELLS, SLOTS = 1 << 14, 1 << 25
#: Bytes of text that a task takes at a time; a longer text is cut between pieces.
PORTION = 16 << 20
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_kinds = np.zeros(256, dtype=np.uint8)
_kinds[[9, 32]] = 1
_kinds[[*b".,;:!?", 10, 11, 12, 13]] = 2
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of a portion at most, cut at separators; a longer piece stays whole."""
    at = 0
    while len(text) - at > PORTION:
        window = np.flatnonzero(_kinds[np.frombuffer(text, np.uint8, PORTION, at)] == 2)
        if len(window):
            end = at + int(window[-1]) + 1
        else:
            later = np.flatnonzero(_kinds[np.frombuffer(text, np.uint8, offset=at)] == 2)
            end = at + int(later[0]) + 1 if len(later) else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, texts of it joined by a separator), about a portion at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            for part in _parts(text.as_py()):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= PORTION:
                    yield from ((k, b"\n".join(v)) for k, v in held.items())
                    held, size = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each word its number in the dictionary and whether it goes on with the piece of the word before, and the dictionary; A-Z count as a-z."""
    data = np.frombuffer(text, dtype=np.uint8)
    kinds = _kinds[data]
    inside = kinds == 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    offsets = np.zeros(len(edges) // 2 + 1, dtype=np.int64)
    np.cumsum(edges[1::2] - edges[::2], out=offsets[1:])
    piece = np.searchsorted(np.flatnonzero(kinds == 2), edges[::2]).astype(np.int32)
    del kinds, edges
    words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(_lower[data[inside]])]).dictionary_encode()
    return words.indices.to_numpy(), np.diff(piece, prepend=-1) == 0, words.dictionary


def _hashes(lang: str, words: pa.Array) -> np.ndarray:
    """XXH64 of language and word, which Spark computes too."""
    head = lang.encode("utf-8", "surrogateescape") + b"\0"
    return np.fromiter((xxhash.xxh64_intdigest(head + w, 42) for w in words.to_pylist()), dtype=np.uint64, count=len(words))


def _cells(hashes: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (mix(hashes[first] * np.uint64(0x100000001B3) + hashes[second]) >> np.uint64(20)).astype(np.int64) % CELLS


def _scanned(texts: DataFrame) -> DataFrame:
    """(lang, word, cell, n): words with their numbers, and cells of two-word prefixes with theirs (word null)."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("cell", pa.int32()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _portions(batches):
            ids, goes_on, words = tokens(text)
            if not len(ids):
                continue
            pairs = np.flatnonzero(goes_on)
            sizes = np.bincount(_cells(_hashes(lang, words), ids[pairs - 1], ids[pairs]), minlength=CELLS)
            used = np.flatnonzero(sizes)
            k, m = len(words), len(used)
            named = pa.array([lang], pa.string()).take(pa.array(np.zeros(k + m, np.int64)))
            cell = pa.array(np.concatenate([np.zeros(k, np.int32), used.astype(np.int32)]), mask=np.arange(k + m) < k)
            yield pa.RecordBatch.from_arrays([named, pa.concat_arrays([words.cast(pa.binary()), pa.nulls(m, pa.binary())]), cell, pa.array(np.concatenate([np.bincount(ids, minlength=k), sizes[used]]))], schema=schema)

    return durable(texts.mapInArrow(scan, "lang string, word binary, cell int, n long"))


def groups_of(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first group, parts) of each cell, and how many groups there are: neighbours share one until it is full; a cell beyond the budget gets several."""
    first, parts = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    now, held = 0, 0
    for cell, n in enumerate(sizes.tolist()):
        if n > budget:
            continue
        if held + n > budget:
            now, held = now + 1, 0
        first[cell], held = now, held + n
    count = now + 1
    for cell in np.flatnonzero(sizes > budget):
        first[cell], parts[cell] = count, -(-int(sizes[cell]) // budget)
        count += int(parts[cell])
    return first, parts, count


def _leaves(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The different suffixes in order, and how often each occurs (or the sum of its counts). Takes the columns out of their list."""
    bits = max(1, int(max((c.max(initial=0) for c in columns), default=0)).bit_length())
    if 4 * bits > 64:
        first, second, third, fourth = (c.astype(np.int64) for c in columns)
        heads, at = np.unique(first << 32 | second, return_inverse=True)
        tails, to = np.unique(third << 32 | fourth, return_inverse=True)
        keys, n = _summed(at << np.int64(32) | to, counts)
        head, tail = heads[keys >> 32], tails[keys & 0xFFFFFFFF]
        return [head >> 32, head & 0xFFFFFFFF, tail >> 32, tail & 0xFFFFFFFF], n
    key = columns.pop(0).astype(np.uint64)
    while columns:
        key <<= np.uint64(bits)
        key |= columns.pop(0).astype(np.uint64)
    keys, n = _summed(key, counts)
    mask = np.uint64((1 << bits) - 1)
    return [(keys >> np.uint64(bits * (DEPTH - 1 - i)) & mask).astype(np.int64) for i in range(DEPTH)], n


def _summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order with the sums of their counts, or their numbers."""
    if counts is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ keys.dtype.type(1))) if len(keys) else np.empty(0, np.int64)
    if counts is None:
        return keys[starts], np.diff(np.append(starts, len(keys)))
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts[:0]


def _packed(**columns: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def _sent(texts: DataFrame, frequent: np.ndarray, first: np.ndarray, parts: np.ndarray) -> DataFrame:
    """(group, lang, suffixes, words): a task's suffixes of frequent words for each group, equal ones as one, with the words they name."""
    shared = texts.sparkSession.sparkContext.broadcast((frequent, first, parts))
    schema = pa.schema([("group", pa.int64()), ("lang", pa.string()), ("suffixes", pa.binary()), ("words", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, parts = shared.value
        for lang, text in _portions(batches):
            ids, goes_on, words = tokens(text)
            hashes = _hashes(lang, words)
            slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
            kept = np.flatnonzero(known[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            number = np.zeros(len(words) + 1, dtype=np.int32)
            number[kept] = np.arange(1, len(kept) + 1)
            ids = number[ids]
            begins = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0) & goes_on[1:])
            if not len(begins):
                continue
            columns, open_, at = [ids[begins]], np.ones(len(begins), dtype=bool), begins
            for _ in range(1, DEPTH):
                at = at + 1
                open_ &= at < len(ids)
                spot = np.minimum(at, len(ids) - 1)
                open_ &= goes_on[spot]
                columns.append(np.where(open_, ids[spot], 0))
                open_ &= columns[-1] > 0
            del ids, goes_on, begins, open_, at, spot
            columns, n = _leaves(columns)
            hashes = np.concatenate([np.zeros(1, np.uint64), hashes[kept]])
            cell = _cells(hashes, columns[0], columns[1])
            more = mix(hashes[columns[2]] * np.uint64(0x100000001B3) + hashes[columns[3]]) >> np.uint64(16)
            group = first[cell] + (more % parts[cell].astype(np.uint64)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            bounds = np.flatnonzero(np.diff(group[order], prepend=-1))
            rows = []
            for a, z in zip(bounds, [*bounds[1:], len(order)]):
                own = order[a:z]
                used, at = np.unique(np.concatenate([c[own] for c in columns]), return_inverse=True)
                used, at = (used, at) if used[0] == 0 else (np.concatenate([[0], used]), at + 1)
                small = at.astype(np.min_scalar_type(len(used))).reshape(DEPTH, -1)
                blob = _packed(**{f"w{i}": pa.array(c) for i, c in enumerate(small)}, n=pa.array(n[own].astype(np.min_scalar_type(int(n[own].max())))))
                rows.append((int(group[own[0]]), lang, blob, _packed(word=words.take(pa.array(kept[used[1:] - 1])))))
                if len(rows) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return texts.mapInArrow(send, "group long, lang string, suffixes binary, words binary")


def subtree(blobs: list[tuple[bytes, bytes]], least: int) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    """(phrases, words each, counts) of the nodes of two words and more that occur `least` times in a group's suffixes of one language."""
    suffixes, words = zip(*((_unpacked(s), _unpacked(w).column(0)) for s, w in blobs))
    dictionary = pa.concat_arrays(words).dictionary_encode()
    ids, at, columns = dictionary.indices.to_numpy(), 0, [[] for _ in range(DEPTH)]
    for s, w in zip(suffixes, words):
        number = np.concatenate([[0], ids[at : at + len(w)].astype(np.int64) + 1])
        at += len(w)
        for i in range(DEPTH):
            columns[i].append(number[s.column(i).to_numpy()])
    counts = np.concatenate([s.column(DEPTH).to_numpy().astype(np.int64) for s in suffixes])
    columns, counts = _leaves([np.concatenate(c) for c in columns], counts)
    changed = np.zeros(len(counts), dtype=bool)
    changed[0] = True
    for depth, column in enumerate(columns, 1):
        changed[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(changed)
        sums = np.add.reduceat(counts, starts)
        kept = (sums >= least) & (column[starts] > 0)
        if depth > 1 and kept.any():
            at = starts[kept]
            named = [dictionary.dictionary.take(pa.array(c[at] - 1)) for c in columns[:depth]]
            yield pc.binary_join_element_wise(*named, pa.scalar(b" ", pa.large_binary())), depth, sums[kept]


def phrase_counts(docs: DataFrame, least: int = 30, budget: int = BUDGET, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """`(lang, phrase, k, a)`: phrases of one to four words that occur `least` times, and `(lang, n)`: all words of a language.

    A-Z count as a-z; words lie between blanks and tabs; phrases don't cross `.,;:!?` or line breaks. A null language
    is `und`, a null or empty text has no words, an empty table gives empty results. Repeated rows count each time, texts
    are taken whole, other columns don't matter.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), utf8(F.col(text_col)).alias("text"))
    scanned = _scanned(texts)
    words = durable(scanned.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("a")))
    sizes = np.zeros(CELLS, dtype=np.int64)
    for r in scanned.where("word is null").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sizes[r.cell] = r.n
    first, parts, _ = groups_of(sizes, budget)

    often = words.where(F.col("a") >= least)
    slot = F.xxhash64(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("word"))).bitwiseAND(F.lit(SLOTS - 1)) + 1
    frequent = np.zeros(SLOTS // 8, dtype=np.uint8)
    marked = often.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    for r in marked.collect():
        frequent[(r.b - 1) * len(r.bits) : r.b * len(r.bits)] = np.frombuffer(r.bits, dtype=np.uint8)
    split = parts.max() > 1
    whole = int(first[parts > 1].min()) if split else 1 << 62
    out = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("k", pa.int32()), ("a", pa.int64())])

    def build(table: pa.Table) -> pa.Table:
        by: dict[str, list] = {}
        for lang, s, w in zip(table["lang"].to_pylist(), table["suffixes"].to_pylist(), table["words"].to_pylist()):
            by.setdefault(lang, []).append((s, w))
        few = least if table["group"][0].as_py() < whole else 1
        made = [
            pa.Table.from_arrays([pa.array([lang] * len(n), pa.string()), names.cast(pa.binary()), pa.array(np.full(len(n), k, np.int32)), pa.array(n)], schema=out)
            for lang, blobs in by.items()
            for names, k, n in subtree(blobs, few)
        ]
        return pa.concat_tables(made) if made else out.empty_table()

    nodes = _sent(texts, frequent, first, parts).groupBy("group").applyInArrow(build, "lang string, phrase binary, k int, a long")
    summed = nodes.groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    both = often.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "a").unionByName(summed)
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    return durable(both.withColumn("phrase", F.col("phrase").cast("string"))), totals


def _parts_of(words: str, start, length) -> F.Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame) -> DataFrame:
    """`(lang, phrase, a, l, r, score)` of every phrase of two words and more, at the cut with the lowest score, the first such.

    The score is 2000000 a / (l + r), rounded down, in decimals of 38 digits."""
    words = counts.where("k > 1").withColumn("w", F.split("phrase", " "))
    cuts = words.select("lang", "phrase", "k", "a", "w", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    ends = cuts.select("lang", "phrase", "a", "cut", _parts_of("w", F.lit(1), F.col("cut")).alias("head"), _parts_of("w", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    known = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    both = ends.join(known("head", "l"), ["lang", "head"]).join(known("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m")
    return both.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def covered(counts: DataFrame) -> DataFrame:
    """`(lang, phrase, longest)`: phrases inside longer ones, with the greatest count of such a longer one."""
    longer = counts.where("k > 2").withColumn("w", F.split("phrase", " "))
    inside = longer.select("lang", "a", "w", F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> struct(i, m))))")).alias("x"))
    return inside.select("lang", _parts_of("w", F.col("x.i"), F.col("x.m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, budget: int = BUDGET, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`(lang, rank, phrase, a, l, r, n, score)`: each language's best phrases of two to four words that occur `least` times.

    Phrases that lie in a longer one of at least 80 % of their count are left out. Order is by score, then count, both
    descending, then by the phrase's bytes. For nulls, repeated rows and empty tables see `phrase_counts`.
    """
    counts, totals = phrase_counts(docs, least, budget, text_col, lang_col)
    hidden = F.coalesce(F.lit(100).cast("decimal(3,0)") * F.col("longest").cast("decimal(19,0)") >= F.lit(80).cast("decimal(3,0)") * F.col("a").cast("decimal(19,0)"), F.lit(False))
    left = scored(counts).join(covered(counts), ["lang", "phrase"], "left").where(~hidden).drop("longest")
    order = "lang", F.desc("score"), F.desc("a"), "phrase"
    placed = durable(numbered(durable(left), *order))
    start = placed.groupBy("lang").agg(F.min("row").alias("start"))
    ranked = placed.join(start, "lang").withColumn("rank", F.col("row") - F.col("start") + 1).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
