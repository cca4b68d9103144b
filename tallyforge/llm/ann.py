"""Nearest neighbours by cosine: NN-descent builds a neighbour graph, queries search it greedily.

Nodes are directions, each with an 8-bit code. A round of NN-descent gathers, at each node, its neighbours and a sample of
those it is a neighbour of, compares them with each other and offers each the best of the rest; a join by node keeps
the K best. Rounds go on until few edges change. A search step joins the unexpanded part of all beams with the graph,
until all beams are expanded. Where a node's neighbours are nearer than its code can tell, the search goes on a level
deeper: such nodes fall into groups, each is coded again by what its directions differ in, magnified, and the same graph
and search tell them apart; groups within groups follow until every code resolves its neighbours. The answers of all levels
are ranked by the exact measure on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import durable, forget

#: Neighbours a node, offers a member in a round, trees and leaf size of the first graph.
K, OFFERS, TREES, LEAF = 24, 6, 3, 64
#: Rounds end when fewer than this part of the edges is new.
SETTLED = 0.05
#: Beam of a search, and about how many queries one group of a step holds.
BEAM, GROUP = 256, 4096
#: Vectors from which the split planes of the first graph are drawn.
PLANE_SAMPLE = 2048
#: Components of a node's 8-bit copy; longer vectors are folded for it. Unit vectors equal on this grid are one node.
FOLD, GRID = 4096, float(1 << 32)
#: A node whose K-th neighbour is within so many errors of the codes (of squared distance) is looked at on the next level,
#: with its group if that is larger than a part of the beam. No level is needed below the grid.
ERRORS, LEVELS = 16, 8
_NONE = -1e30
_CANDIDATES = "u long, v long, s float"


def _packed(size: int, unit: bool):
    """A column function: the vector (its direction, if `unit`) as a float and `size` signed bytes of that scale."""

    @F.pandas_udf(T.BinaryType())
    def packed(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in vectors:
            out = []
            for v in batch:
                x = np.asarray(v, dtype=np.float64)
                x = x / np.sqrt((x * x).sum()) if unit else x
                whole = np.zeros(-(-max(len(x), 1) // size) * size)
                whole[: len(x)] = x
                parts = whole.reshape(-1, size)
                x = (parts * np.where(np.random.default_rng(len(parts)).random(parts.shape) < 0.5, 1, -1)).sum(axis=0) if len(parts) > 1 else parts[0]
                scale = np.float32(max(np.abs(x).max(), 1e-30))
                out.append(scale.tobytes() + np.rint(x * (127.0 / scale)).clip(-127, 127).astype(np.int8).tobytes())
            yield pd.Series(out, dtype=object)

    return packed


def _points(column: pa.Array) -> np.ndarray:
    """The packed vectors of a binary column as rows."""
    if not len(column):
        return np.empty((0, 1), np.float32)
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(len(column), -1)
    return raw[:, 4:] * (np.ascontiguousarray(raw[:, :4]).view(np.float32) / np.float32(127))


def _nearness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The negative squared distances, taken about the middle of `right`, so that points near each other lose no digits."""
    middle = right.mean(axis=0) if len(right) else 0
    left, right = left - middle, right - middle
    return 2 * (left @ right.T) - (left * left).sum(axis=1)[:, None] - (right * right).sum(axis=1)[None, :]


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """`(vec_id, vector)` of the rows with an id and a finite, non-zero vector, in double precision.

    Each vector is multiplied by the power of two that brings its largest component near one: cosines stay the same to
    the last digit, and neither huge nor tiny components overflow.
    """
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v")).where("v is not null and vec_id is not null")
    power = F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.floor(F.log2(F.array_max(F.transform("v", F.abs)))).cast("double")))
    return rows.select("vec_id", F.zip_with("v", F.array_repeat(F.pow(F.lit(2.0), -power), F.size("v")), lambda x, y: x * y).alias("vector"))


def _direction(vector: Column) -> list[Column]:
    """Two hashes of the direction; components past the end count as zeros."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, x: t + x * x))
    places = F.zip_with(vector, F.array_repeat(length, F.size(vector)), lambda x, y: F.round(x / y * GRID).cast("long"))
    one = lambda seed: F.aggregate(F.transform(places, lambda x, i: F.when(x != 0, F.xxhash64(x, i, F.lit(seed))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(x))
    return [one(1), one(2)]


def _compare(offers: int):
    """The local join: members of each group offer each other their best, if new and good enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0)
            flat = groups.flatten()
            ids, kth = flat.field("m").to_numpy(), flat.field("kth").to_numpy()
            fresh, vec = flat.field("fresh").to_numpy(zero_copy_only=False), _points(flat.field("vec"))
            ends = np.cumsum([len(g) for g in groups])
            us, vs, ss = [], [], []
            for end, size in zip(ends, np.diff(ends, prepend=0)):
                at = slice(end - size, end)
                s = _nearness(vec[at], vec[at])
                s[ids[at][:, None] == ids[at][None, :]] = 2 * _NONE
                s[~(fresh[at][:, None] | fresh[at][None, :])] = 2 * _NONE
                best = np.argpartition(-s, offers, axis=1)[:, :offers] if size > offers else np.tile(np.arange(size), (size, 1))
                score = np.take_along_axis(s, best, 1)
                row, col = np.nonzero((score > kth[at][:, None]) & (score > _NONE))
                us.append(ids[at][row])
                vs.append(ids[at][best[row, col]])
                ss.append(score[row, col])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(ss).astype(np.float32))], names=["u", "v", "s"])

    return run


def _offers(members: DataFrame, offers: int) -> DataFrame:
    """`members(c, m, vec, kth, fresh)` compared within each c."""
    grouped = members.groupBy("c").agg(F.collect_list(F.struct("m", "vec", F.col("kth").cast("float").alias("kth"), "fresh")).alias("g")).select("g")
    return grouped.mapInArrow(_compare(offers), _CANDIDATES)


def _best(candidates: DataFrame, known: DataFrame | None) -> DataFrame:
    """The K best neighbours `(u, v, s, fresh)` of each node among its known ones and the new candidates."""
    rows = candidates.select("u", "v", "s", F.lit(True).alias("fresh"))
    if known is not None:
        rows = rows.unionByName(known.select("u", "v", "s", F.lit(False).alias("fresh")))
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.repartition(parts, "u").groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return durable(each.withColumn("r", rank).where(F.col("r") <= K).drop("r"))


def _first_groups(nodes: DataFrame) -> DataFrame:
    """Members of the leaves of a few random-plane trees and of one random dealing, by group; large leaves are dealt into parts."""
    n = nodes.count()
    largest = nodes.groupBy("group").count().agg(F.max("count")).first()[0] or 1
    sample = nodes.orderBy(F.xxhash64("node")).limit(PLANE_SAMPLE).select("vec").collect()
    points = _points(pa.array([bytes(r.vec) for r in sample], type=pa.binary()))
    rng, depth = np.random.default_rng(11), max(0, int(np.log2(max(1, largest / LEAF))))
    planes = [points[rng.integers(len(points), size=depth)] - points[rng.integers(len(points), size=depth)] for _ in range(TREES)]
    cuts = [np.median(points @ p.T, axis=0) if depth else np.empty(0) for p in planes]

    @F.pandas_udf("array<long>")
    def leaves(vecs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in vecs:
            x = _points(pa.array(batch.tolist(), type=pa.binary()))
            codes = np.zeros((len(x), TREES), dtype=np.int64)
            for t in range(TREES):
                for bit in (x @ planes[t].T > cuts[t]).T if depth else ():
                    codes[:, t] = codes[:, t] * 2 + bit
            yield pd.Series(list(codes))

    placed = nodes.select("node", "group", "vec", F.posexplode(leaves("vec")).alias("tree", "code"))
    sizes = placed.groupBy("group", "tree", "code").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("parts"))
    spread = placed.join(sizes, ["group", "tree", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    dealt = nodes.select("group", F.lit(TREES).alias("tree"), F.lit(0).cast("long").alias("code"), "node", "vec", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(max(1, n // LEAF))).alias("part"))
    both = spread.select("group", "tree", "code", "node", "vec", "part").unionByName(dealt)
    return both.select(F.xxhash64("group", "tree", "code", "part").alias("c"), F.col("node").alias("m"), "vec", F.lit(_NONE).alias("kth"), F.lit(True).alias("fresh"))


def _both_ways(edges: DataFrame) -> DataFrame:
    """`(c, m, fresh)`: each node's neighbours, and a sample of K of the nodes that it is a neighbour of."""
    back = edges.select(F.col("v").alias("c"), F.col("u").alias("m"), "fresh")
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("fresh"), F.xxhash64("c", "m")))
    some = back.withColumn("r", rank).where(F.col("r") <= K).drop("r")
    return edges.select(F.col("u").alias("c"), F.col("v").alias("m"), "fresh").unionByName(some)


def neighbour_graph(nodes: DataFrame, settled: float = SETTLED) -> DataFrame:
    """NN-descent over `nodes(node, group, vec)`: `(u, v, s, fresh)`, at most K neighbours a node, of its own group.

    Rounds go on until at most the part `settled` of the edges is new; each replaces edges by better ones, so they end.
    """
    edges = _best(_offers(_first_groups(nodes), 2 * OFFERS), None)
    while True:
        kth = edges.groupBy("u").agg(F.min("s").alias("kth"), F.count("*").alias("n"))
        limits = nodes.join(kth, nodes.node == kth.u, "left").select(F.col("node").alias("m"), "vec", F.when(F.col("n") >= K, F.col("kth")).otherwise(F.lit(_NONE)).alias("kth"))
        members = _both_ways(edges).join(limits, "m").select("c", "m", "vec", "kth", "fresh")
        edges, last = _best(_offers(members, OFFERS), edges), edges
        forget(last)
        row = edges.agg(F.count_if("fresh").alias("fresh"), F.count("*").alias("n")).first()
        if row.fresh <= settled * row.n:
            return edges


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A search step at the nodes: score each neighbour for each query whose beam holds the node."""
    for batch in batches:
        us, vs, ss = [], [], []
        for asked, near in zip(batch.column(0), batch.column(1)):
            q, limit = asked.values.field("q").to_numpy(), asked.values.field("limit").to_numpy()
            names = near.values.field("m").to_numpy()
            s = _nearness(_points(asked.values.field("qvec")), _points(near.values.field("vec")))
            row, col = np.nonzero((s > limit[:, None]) & (q[:, None] != names[None, :]))
            us.append(q[row])
            vs.append(names[col])
            ss.append(s[row, col])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(ss).astype(np.float32))], names=["u", "v", "s"])


def greedy_search(graph: DataFrame, queries: DataFrame) -> DataFrame:
    """`(q, node, s)`: beams of `queries(node, vec)` over `graph(node, near)`, near an array of (m, vec).

    A query is a node of the graph and starts from itself. All queries step together, each taking its vector along; a
    step expands what is new in the beams, and the search ends when nothing is.
    """
    own = queries.select(F.col("node").alias("q"), F.col("vec").alias("qvec"))
    salts = max(1, queries.count() // GROUP)
    todo, beam = own.select("q", F.col("q").alias("node"), F.lit(_NONE).cast("float").alias("limit"), "qvec"), None
    while True:
        asked = todo.groupBy("node", F.pmod(F.xxhash64("q"), F.lit(salts)).alias("salt")).agg(F.collect_list(F.struct("q", "limit", "qvec")).alias("asked"))
        found = asked.join(graph, "node").select("asked", "near").mapInArrow(_expand, _CANDIDATES).select(F.col("u").alias("q"), F.col("v").alias("node"), "s", F.lit(False).alias("done"))
        rows = found if beam is None else found.unionByName(beam.select("q", "node", "s", F.lit(True).alias("done")))
        each = rows.groupBy("q", "node").agg(F.max("s").alias("s"), F.max("done").alias("done"))
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "node"))
        beam, last = durable(each.withColumn("r", rank).where(F.col("r") <= BEAM)), beam
        if last is not None:
            forget(last)
        new = beam.where("not done")
        if new.isEmpty():
            return beam.select("q", "node", "s")
        limits = beam.groupBy("q").agg(F.when(F.count("*") >= BEAM, F.min("s")).otherwise(F.lit(_NONE)).cast("float").alias("limit"))
        todo = new.join(limits.join(own, "q"), "q").select("q", "node", "limit", "qvec")


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of doubles, summed in order; components past the end of one count as zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda t, p: t + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unresolved(nodes: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """`(node, group)` of nodes whose neighbours are nearer than codes tell, in groups that neighbours join, if these are large."""

    @F.pandas_udf("double")
    def error(vecs: pd.Series) -> pd.Series:
        scale = np.array([np.frombuffer(v[:4], dtype=np.float32)[0] for v in vecs], dtype=float)
        return pd.Series(ERRORS * size * (scale / 127) ** 2 / 6)

    limits = nodes.select("node", error("vec").alias("near"))
    kth = edges.groupBy("u").agg(F.min("s").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= K)
    hot = durable(kth.join(limits, kth.u == limits.node).where(-F.col("kth") <= F.col("near")).select("node", "near"))
    if hot.isEmpty():
        return hot.select("node", F.col("node").alias("group"))
    close = edges.join(hot, edges.u == hot.node).where(-F.col("s") <= F.col("near")).select("u", "v").join(hot.select(F.col("node").alias("v")), "v")
    groups = connected_components(close.select(F.col("u").alias("a"), F.col("v").alias("b")))
    large = groups.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > BEAM // 2)
    return durable(groups.join(large, "root").select("node", F.col("root").alias("group")))


def _magnified(groups: DataFrame, directions: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Codes `(node, group, vec)` and vectors `(node, vector)` of what the members of each group differ in, its largest difference being one."""
    rows = durable(groups.join(directions, "node"))
    centers = rows.where(F.col("node") == F.col("group")).select("group", F.col("vector").alias("center"))
    longest = F.greatest(F.size("vector"), F.size("center"))
    at = lambda v, i: F.coalesce(F.get(v, i), F.lit(0.0))
    less = F.transform(F.sequence(F.lit(0), longest - 1), lambda i: at("vector", i) - at("center", i))
    apart = durable(rows.join(centers, "group").select("node", "group", less.alias("vector")))
    largest = apart.groupBy("group").agg(F.max(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x)).alias("r"))
    out = durable(apart.join(largest, "group").select("node", "group", F.transform("vector", lambda x: x / F.sqrt(F.greatest("r", F.lit(1e-300)))).alias("vector")))
    return durable(out.select("node", "group", _packed(size, False)("vector").alias("vec"))), out.select("node", "vector")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """`(query_id, rank, vec_id, score)`: for each row where `is_query` (over vec_id), its k nearest found.

    Nearest first by cosine, ties to the smaller vec_id; all other rows are candidates, copies of the query's
    vector included. Rows whose vector is null, zero or has null or non-finite parts take no part; a shorter vector
    counts as one with zeros at its end. Of vectors of one direction (equal to nine digits, which cosines of each other
    can't tell from one) the k + 1 of smallest id stand for all. Repeated ids of equal vectors count once. Other columns
    don't matter, whatever their names. An empty table gives an empty result.
    """
    rows = usable(vectors, id_col, vec_col).dropDuplicates(["vec_id", "vector"])
    h, h2 = _direction(F.col("vector"))
    keyed = durable(rows.select("vec_id", "vector", h.alias("h"), h2.alias("h2")))
    place = F.row_number().over(Window.partitionBy("h", "h2").orderBy("vec_id", "vector"))
    first = keyed.withColumn("r", place).where(F.col("r") <= k + 1)
    groups = first.groupBy("h", "h2").agg(F.sort_array(F.collect_list(F.struct("vec_id", "vector"))).alias("members"))
    copies = durable(groups.select("h", "h2", F.xxhash64("h", "h2").alias("node"), F.col("members")[0]["vector"].alias("vector"), "members"))
    asked = durable(keyed.where(is_query).join(copies.select("h", "h2", "node"), ["h", "h2"]).select("vec_id", F.col("vector").alias("own"), "node"))
    size = min(copies.agg(F.max(F.size("vector"))).first()[0] or 1, FOLD)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x))
    directions = copies.select("node", F.zip_with("vector", F.array_repeat(length, F.size("vector")), lambda x, y: x / y).alias("vector"))
    nodes = durable(copies.select("node", F.lit(0).cast("long").alias("group"), _packed(size, True)("vector").alias("vec")))
    beams = None
    for _ in range(LEVELS):
        edges = neighbour_graph(nodes)
        links = _both_ways(edges).select("c", "m").distinct()
        graph = durable(links.join(nodes.select(F.col("node").alias("m"), "vec"), "m").groupBy(F.col("c").alias("node")).agg(F.collect_list(F.struct("m", "vec")).alias("near")))
        queries = durable(nodes.select("node", "vec").join(asked.select("node").distinct(), "node"))
        found = greedy_search(graph, queries).select("q", "node").unionByName(queries.select(F.col("node").alias("q"), "node"))
        beams = found if beams is None else beams.unionByName(found)
        deeper = _unresolved(nodes, edges, size)
        if deeper.isEmpty():
            break
        nodes, directions = _magnified(deeper, directions, size)
    whole = copies.select("node", "vector")
    ranked = beams.distinct().join(whole, "node").join(whole.select(F.col("node").alias("q"), F.col("vector").alias("asked")), "q").select("q", "node", cosine(F.col("asked"), F.col("vector")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "node"))
    closest = ranked.withColumn("r", rank).where(F.col("r") <= 4 * (k + 1))
    candidates = closest.join(copies.select("node", "members"), "node").groupBy(F.col("q").alias("node")).agg(F.flatten(F.collect_list("members")).alias("members"))
    scored = asked.join(candidates, "node").select(F.col("vec_id").alias("query_id"), "own", F.explode("members").alias("m")).where("m.vec_id <> query_id")
    scored = scored.select("query_id", F.col("m.vec_id").alias("vec_id"), cosine(F.col("own"), F.col("m.vector")).alias("score")).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
