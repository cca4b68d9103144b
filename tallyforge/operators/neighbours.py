"""Exact and approximate k nearest neighbours on tables of numeric features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.tables import durable, forget

#: Numbers of a block of rows that meets a block of queries in one task.
BLOCK_NUMBERS = 1_000_000
#: Distances that a task holds at once, and numbers of the rows that it sends on at once.
HELD = 500_000
#: Rows of a block at most, times the root of all rows: a query then looks at about as many blocks as rows of a block.
BALANCE = 8
#: Tasks at most that blocks are dealt to.
TASKS = 2000
#: Numbers of the rows that a task of the second search holds, pairs of a query and a row from which on such a task is split, and how many tasks splits make.
GROUP_NUMBERS, TASK_PAIRS, SPLITS = 8_000_000, 10_000_000, 64
#: Pivots at most, and rings around a pivot by which its rows are counted and cut into blocks.
PIVOTS, RINGS = 4096, 64


def _nearest_pivot(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distances to all pivots, and the nearest of them."""
    far = points @ pivots.T
    far *= -2
    far += (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :]
    np.sqrt(np.maximum(far, 0, out=far), out=far)
    return far, far.argmin(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _placed(features: pa.Array, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and the distance to it; only so many rows meet the pivots at once that `HELD` distances stand in memory."""
    cell, reach = np.zeros(len(features), np.int32), np.zeros(len(features))
    step = max(1, HELD // max(1, *pivots.shape))
    for at in range(0, len(features), step):
        points = _matrix(features.slice(at, step))
        _, cell[at : at + step] = _nearest_pivot(points, pivots)
        reach[at : at + step] = np.sqrt(((points - pivots[cell[at : at + step]]) ** 2).sum(axis=1))
    return cell, reach


class _Plan:
    """Pivots, and for each block of rows its cell, its distances from the pivot and its size: what bounds the search."""

    def __init__(self, pivots: np.ndarray, rings: np.ndarray, scale: np.ndarray, per_block: int):
        self.pivots, self.scale = pivots, scale
        self.first, self.parts = np.zeros(rings.shape, np.int64), np.ones(rings.shape, np.int64)
        count = 0
        for cell, sizes in enumerate(rings):
            held = 0
            for ring, n in enumerate(sizes.tolist()):
                if n and held and held + n > per_block:
                    count, held = count + 1, 0
                self.first[cell, ring] = count
                if n > per_block:
                    self.parts[cell, ring] = -(-n // per_block)
                    count, held = count + int(self.parts[cell, ring]) - 1, per_block
                held += n
            count += 1
        self.blocks = count

    def ring(self, cell: np.ndarray, reach: np.ndarray) -> np.ndarray:
        return np.minimum(reach / self.scale[cell] * RINGS, RINGS - 1).astype(np.int64)

    def bounded(self, stats: list) -> None:
        """Take each block's `(block, cell, near, far, n)`."""
        rows = sorted(stats, key=lambda r: r.block)
        self.block, self.cell, self.n = (np.array([getattr(r, c) for r in rows], dtype=np.int64) for c in ("block", "cell", "n"))
        self.near, self.far = (np.array([getattr(r, c) for r in rows], dtype=float) for c in ("near", "far"))

    def grouped(self, rows: int) -> int:
        """Put blocks that follow each other into groups of about so many rows; how many groups there are."""
        before = np.cumsum(self.n) - self.n
        _, self.group = np.unique(before // max(1, rows), return_inverse=True)
        self.starts = np.flatnonzero(np.diff(self.group, prepend=-1))
        return len(self.starts)

    def least(self, points: np.ndarray) -> np.ndarray:
        """A lower bound of the distance from each point to the rows of each block, by rings and by planes between pivots."""
        to, home = _nearest_pivot(points, self.pivots)
        between, _ = _nearest_pivot(self.pivots[home], self.pivots)
        own = to[np.arange(len(to)), home][:, None]
        plane = np.divide(to * to - own * own, 2 * between, out=np.zeros_like(to), where=between > 1e-9)
        t = to[:, self.cell]
        return np.maximum(np.maximum(t - self.far, self.near - t), np.maximum(plane[:, self.cell], 0)) - 1e-7 * (1 + t)

    def home(self, least: np.ndarray, want: int) -> np.ndarray:
        """Which blocks each point visits first: those of the lowest bound that hold as many rows as are wanted.

        Every block holds a row, so they are among as many blocks as rows are wanted; only those are put in order.
        """
        first, most = np.zeros(least.shape, bool), min(want, least.shape[1])
        i, j = np.nonzero(least <= np.partition(least, most - 1, axis=1)[:, most - 1, None])
        best = np.lexsort((self.n[j], least[i, j], i))
        i, j = i[best], j[best]
        before = np.cumsum(self.n[j]) - self.n[j]
        first[i, j] = before - before[np.searchsorted(i, i)] < want
        return first


def _planned(rows: DataFrame, n: int, d: int, per_block: int) -> tuple[DataFrame, _Plan]:
    """`(block, cell, reach, ...)`: rows at their nearest pivot, cut by distance from it into blocks of bounded size."""
    few = min(PIVOTS, max(1, -(-2 * n // per_block)))
    drawn = rows.orderBy(F.xxhash64("row")).limit(few).select("features").collect()
    pivots = np.unique(np.array([r.features for r in drawn], dtype=float).reshape(len(drawn), -1), axis=0)

    @F.arrow_udf("cell int, reach double")
    def nearest(features: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in _placed(features, pivots)], names=["cell", "reach"])

    placed = durable(rows.withColumn("at", nearest("features")).select("*", "at.cell", "at.reach").drop("at"))
    scale = np.ones(len(pivots))
    for r in placed.groupBy("cell").agg(F.max("reach").alias("far")).collect():
        scale[r.cell] = max(r.far, 1e-300)
    plan = _Plan(pivots, np.zeros((0, RINGS), np.int64), scale, per_block)

    @F.arrow_udf("int")
    def ring(cell: pa.Array, reach: pa.Array) -> pa.Array:
        return pa.array(plan.ring(cell.to_numpy(), reach.to_numpy()).astype(np.int32))

    sizes = np.zeros((len(pivots), RINGS), dtype=np.int64)
    for r in placed.groupBy("cell", ring("cell", "reach").alias("ring")).agg(F.count("*").alias("n")).collect():
        sizes[r.cell, r.ring] = r.n
    plan = _Plan(pivots, sizes, scale, per_block)

    @F.arrow_udf("long")
    def block(cell: pa.Array, reach: pa.Array, salt: pa.Array) -> pa.Array:
        cell = cell.to_numpy()
        at = cell, plan.ring(cell, reach.to_numpy())
        return pa.array(plan.first[at] + salt.to_numpy() % plan.parts[at])

    salt = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 30))
    blocked = durable(placed.withColumn("block", block("cell", "reach", salt)))
    forget(placed)
    plan.bounded(blocked.groupBy("block").agg(F.first("cell").alias("cell"), F.min("reach").alias("near"), F.max("reach").alias("far"), F.count("*").alias("n")).collect())
    return blocked, plan


def _steps(plan: _Plan, n: int) -> Iterator[slice]:
    """Slices of n queries, of which so many meet the blocks and the pivots at once that `HELD` bounds stand in memory."""
    step = max(1, HELD // (4 * max(len(plan.block), len(plan.pivots))))
    return (slice(at, at + step) for at in range(0, n, step))


def _within(least: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Which blocks can hold a row within each point's squared distance."""
    return least <= np.sqrt(limit)[:, None] * (1 + 1e-9)


def _limits(column: pa.Array) -> np.ndarray:
    limit = column.to_numpy(zero_copy_only=False).astype(float)
    return np.where(np.isnan(limit), np.inf, limit)


def _visits(asked: DataFrame, plan: _Plan, want: int) -> DataFrame:
    """`(query_id, features, block)`: the blocks that a query visits first."""
    schema = T.StructType([asked.schema["query_id"], asked.schema["features"], T.StructField("block", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _steps(plan, batch.num_rows):
                some = batch.slice(at.start, at.stop - at.start)
                points = _matrix(some.column(1))
                i, j = np.nonzero(plan.home(plan.least(points), want))
                most = max(1, HELD // max(1, points.shape[1]))
                for a in range(0, len(i), most):
                    one = pa.array(i[a : a + most])
                    yield pa.RecordBatch.from_arrays([some.column(0).take(one), some.column(1).take(one), pa.array(plan.block[j[a : a + most]])], names=schema.names)

    return asked.select("query_id", "features").mapInArrow(deal, schema)


def _counted(asked: DataFrame, plan: _Plan, want: int) -> DataFrame:
    """One row `(n_queries, visits)` of queries with their limits: the blocks that each visits, which are counted where they are bounded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, visits = 0, 0
        for batch in batches:
            points, limit = _matrix(batch.column(0)), _limits(batch.column(1))
            queries += batch.num_rows
            for at in _steps(plan, batch.num_rows):
                least = plan.least(points[at])
                visits += int((plan.home(least, want) | _within(least, limit[at])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([queries]), pa.array([visits])], names=["queries", "visits"])

    each = asked.select("features", "limit").mapInArrow(count, "queries long, visits long")
    return each.agg(F.coalesce(F.sum("queries"), F.lit(0)).alias("n_queries"), F.coalesce(F.sum("visits"), F.lit(0)).alias("visits"))


def _places(ids: pa.Array) -> dict:
    """The places of each id of a block."""
    places: dict = {}
    for at, name in enumerate(ids.to_pylist()):
        places.setdefault(name, []).append(at)
    return places


def _own(names: pa.Array, places: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places `(query, row)` of a block where both have the same id, in order of the query."""
    pairs = [(i, at) for i, name in enumerate(names.to_pylist()) for at in places.get(name, ())]
    return np.array([i for i, _ in pairs], dtype=np.int64), np.array([at for _, at in pairs], dtype=np.int64)


def _nearest(
    q: np.ndarray, r: np.ndarray, rows: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray] | None = None, held: int = HELD, limit: np.ndarray | None = None, squares: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """`(query, row, distance)` as places: the k rows of `r` nearest to each of `q`, ties to the lower of `rows`, apart from `own`.

    With `limit`, rows farther from a query than it (a squared distance, or inf) may be left out. Only so many queries meet
    the rows at once that `held` distances stand in memory, however many queries there are.
    """
    squares, want, step = (r * r).sum(axis=1) if squares is None else squares, min(k, len(r)), max(1, held // max(1, len(r)))
    reach = squares.max(initial=0)
    for at in range(0, len(q), step):
        some = q[at : at + step]
        lengths = (some * some).sum(axis=1)
        rough = (-2 * some) @ r.T
        rough += squares[None, :]
        if own is not None:
            a, z = np.searchsorted(own[0], (at, at + len(some)))
            rough[own[0][a:z] - at, own[1][a:z]] = np.inf
        most = np.full(len(some), np.inf) if limit is None else limit[at : at + step] - lengths
        if (open_ := np.isinf(most)).any():
            most[open_] = np.partition(rough[open_], want - 1, axis=1)[:, want - 1]
        most += 1e-9 * (1 + reach + lengths)
        i, j = np.nonzero(rough <= most[:, None])
        if own is not None:
            fine = np.isfinite(rough[i, j])
            i, j = i[fine], j[fine]
        d = np.zeros(len(i))
        for x in range(q.shape[1]):
            d += (some[i, x] - r[j, x]) ** 2
        i, j, d = _first(i, j, d, rows, k)
        yield i + at, j, d


def _first(i: np.ndarray, j: np.ndarray, d: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of a query and a row's place, the k nearest of each query in their order, ties to the lower of `rows`."""
    best = np.lexsort((rows[j], d, i))
    i, j, d = i[best], j[best], d[best]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], d[first]


def _met(visits: DataFrame, blocks: DataFrame, k: int, exclude_self: bool, kinds: tuple, parts: int | None = None) -> DataFrame:
    """`(query_id, neighbour_row, neighbour_id, distance)`: the k best rows of each visited block.

    `blocks(block, row, id, features)` and `visits(block, query_id, features)` stand row by row, a block's rows before its
    queries: a task keeps one block, whose queries stream past it. With `parts`, blocks are dealt to so many tasks: they
    hold few bytes and much work, which adaptive execution would put together.
    """
    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("neighbour_row", T.LongType()), T.StructField("neighbour_id", kinds[1]), T.StructField("distance", T.DoubleType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, refs = None, [], None
        for batch in batches:
            at, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            turns = (np.flatnonzero((at[1:] != at[:-1]) | (asked[1:] != asked[:-1])) + 1).tolist()
            for a, z in zip([0, *turns], [*turns, len(at)]):
                if at[a] != block:
                    block, held, refs = at[a], [], None
                some = batch.slice(a, z - a)
                if not asked[a]:
                    held.append(some)
                    continue
                if held:
                    rows, ids, points = (pa.concat_arrays([b.column(c) for b in held]) for c in (2, 3, 5))
                    held, refs = [], (rows.to_numpy(), ids, _matrix(points), _places(ids) if exclude_self else None)
                if refs is not None:
                    rows, ids, points, places = refs
                    names = some.column(4)
                    for i, j, d in _nearest(_matrix(some.column(5)), points, rows, k, None if places is None else _own(names, places)):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), pa.array(rows[j]), ids.take(pa.array(j)), pa.array(d)], names=schema.names)

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    held = blocks.select("block", F.lit(0).alias("asked"), "row", "id", none(kinds[0], "query_id"), "features")
    asked = visits.select("block", F.lit(1).alias("asked"), none("long", "row"), none(kinds[1], "id"), "query_id", "features")
    both = held.unionByName(asked)
    dealt = both.repartition(parts, "block") if parts else both.repartition("block")
    return dealt.sortWithinPartitions("block", "asked").mapInArrow(search, schema)


class _Group:
    """The rows of some blocks, which stand block after block, and what queries with known limits find in them."""

    def __init__(self, plan: _Plan, block: np.ndarray, rows: np.ndarray, ids: pa.Array, points: np.ndarray, exclude_self: bool):
        self.plan, self.rows, self.ids, self.points = plan, rows, ids, points
        self.squares = (points * points).sum(axis=1)
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        self.blocks = list(zip(np.searchsorted(plan.block, block[edges]).tolist(), edges.tolist(), [*edges[1:].tolist(), len(block)]))
        self.places = _places(ids) if exclude_self else None

    def nearest(self, names: pa.Array, q: np.ndarray, limit: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """`(query, row, distance)` as places: the k rows within each query's limit; it narrows from block to block."""
        own = None if self.places is None else _own(names, self.places)
        for at in _steps(self.plan, len(q)):
            some, most = q[at], limit[at].copy()
            least = self.plan.least(some)
            i, j, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for place, a, z in self.blocks:
                go = np.flatnonzero(least[:, place] <= np.sqrt(most) * (1 + 1e-9))
                if not len(go):
                    continue
                same = None
                if own is not None:
                    mine = (own[1] >= a) & (own[1] < z) & (own[0] >= at.start) & (own[0] < at.stop)
                    query, row = own[0][mine] - at.start, own[1][mine] - a
                    kept = np.isin(query, go)
                    same = np.searchsorted(go, query[kept]), row[kept]
                found = list(_nearest(some[go], self.points[a:z], self.rows[a:z], k, same, HELD, most[go], self.squares[a:z]))
                i, j, d = _first(np.concatenate([i, *[go[f[0]] for f in found]]), np.concatenate([j, *[f[1] + a for f in found]]), np.concatenate([d, *[f[2] for f in found]]), self.rows, k)
                last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == k - 1)
                most[i[last]] = np.minimum(most[i[last]], d[last])
            yield i + at.start, j, d


def _within_limits(asked: DataFrame, blocked: DataFrame, plan: _Plan, k: int, exclude_self: bool, kinds: tuple, n_queries: int, n_rows: int, d: int) -> DataFrame:
    """`(query_id, neighbour_row, neighbour_id, distance)`: the rows within each query's limit, the k best of each group of blocks.

    Blocks stand in groups and queries in shares, and a task holds one group while one share streams past it. So a row is
    sent once a share, and a query once a group that can hold a row within its limit, whatever the number of blocks.
    """
    tasks = max(1, min(SPLITS, n_queries * n_rows // TASK_PAIRS))
    want = max(-(-n_rows * d // GROUP_NUMBERS), min(tasks, round(math.sqrt(tasks * n_rows / max(1, n_queries)))))
    groups = plan.grouped(-(-n_rows // want))
    shares = max(1, tasks // groups)
    schema = T.StructType([asked.schema["query_id"], asked.schema["features"], T.StructField("limit", T.DoubleType()), T.StructField("pair", T.IntegerType())])
    out = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("neighbour_row", T.LongType()), T.StructField("neighbour_id", kinds[1]), T.StructField("distance", T.DoubleType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _steps(plan, batch.num_rows):
                some = batch.slice(at.start, at.stop - at.start)
                points = _matrix(some.column(1))
                go = _within(plan.least(points), _limits(some.column(2)))
                i, group = np.nonzero(np.logical_or.reduceat(go, plan.starts, axis=1))
                most = max(1, HELD // max(1, points.shape[1]))
                for a in range(0, len(i), most):
                    one = pa.array(i[a : a + most])
                    share = some.column(3).take(one).to_numpy()
                    yield pa.RecordBatch.from_arrays([*[some.column(c).take(one) for c in range(3)], pa.array((group[a : a + most] * shares + share).astype(np.int32))], names=schema.names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, group = None, [], None
        for batch in batches:
            at, is_query = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            turns = (np.flatnonzero((at[1:] != at[:-1]) | (is_query[1:] != is_query[:-1])) + 1).tolist()
            for a, z in zip([0, *turns], [*turns, len(at)]):
                if at[a] != pair:
                    pair, held, group = at[a], [], None
                some = batch.slice(a, z - a)
                if not is_query[a]:
                    held.append(some)
                    continue
                if held:
                    block, rows, ids, points = (pa.concat_arrays([b.column(c) for b in held]) for c in (2, 3, 4, 7))
                    held, group = [], _Group(plan, block.to_numpy(), rows.to_numpy(), ids, _matrix(points), exclude_self)
                if group is not None:
                    names = some.column(5)
                    for i, j, distance in group.nearest(names, _matrix(some.column(7)), _limits(some.column(6)), k):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), pa.array(group.rows[j]), group.ids.take(pa.array(j)), pa.array(distance)], names=out.names)

    @F.arrow_udf("int")
    def group_of(block: pa.Array) -> pa.Array:
        return pa.array(plan.group[np.searchsorted(plan.block, block.to_numpy())].astype(np.int32))

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    held = blocked.select(group_of("block").alias("group"), "block", "row", "id", "features").select("*", everywhere)
    held = held.select((F.col("group") * shares + F.col("share")).cast("int").alias("pair"), F.lit(0).alias("asked"), "block", "row", "id", none(kinds[0], "query_id"), none("double", "limit"), "features")
    mine = asked.select("query_id", "features", "limit", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int").alias("share")).mapInArrow(deal, schema)
    mine = mine.select("pair", F.lit(1).alias("asked"), none("long", "block"), none("long", "row"), none(kinds[1], "id"), "query_id", "limit", "features")
    dealt = held.unionByName(mine).repartitionById(groups * shares, "pair")
    return dealt.sortWithinPartitions("pair", "asked", "block").mapInArrow(search, out)


def exact_with_visits(reference: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False, block_numbers: int = BLOCK_NUMBERS) -> tuple[DataFrame, DataFrame]:
    """`exact`, and one row `(n_queries, n_blocks, visits, share)`: how many of all pairs of a query and a block of rows met.

    Either result is computed without the other.
    """
    rows = durable(reference.select(F.col("row").cast("long").alias("row"), "id", "features"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    asked = durable(queries.select("query_id", "features").dropDuplicates(["query_id"]))
    kinds = queries.schema["query_id"].dataType, reference.schema["id"].dataType
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_row"))
    if not size.n:
        none = asked.select("query_id", F.lit(0).cast("long").alias("neighbour_row"), F.lit(None).cast(kinds[1]).alias("neighbour_id"), F.lit(0.0).alias("distance"), F.lit(1).alias("place")).limit(0)
        return none, asked.agg(F.count("*").alias("n_queries"), F.lit(0).cast("long").alias("n_blocks"), F.lit(0).cast("long").alias("visits"), F.lit(0.0).alias("share"))
    per_block = max(1, min(block_numbers // max(1, size.d or 1), BALANCE * math.isqrt(size.n)))
    blocked, plan = _planned(rows, size.n, size.d or 1, per_block)
    forget(rows)

    near = _met(_visits(asked, plan, k + 1), blocked, k, exclude_self, kinds, min(TASKS, len(plan.block)))
    limits = near.withColumn("place", rank).where(F.col("place") == k).select("query_id", F.col("distance").alias("limit"))
    known = durable(asked.join(limits.hint("merge"), "query_id", "left"))
    forget(asked)
    within = _within_limits(known, blocked, plan, k, exclude_self, kinds, known.count(), size.n, size.d or 1)
    found = within.withColumn("place", rank).where(F.col("place") <= k)
    visits = _counted(known, plan, k + 1).withColumn("n_blocks", F.lit(len(plan.block)).cast("long"))
    return found, visits.select("n_queries", "n_blocks", "visits", (F.col("visits") / (F.col("n_queries") * F.col("n_blocks"))).alias("share"))


def exact(reference: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """`(query_id, neighbour_row, neighbour_id, distance, place)`: the k nearest reference rows of each query.

    Reference rows stand at the nearest of a bounded number of pivots, in blocks by their distance from it. A query first
    visits the blocks that may be nearest, which bounds its k-th distance, then all that the triangle inequality and the
    planes between pivots don't rule out. For that, groups of blocks meet shares of the queries, so that what is sent does not
    grow with the number of blocks. A task keeps the k best of its group by matrix
    products and exact distances of what comes near; a window merges them. Distance is squared Euclidean, summed in column
    order; ties go to the lower row. `reference(row, id, features)`, `queries(query_id, features)`, features of one length
    and without nulls; repeated queries are one. With `exclude_self`, a reference row of the query's id is no neighbour.
    What reaches the driver: pivots, and sizes and distances by ring and by block.
    """
    return exact_with_visits(reference, queries, k, exclude_self, block_numbers)[0]


def listed(neighbours: DataFrame) -> DataFrame:
    """Each query's neighbours as one ordered array."""
    item = F.struct("distance", F.col("neighbour_row").alias("row"), F.col("neighbour_id").alias("id"))
    return neighbours.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("neighbours"))


def vote_share(neighbours: DataFrame, labels: DataFrame, k: int, threshold: float = 0.5) -> DataFrame:
    """`(query_id, vote_share, prediction)` from the first k neighbours; `labels(neighbour_row, label)`."""
    votes = neighbours.where(F.col("place") <= k).join(labels.hint("merge"), "neighbour_row").groupBy("query_id").agg(F.avg("label").alias("vote_share"))
    return votes.withColumn("prediction", (F.col("vote_share") >= threshold).cast("int"))


def vote_sweep(neighbours: DataFrame, labels: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """`(k, query_id, score)` for every k from one search at the greatest."""
    rows = neighbours.join(labels, "neighbour_row").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("place") <= F.col("k"))
    return rows.groupBy("k", "query_id").agg(F.avg("label").alias("score"))


def agreement(neighbours: DataFrame, codes: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Share of the first k neighbours of the query's own code; `codes(id, code)`, null codes left out."""
    known = codes.where(F.col("code").isNotNull())
    own = known.select(F.col("id").alias("query_id"), F.col("code").alias("own"))
    rows = neighbours.join(own, "query_id").join(known.withColumnRenamed("id", "neighbour_id"), "neighbour_id")
    many = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("place") <= F.col("k"))
    each = many.groupBy("k", "query_id").agg(F.avg((F.col("code") == F.col("own")).cast("double")).alias("share"))
    return each.groupBy("k").agg(F.avg("share").alias("agreement"), F.count("*").alias("queries"))


def random_neighbours(queries: DataFrame, reference: DataFrame, k: int, seed: int = 3) -> DataFrame:
    """k reference rows a query, drawn by digest: the random baseline of the agreement."""
    n = reference.agg(F.count("*").alias("n"))
    draw = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("place")).crossJoin(F.broadcast(n))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("place").cast("string"))
    row = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint") % F.col("n")
    return draw.select("query_id", "place", row.alias("row")).join(reference.select("row", F.col("id").alias("neighbour_id")), "row").drop("row")


def popular_neighbours(queries: DataFrame, popular: DataFrame, k: int) -> DataFrame:
    """The k most viewed products other than the query: of `popular(id, place)` the first k + 1 are used."""
    popular = popular.orderBy("place").limit(k + 1)
    rows = queries.select("query_id").crossJoin(F.broadcast(popular)).where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return rows.select("query_id", F.col("id").alias("neighbour_id"), rank.alias("place")).where(F.col("place") <= k)


def _offsets(margins: np.ndarray, probes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per point, changes of one or two of its bucket numbers in order of how little they cost: `(which, step)`, -1 for none.

    `margins` holds the distances to the lower and the upper edge of each bucket, in widths."""
    n, m = margins.shape[0], margins.shape[1] // 2
    single = margins**2
    pairs = [(i, j) for i in range(2 * m) for j in range(i + 1, 2 * m) if i % m != j % m]
    cost = np.concatenate([np.zeros((n, 1)), single, *([single[:, [i for i, _ in pairs]] + single[:, [j for _, j in pairs]]] if pairs else [])], axis=1)
    changes = np.array([(-1, -1), *((i, -1) for i in range(2 * m)), *pairs])
    best = np.argsort(cost, axis=1, kind="stable")[:, : probes + 1]
    return [(changes[best[:, t]] % m, np.where(changes[best[:, t]] < 0, 0, np.where(changes[best[:, t]] < m, -1, 1))) for t in range(best.shape[1])]


class Hashes:
    """Tables of `functions` random projections, cut into buckets of one width: points near each other often share one."""

    def __init__(self, size: int, width: float, tables: int, functions: int, seed: int):
        rng = np.random.default_rng(seed)
        self.lines, self.shift = rng.normal(size=(size, tables * functions)) / width, rng.random(tables * functions)
        self.weights = rng.integers(1, 1 << 62, size=(tables, functions + 1)) | 1
        self.tables, self.functions = tables, functions

    def keys(self, points: np.ndarray, probes: int = 0) -> np.ndarray:
        """A signed 64-bit key for each point, table and probe; the point's own bucket comes first."""
        at = points @ self.lines + self.shift
        out = []
        for t in range(self.tables):
            own = at[:, t * self.functions : (t + 1) * self.functions]
            low = np.floor(own).astype(np.int64)
            inside = own - low
            for which, step in _offsets(np.concatenate([inside, 1 - inside], axis=1), probes) if probes else [(None, None)]:
                moved = low.copy()
                for w, s in zip(which.T, step.T) if probes else ():
                    moved[np.arange(len(moved)), w] += s
                with np.errstate(over="ignore"):
                    out.append((moved * self.weights[t, :-1]).sum(axis=1) + self.weights[t, -1])
        return np.stack(out, axis=1)


def lsh(
    reference: DataFrame, queries: DataFrame, k: int, width: float, tables: int = 8, functions: int = 4, probes: int = 8, seed: int = 1, exclude_self: bool = False, block_numbers: int = BLOCK_NUMBERS
) -> tuple[DataFrame, DataFrame]:
    """Neighbours by hash tables, in the form of `exact`, and one row of counts `(n_queries, n_pairs, candidates, share, searched_whole)`.

    A query looks into its own bucket of each table and into the `probes` nearest others. A bucket is met in blocks of bounded
    size, each of which gives a query its k best only, so a bucket of many rows needs no cap. A query that finds fewer than
    k rows is answered by `exact`. `candidates` counts the distances that were computed, `share` their part of all pairs.
    """
    rows = durable(reference.select(F.col("row").cast("long").alias("row"), "id", "features"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    asked = durable(queries.select("query_id", "features"))
    kinds = queries.schema["query_id"].dataType, reference.schema["id"].dataType
    per_block = max(1, block_numbers // max(1, size.d or 1))
    hashes = Hashes(size.d or 1, width, tables, functions, seed)

    def keyed(points: DataFrame, probes: int) -> DataFrame:
        @F.arrow_udf("array<long>")
        def keys(features: pa.Array) -> pa.Array:
            found, step = [], max(1, HELD // (8 * tables * (1 + probes) + (2 * functions + 1) ** 2))
            for at in range(0, len(features), step):
                found.append(hashes.keys(_matrix(features.slice(at, step)), probes))
            found = np.concatenate(found) if found else np.zeros((0, 1), np.int64)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))

        return points.withColumn("key", F.explode(F.array_distinct(keys("features"))))

    placed = keyed(rows, 0)
    sizes = durable(placed.groupBy("key").agg(F.count("*").alias("n"), F.ceil(F.count("*") / per_block).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    blocks = placed.join(sizes, "key").select(F.xxhash64("key", part.cast("int")).alias("block"), "row", "id", "features")
    opened = durable(keyed(asked, probes).join(sizes, "key").select("query_id", "features", "n", "key", "parts"))
    visits = opened.select("query_id", "features", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("query_id", "features", F.xxhash64("key", "part").alias("block"))
    met = _met(visits, blocks, k, exclude_self, kinds).dropDuplicates(["query_id", "neighbour_row"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_row"))
    found = durable(met.withColumn("place", rank).where(F.col("place") <= k))
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = durable(asked.join(enough, "query_id", "left_anti"))
    whole = exact(rows, short, k, exclude_self, block_numbers)
    out = found.join(enough.select("query_id"), "query_id", "left_semi").unionByName(whole.select(*found.columns))
    n_queries = asked.agg(F.count("*").alias("n_queries"))
    counts = opened.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates")).crossJoin(F.broadcast(n_queries)).crossJoin(F.broadcast(short.agg(F.count("*").alias("searched_whole"))))
    counts = counts.withColumn("n_pairs", F.col("n_queries") * size.n).withColumn("share", F.col("candidates") / F.greatest(F.col("n_pairs"), F.lit(1)))
    return out, counts.select("n_queries", "n_pairs", "candidates", "share", "searched_whole")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true neighbours that a search found."""
    hit = truth.join(found.select("query_id", "neighbour_id").withColumn("hit", F.lit(1)), ["query_id", "neighbour_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("pairs"))
