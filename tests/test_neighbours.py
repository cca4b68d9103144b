"""Exact and hashed neighbour searches against a join of all pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.functions import tables
from tallyforge.operators import neighbours


def points(spark, rows):
    return spark.createDataFrame([(i, i, [float(x) for x in p]) for i, p in enumerate(rows)], "row long, id long, features array<double>")


def asked(rows):
    return rows.select(F.col("id").alias("query_id"), "features")


def all_pairs(reference, queries, k, exclude_self=False):
    """The same neighbours by a join of all pairs, for small tables."""
    pairs = queries.select("query_id", F.col("features").alias("q")).crossJoin(reference.select("row", F.col("id").alias("neighbour_id"), "features"))
    pairs = pairs.where("query_id <> neighbour_id") if exclude_self else pairs
    d = pairs.select("query_id", F.col("row").alias("neighbour_row"), "neighbour_id", S.squared_distance("q", "features").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_row"))
    return d.withColumn("place", rank).where(F.col("place") <= k)


def key(df):
    return sorted((r.query_id, r.neighbour_row, r.neighbour_id, r.place, r.distance) for r in df.collect())


def clustered(n, groups, size, spread, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, size)) * 10
    return middles[rng.integers(0, groups, n)] + rng.normal(size=(n, size)) * spread


@pytest.mark.parametrize("block_numbers", [1_000_000, 100, 12])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_exact_equals_all_pairs_with_ties(spark, block_numbers, exclude_self):
    rng = np.random.default_rng(2)
    ref = points(spark, rng.integers(0, 4, (200, 3)))
    ask = asked(ref.where("id % 5 = 0")) if exclude_self else asked(points(spark, rng.integers(-1, 6, (40, 3))))
    assert key(neighbours.exact(ref, ask, 7, exclude_self, block_numbers)) == key(all_pairs(ref, ask, 7, exclude_self))


def test_few_blocks_are_visited_in_clustered_data(spark):
    ref = points(spark, clustered(4000, 40, 8, 0.5, 3))
    ask = asked(ref.where("id % 100 = 0"))
    found, visits = neighbours.exact_with_visits(ref, ask, 10, True, block_numbers=8 * 40)
    assert key(found) == key(all_pairs(ref, ask, 10, True))
    seen = visits.first()
    assert seen.n_queries == 40 and seen.n_blocks >= 100 and seen.share < 0.25 and abs(seen.share - seen.visits / 40 / seen.n_blocks) < 1e-12


def test_one_point_many_times_and_more_wanted_than_there_are(spark):
    ref = points(spark, [[1.0, 2.0]] * 300 + [[1.0, 2.5], [9.0, 9.0]])
    ask = spark.createDataFrame([(-1, [1.0, 2.1]), (5, [1.0, 2.0])], "query_id long, features array<double>")
    assert key(neighbours.exact(ref, ask, 4, True, block_numbers=20)) == key(all_pairs(ref, ask, 4, True))
    assert neighbours.exact(ref, ask, 1000, block_numbers=20).count() == 604


def test_empty_sides_and_text_ids(spark):
    ref = points(spark, [[1.0], [2.0], [4.0]])
    assert neighbours.exact(ref.limit(0), asked(ref), 3).count() == 0 and neighbours.exact(ref, asked(ref).limit(0), 3).count() == 0
    named = ref.withColumn("id", F.concat(F.lit("p"), "id"))
    assert [(r.query_id, r.neighbour_id) for r in neighbours.exact(named, asked(named), 1, True).orderBy("query_id").collect()] == [("p0", "p1"), ("p1", "p0"), ("p2", "p1")]


def test_hash_search_prunes_and_finds(spark):
    ref = points(spark, clustered(4000, 60, 12, 0.4, 7))
    ask = asked(ref.where("id % 20 = 0"))
    found, counts = neighbours.lsh(ref, ask, 10, width=4.0, tables=8, functions=6, probes=6, exclude_self=True)
    truth = all_pairs(ref, ask, 10, True)
    seen = counts.first()
    assert seen.n_pairs == 200 * 4000 and 0 < seen.share < 0.05
    assert neighbours.recall(found, truth).first().recall >= 0.9
    assert found.where("query_id = neighbour_id").count() == 0 and found.groupBy("query_id").count().where("count <> 10").count() == 0


def test_hash_search_answers_lonely_queries_whole(spark):
    ref = points(spark, clustered(300, 5, 6, 0.3, 1))
    ask = spark.createDataFrame([(-1, [500.0] * 6)], "query_id long, features array<double>").union(asked(ref.limit(3)))
    found, counts = neighbours.lsh(ref, ask, 5, width=2.0, tables=4, functions=6, probes=2)
    assert counts.first().searched_whole >= 1
    assert key(found.where("query_id = -1")) == key(all_pairs(ref, ask.where("query_id = -1"), 5))


def test_a_bucket_of_many_copies_needs_no_cap(spark):
    ref = points(spark, [[0.5, 0.5]] * 500 + [[0.5, 0.6]] * 3)
    ask = spark.createDataFrame([(-1, [0.5, 0.59])], "query_id long, features array<double>")
    found, _ = neighbours.lsh(ref, ask, 4, width=3.0, tables=4, functions=2, probes=4, block_numbers=40)
    assert key(found) == key(all_pairs(ref, ask, 4))
    assert neighbours.lsh(ref.limit(0), ask, 4, width=1.0)[0].count() == 0


def test_probes_come_in_order_of_cost():
    margins = np.array([[0.1, 0.5, 0.9, 0.5]])
    order = [(tuple(w[0]), tuple(s[0])) for w, s in neighbours._offsets(margins, 3)]
    assert order[0][1] == (0, 0) and order[1][0][0] == 0 and order[1][1] == (-1, 0)
    hashes = neighbours.Hashes(2, 1.0, 3, 2, 1)
    keys = hashes.keys(np.array([[0.2, 0.4]]), 4)
    assert keys.shape == (1, 15) and len(set(keys[0].tolist())) == 15 and (hashes.keys(np.array([[0.2, 0.4]])) == keys[:, ::5]).all()


def test_memory_of_a_block_of_many_queries_and_many_rows_is_bounded(spark):
    rng = np.random.default_rng(4)
    q, r = rng.normal(size=(4000, 7)), rng.normal(size=(4000, 7))
    r[5:9] = q[3]
    rows, same = np.arange(4000)[::-1].copy(), np.arange(4000)
    tracemalloc.start()
    found = list(neighbours._nearest(q, r, rows, 5, (same, same)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20  # all distances at once are 128 MB
    i, j, d = (np.concatenate(x) for x in zip(*found))
    assert len(i) == 20_000 and (i != j).all() and j[i == 3][:4].tolist() == [8, 7, 6, 5] and (d[i == 3][:4] == 0).all()


def test_a_point_that_visits_many_blocks_is_dealt_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HELD", 40)
    ref = points(spark, np.random.default_rng(6).normal(size=(300, 4)))
    assert key(neighbours.exact(ref, asked(ref), 4, True, 24)) == key(all_pairs(ref, asked(ref), 4, True))


def test_a_search_of_few_numbers_is_shared_by_many_tasks_and_blocks(spark):
    ref = points(spark, clustered(20_000, 30, 3, 0.5, 9))
    found, visits = neighbours.exact_with_visits(ref, asked(ref.where("id % 50 = 0")), 3, True)
    seen = visits.first()
    assert seen.n_blocks >= 16 and seen.share < 0.5
    assert key(found) == key(all_pairs(ref, asked(ref.where("id % 50 = 0")), 3, True))


def test_memory_of_a_batch_of_rows_that_meet_many_pivots_is_bounded():
    rng = np.random.default_rng(5)
    rows, pivots = rng.normal(size=(10_000, 7)), rng.normal(size=(4096, 7))
    features = pa.array(list(rows), pa.list_(pa.float64()))
    tracemalloc.start()
    cell, reach = neighbours._placed(features, pivots)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 << 20  # four million distances, as before, are 32 MB, and several times that in between
    far = np.sqrt(((rows[-50:, None] - pivots[None]) ** 2).sum(axis=2))
    assert (cell[-50:] == far.argmin(axis=1)).all() and np.allclose(reach[-50:], far.min(axis=1))


def test_queries_of_a_block_stream_past_it(spark):
    ref = points(spark, np.random.default_rng(8).integers(0, 9, (300, 3)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = neighbours.exact(ref, asked(ref), 4, True, 60)
        assert "collect_list" not in found._jdf.queryExecution().toString()
        assert key(found) == key(all_pairs(ref, asked(ref), 4, True))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_what_a_search_writes_does_not_grow_with_the_number_of_blocks(spark, monkeypatch):
    sizes = []

    def durable(df):
        out = tables.durable(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "durable", durable)
    ref = points(spark, np.random.default_rng(10).normal(size=(1500, 8)))
    found = neighbours.exact(ref, asked(ref), 4, True, 8 * 20)
    assert found.count() == 6000 and max(sizes) <= 1500  # a row a query and block to visit was 90,000


@pytest.mark.parametrize("splits, numbers", [(12, 8_000_000), (6, 200), (1, 100)])
def test_groups_of_blocks_meet_shares_of_queries(spark, monkeypatch, splits, numbers):
    monkeypatch.setattr(neighbours, "TASK_PAIRS", 1000)
    monkeypatch.setattr(neighbours, "SPLITS", splits)
    monkeypatch.setattr(neighbours, "GROUP_NUMBERS", numbers)
    ref = points(spark, np.random.default_rng(11).integers(0, 5, (300, 3)))
    assert key(neighbours.exact(ref, asked(ref), 5, True, 30)) == key(all_pairs(ref, asked(ref), 5, True))
    few = asked(ref.where("id % 50 = 0")).withColumn("features", F.col("features").cast("array<float>"))
    assert key(neighbours.exact(ref.withColumn("features", F.col("features").cast("array<float>")), few, 5, False, 30)) == key(all_pairs(ref, few, 5))


def test_repeated_queries_are_one(spark):
    ref = points(spark, np.random.default_rng(12).normal(size=(60, 3)))
    ask = asked(ref.where("id < 9"))
    found, visits = neighbours.exact_with_visits(ref, ask.union(ask), 4, True, 12)
    assert key(found) == key(all_pairs(ref, ask, 4, True)) and visits.first().n_queries == 9
