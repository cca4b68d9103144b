import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import sharding
from tallyforge.llm.queries import SHARDS, SHUFFLE_SEED, op11_sharding

SCHEMA = "doc_id long, text string, shard string, row int"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 1000, 65_537])
def test_permutation_and_inverse(n):
    for seed in (0, 1, -5, 1 << 70):
        p, rows = sharding.Permutation(n, seed), np.arange(n)
        places = p.place(rows)
        assert (np.sort(places) == rows).all() and (p.row(places) == rows).all()


def test_permutation_of_many_and_out_of_range():
    p, some = sharding.Permutation(10**12, 3), np.random.default_rng(1).integers(0, 10**12, 10_000)
    assert (p.row(p.place(some)) == some).all()
    with pytest.raises(ValueError):
        p.place(np.array([10**12]))
    assert abs(np.corrcoef(np.arange(50_000), sharding.Permutation(50_000, 1).place(np.arange(50_000)))[0, 1]) < 0.03
    assert (sharding.Permutation(50_000, 1).place(np.arange(50)) != sharding.Permutation(50_000, 2).place(np.arange(50))).any()


def brute(rows, shards, seed):
    """Shard and slot from a sort on one machine; equal rows may change places."""
    light = sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    place = sharding.Permutation(len(light), seed).place(np.arange(len(light)))
    return Counter((*r, int(p % shards), int(p // shards)) for r, p in zip(light, place))


def odd_rows():
    rows = [(i, f"text {i} ü" * (i % 7), "x", 1) for i in range(500)] + [(None, None, None, None), (None, "", "x", 1), (7, "", "x", 1), (9, "long " * 300_000, "x", 1)]
    return rows + [(3, "the same row", "x", 1)] * 400


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force_whatever_the_partitioning(spark, parts):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(parts)
    out = sharding.assign(sharding.shard_sizes(df), ("doc_id", "size", "text_crc32"), 24, 5)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out.collect()) == brute(odd_rows(), 24, 5)


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = op11_sharding(spark, small).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == brute(rows, SHARDS, SHUFFLE_SEED)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_even_shards_gapless_slots_and_equal_rows_spread(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    out = sharding.assign(df, ("doc_id", "text"), 24, 1)
    assert sorted(out.columns) == ["doc_id", "row", "shard", "slot", "text"]
    sizes = out.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("z"), F.countDistinct("slot").alias("d")).collect()
    assert len(sizes) == 24 and max(s.n for s in sizes) - min(s.n for s in sizes) <= 1 and all(s.a == 0 and s.z == s.n - 1 and s.d == s.n for s in sizes)
    assert len({r.shard for r in out.where("text = 'the same row'").collect()}) == 24


def test_place_without_data(spark):
    rows = spark.range(1000).withColumn("s", sharding.shard_and_slot(F.col("id"), 1000, 7, 3))
    back = rows.select("id", sharding.row_at(F.col("s.shard"), F.col("s.slot"), 1000, 7, 3).alias("again"))
    assert back.where("id <> again").count() == 0


def test_empty_table_more_shards_than_rows_and_bad_number(spark):
    df = spark.createDataFrame(odd_rows()[:3], SCHEMA)
    assert sharding.assign(df.limit(0), ("doc_id",), 24).count() == 0
    assert {r.slot for r in sharding.assign(df, ("doc_id",), 24).collect()} == {0}
    with pytest.raises(ValueError):
        sharding.assign(df, ("doc_id",), 0)


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame(odd_rows(), SCHEMA).drop("shard", "row")
    sharding.write_shards(df, str(tmp_path / "out"), ("doc_id", "text"), 5, 2, files=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(odd_rows()) and sorted(r.shard for r in back.select("shard").distinct().collect()) == list(range(5))
    for file in {r.f for r in back.select(F.input_file_name().alias("f")).distinct().collect()}:
        slots = [r.slot for r in spark.read.parquet(file).collect()]
        assert slots == sorted(slots)
