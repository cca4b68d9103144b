"""Roll-ups of distinct users, and the bootstrap of average precision over ranges of scores."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import evaluate, metrics


def test_days_rolled_up_equal_a_count_of_distinct_users(spark):
    rows = spark.range(6000).select(
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("event_date"), (F.col("id") % 24).cast("int").alias("event_hour"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("u"), (F.col("id") * 7919 % 700).cast("string"))).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("view", "cart", "purchase"))), (F.col("id") % 3 + 1).cast("int")).alias("event_type"), (F.col("id") % 100).alias("price_minor"),
    )
    sets = metrics.hourly_sets(rows)
    for keys in (("event_date",), ("event_date", "event_hour"), ("event_hour",), ()):
        want = rows.groupBy(*keys).agg(*metrics.counters(), F.count_distinct("user_id").alias("distinct_users"))
        assert sorted(map(tuple, metrics.rolled_up(sets, *keys).collect())) == sorted(map(tuple, want.collect()))
    assert metrics.trend_by_day(rows.limit(0)).count() == 0
    assert "Scan" in metrics.rolled_up(sets, "event_date")._jdf.queryExecution().executedPlan().toString()


def draw(seed, b, i):
    u = int.from_bytes(hashlib.sha256(f"{seed}:{b}:{i}".encode()).digest()[:6], "big") / 2**48
    total, k = 0.0, 0
    for j in range(12):
        total += math.exp(-1) / math.factorial(j)
        k += u >= total
    return k


def plain(rows, replicates, seed):
    out = {}
    for b in range(replicates):
        drawn = [(s if s is not None else -math.inf, y, draw(seed, b, i)) for i, y, s in rows]
        if not any(w for _, _, w in drawn):
            continue
        tp = fp = gain = 0
        for score in sorted({s for s, _, _ in drawn}, reverse=True):
            pos = sum(w for s, y, w in drawn if s == score and y)
            tp, fp = tp + pos, fp + sum(w for s, y, w in drawn if s == score and not y)
            gain += pos * tp / (tp + fp) if tp + fp else 0
        out[b] = gain / tp if tp else 0.0
    return out


@pytest.mark.parametrize("scores", [3, 40, 100_000])
def test_bootstrap_of_average_precision_equals_a_plain_walk(spark, scores):
    """Few scores span several ranges; many are nearly all different."""
    rows = [(i, int(i * 31 % 7 < 2), (i * 7919 % scores) / scores if i % 50 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, label int, score double").repartition(5)
    got = {r.b: r.average_precision for r in evaluate.bootstrap_average_precision(df, 12, 3).collect()}
    want = plain(rows, 12, 3)
    assert set(got) == set(want) and all(abs(got[b] - want[b]) < 1e-12 for b in want)


def test_bootstrap_of_one_score_few_rows_and_none(spark):
    one = [(i, i % 2, 0.5) for i in range(40)]
    df = spark.createDataFrame(one, "i long, label int, score double")
    assert {r.b: round(r.average_precision, 12) for r in evaluate.bootstrap_average_precision(df, 5, 1).collect()} == {b: round(x, 12) for b, x in plain(one, 5, 1).items()}
    assert {r.b: r.average_precision for r in evaluate.bootstrap_average_precision(df.limit(1), 6, 1).collect()} == plain([tuple(df.first())], 6, 1)
    assert evaluate.bootstrap_average_precision(df.where("label = 0"), 3, 1).agg(F.max("average_precision")).first()[0] == 0
    assert evaluate.bootstrap_average_precision(df.limit(0), 3, 1).count() == 0
