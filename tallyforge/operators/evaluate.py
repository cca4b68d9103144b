"""Evaluating binary classifiers on tables of labels and scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.functions.numbering import running_sums
from tallyforge.functions.tables import durable

#: Rows whose weights for all replicates stand in memory at once.
DRAWN_ROWS = 256


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "prediction").agg(F.count("*").alias("n_rows"))


def metrics_of(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Rates of the four counts; a rate whose denominator is zero is zero."""
    precision, recall, specificity = _share(tp, tp + fp), _share(tp, tp + fn), _share(tn, tn + fp)
    return {
        "accuracy": _share(tp + tn, tp + fp + fn + tn),
        "precision": precision,
        "recall": recall,
        "f1": _share(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": (recall + specificity) / 2,
    }


def binary_metrics(predictions: DataFrame, *keys: str) -> DataFrame:
    """The four counts and their rates, per group of `keys` if given."""
    y, p = F.col("label") == 1, F.col("prediction") == 1
    counts = predictions.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    return counts.withColumns(metrics_of(*map(F.col, ("tp", "fp", "fn", "tn"))))


def _curve(each: DataFrame, *keys: str) -> DataFrame:
    """The curve over `each(keys, score, pos, neg)`, one row a score."""
    so_far = running_sums(each, keys, [F.desc("score")], {"pos": "tp", "neg": "fp"})
    total = [F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")]
    return so_far.join(each.groupBy(*keys).agg(*total), list(keys)) if keys else so_far.crossJoin(F.broadcast(each.agg(*total)))


def score_curve(scored: DataFrame, *keys: str) -> DataFrame:
    """True and false positives when everything of at least a score is predicted, a row a score.

    Rows are aggregated by score first, and the running sums go over ranges of scores, not over one task a key.
    """
    return _curve(scored.groupBy(*keys, "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")), *keys)


def _precision(steps: DataFrame, *keys: str) -> DataFrame:
    gain = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return steps.groupBy(*keys).agg(F.coalesce(_share(F.sum(gain), F.max("all_pos")), F.lit(0.0)).alias("average_precision"))


def average_precision(scored: DataFrame, *keys: str) -> DataFrame:
    """Step-wise average precision; equal scores count together; 0 without positives."""
    return _precision(score_curve(scored, *keys), *keys)


def best_threshold(scored: DataFrame, *keys: str) -> DataFrame:
    """The score at which predicting everything of at least it has the best F1; ties to the larger score."""
    steps = score_curve(scored, *keys)
    f1 = F.round(_share(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_pos")), 12)
    best = F.max(F.struct(f1.alias("f1"), F.col("score").alias("threshold")))
    return steps.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.threshold", "b.f1")


def at_thresholds(scored: DataFrame, cuts: DataFrame) -> DataFrame:
    """`(threshold, tp, fp, fn, tn, rates)` of predicting 1 from each `cuts(threshold)` on, all from one curve.

    A threshold's counts are those of the smallest score that reaches it, found by a union and a running maximum
    rather than by comparing every score with every threshold.
    """
    steps = score_curve(scored)
    total = steps.agg(F.coalesce(F.max("all_pos"), F.lit(0)).alias("p"), F.coalesce(F.max("all_neg"), F.lit(0)).alias("n"))
    each = scored.groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).withColumn("cut", F.lit(0))
    spots = cuts.select(F.col("threshold").alias("score"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"), F.lit(1).alias("cut")).distinct()
    found = running_sums(each.unionByName(spots), (), [F.desc("score"), F.asc("cut")], {"pos": "tp", "neg": "fp"}).where("cut = 1")
    counts = found.crossJoin(F.broadcast(total)).select(F.col("score").alias("threshold"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"))
    return counts.withColumns(metrics_of(*map(F.col, ("tp", "fp", "fn", "tn"))))


def choose_k(sweep: DataFrame) -> DataFrame:
    """The row of a sweep `(k, threshold, f1)` of the best F1; ties to the smaller k."""
    return sweep.orderBy(F.desc("f1"), "k").limit(1)


def majority(labelled: DataFrame) -> DataFrame:
    """Predict the label most rows have (1 only if more than half)."""
    most = labelled.agg((F.avg("label") > 0.5).cast("int").alias("prediction"))
    return labelled.crossJoin(F.broadcast(most))


def history_rule(labelled: DataFrame) -> DataFrame:
    """Predict 1 for what has been bought before."""
    return labelled.withColumn("prediction", (F.col("purchases") > 0).cast("int"))


def _tasks(rows: DataFrame) -> int:
    """How many tasks draw weights: rows are few bytes and much work, which adaptive execution would put together."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def weighted(rows: DataFrame, replicates: int, seed: int, used: Column | None = None) -> DataFrame:
    """Bootstrap replicates of rows with a key `i`: each row once a replicate `b`, with its Poisson(1) `weight`, which may be 0.

    The weight is drawn from a digest of seed, replicate and key, so any engine with SHA-256 draws the same. What follows
    is a sum by replicate, which Spark adds up before it shuffles; nothing is joined. Each digest is made once, and only
    for the rows that are `used`; others weigh 0. Nothing filters by weight, since a filter would make the digest again.
    """
    many = rows.repartition(_tasks(rows)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("i").cast("string")), 256)
    drawn = many.withColumn("_digest", digest if used is None else F.when(used, digest))
    return drawn.withColumn("weight", S.poisson_digest(F.col("_digest"))).drop("_digest")


def _counts_in_f1(*predictions: str) -> Column:
    """Rows that are a true positive or an error of some prediction; all others leave F1 as it is."""
    return reduce(lambda a, b: a | b, [F.col(c) == 1 for c in ("label", *predictions)])


def _weighted_f1(prediction: str) -> list[Column]:
    y, p = F.col("label") == 1, F.col(prediction) == 1
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0))
    return [total(y & p), total(~y & p), total(y & ~p)]


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _share(2 * tp, 2 * tp + fp + fn)


def bootstrap_f1(predictions: DataFrame, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """`(b, f1)`: the F1 of each replicate of `predictions(i, label, prediction)`."""
    return weighted(predictions, replicates, seed, _counts_in_f1("prediction")).groupBy("b").agg(_f1(*_weighted_f1("prediction")).alias("f1"))


def bootstrap_difference(predictions: DataFrame, other: str, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """`(b, difference)`: the F1 of `prediction` less that of the column `other`, on the same draws."""
    gap = _f1(*_weighted_f1("prediction")) - _f1(*_weighted_f1(other))
    return weighted(predictions, replicates, seed, _counts_in_f1("prediction", other)).groupBy("b").agg(gap.alias("difference"))


class _Totals:
    """What a part of the scores holds: weights of positives and of all rows for each replicate, and those positives that share its last score."""

    def __init__(self, part: int, replicates: int):
        self.part, self.first, self.last = part, None, None
        self.pos, self.neg, self.tail = (np.zeros(replicates) for _ in range(3))

    def add(self, score: float, pos: np.ndarray, neg: np.ndarray) -> None:
        self.first = score if self.first is None else self.first
        self.tail = self.tail + pos if self.last == score else pos
        self.last, self.pos, self.neg = score, self.pos + pos, self.neg + neg


def _weights(keys: list[str | None], replicates: int, seed: int) -> np.ndarray:
    """The weights that `weighted` draws, a row a key and a column a replicate."""
    heads = [f"{seed}:{b}".encode() for b in range(replicates)]
    tails = [b"" if k is None else b":" + k.encode() for k in keys]
    digests = b"".join([sha256(head + tail).digest() for tail in tails for head in heads])
    first = np.frombuffer(digests, dtype=">u8").reshape(-1, 4)[:, 0].astype(np.uint64) >> np.uint64(16)
    return np.searchsorted(np.array(S.POISSON_HEADS, dtype=np.uint64), first, side="right").reshape(len(keys), replicates).astype(float)


def _score_groups(batches: Iterator[pa.RecordBatch], replicates: int, seed: int) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
    """(part, score, weights of positives, of negatives) of rows in order; a score comes again where a batch ends within it."""
    for whole in batches:
        for at in range(0, whole.num_rows, DRAWN_ROWS):
            b = whole.slice(at, DRAWN_ROWS)
            part, score, label = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            weight = _weights(b.column(3).to_pylist(), replicates, seed)
            starts = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(score, prepend=np.nan) != 0))
            pos = np.add.reduceat(weight * label[:, None], starts, axis=0)
            every = np.add.reduceat(weight, starts, axis=0)
            for at_, p, w in zip(starts, pos, every):
                yield int(part[at_]), float(score[at_]), p, w - p


def bootstrap_average_precision(scored: DataFrame, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """`(b, average_precision)` of each replicate of `scored(i, label, score)`; a null score counts as the lowest.

    Rows are dealt once into ranges of scores and carry no copies: a row's weights for all replicates are an array made where
    it is used, of a few hundred rows at once. One pass adds up each range, the driver takes the sums of the ranges before each (three numbers a range
    and replicate), and a second pass goes down each range with all replicates at once. A score that several ranges
    share counts where it ends.
    """
    rows = scored.select("i", F.col("label").cast("double").alias("label"), F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("score"))
    parts = durable(rows.repartitionByRange(_tasks(rows), F.desc("score"), "i").withColumn("part", F.spark_partition_id()))
    ordered = parts.repartitionByRange(_tasks(rows), "part").sortWithinPartitions("part", F.desc("score"))
    ordered_rows = ordered.select("part", "score", "label", F.col("i").cast("string").alias("i"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[_Totals] = []
        for part, score, pos, neg in _score_groups(batches, replicates, seed):
            if not done or done[-1].part != part:
                done.append(_Totals(part, replicates))
            done[-1].add(score, pos, neg)
        for t in done:
            yield pa.RecordBatch.from_arrays([pa.array([t.part], pa.int32()), *(pa.array([x]) for x in (t.first, t.last)), *(pa.array([x], pa.list_(pa.float64())) for x in (t.pos, t.neg, t.tail))], names=["part", "first", "last", "pos", "neg", "tail"])

    totals = sorted(ordered_rows.mapInArrow(add_up, "part int, first double, last double, pos array<double>, neg array<double>, tail array<double>").collect(), key=lambda r: r.part)
    tp, fp, carry, before = np.zeros(replicates), np.zeros(replicates), np.zeros(replicates), {}
    for at, r in enumerate(totals):
        carry = carry if at and totals[at - 1].last == r.first else np.zeros(replicates)
        before[r.part] = tp, fp, carry, totals[at + 1].first if at + 1 < len(totals) else None
        carry = np.array(r.tail) + (carry if r.first == r.last else 0)
        tp, fp = tp + r.pos, fp + r.neg
    shared = scored.sparkSession.sparkContext.broadcast(before)

    def go_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, part, score, following = np.zeros(replicates), None, None, None
        tp = fp = own = np.zeros(replicates)

        def end_of_score() -> None:
            if part is not None and score != following:
                gain[:] += np.divide(own * tp, tp + fp, out=np.zeros(replicates), where=tp + fp > 0)

        for p, s, pos, neg in _score_groups(batches, replicates, seed):
            if p != part:
                end_of_score()
                part, score = p, s
                tp, fp, own, following = shared.value[p]
            elif s != score:
                end_of_score()
                score, own = s, np.zeros(replicates)
            tp, fp, own = tp + pos, fp + neg, own + pos
        end_of_score()
        yield pa.RecordBatch.from_arrays([pa.array([gain], pa.list_(pa.float64()))], names=["gain"])

    gains = ordered_rows.mapInArrow(go_down, "gain array<double>").select(F.posexplode("gain").alias("b", "gain")).groupBy("b").agg(F.sum("gain").alias("gain"))
    whole = scored.sparkSession.createDataFrame([(b, float(p), float(p + n)) for b, (p, n) in enumerate(zip(tp, fp))], "b int, all_pos double, rows double")
    found = gains.join(F.broadcast(whole), "b").where("rows > 0")
    return found.select("b", F.coalesce(_share(F.col("gain"), F.col("all_pos")), F.lit(0.0)).alias("average_precision"))


def bootstrap_mean(values: DataFrame, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """`(b, mean)`: the mean of each replicate of `values(i, value)`; null where no row is drawn."""
    return weighted(values, replicates, seed).groupBy("b").agg(F.try_divide(F.sum(F.col("weight") * F.col("value")), F.sum("weight")).alias("mean"))


def interval(replicates: DataFrame, column: str) -> DataFrame:
    """The 95 % percentile interval of a replicate column."""
    return replicates.agg(F.percentile(column, 0.025).alias("low"), F.percentile(column, 0.975).alias("high"))
