"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are densities of a seed lexicon and of lexicons learned from labelled texts (words and word beginnings),
how near second-person words stand, and rates of capitals, punctuation, obfuscation and repetition.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable, utf8

#: Bound of the labelled rows to learn from, which also bounds the learned lexicon.
LABEL_ROWS = 20_000
LEAST_DOCS, LEAST_ODDS, STEM, NEAR = 5, 2.0, 5, 6
#: A seed lexicon and second-person words of several languages.
SEEDS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown fool ugly hate kill shut imbecile crétin débile salaud connard idiota imbécil estúpido basura asqueroso dummkopf trottel abschaum wertlos ekelhaft".split())
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre du dich dir dein deine ihr euch sie usted ustedes tú ti tus vosotros".split())
_PLAIN = str.maketrans("013457@$!|", "oieastasil")
_WORD = re.compile(r"[\w@$!|*.\-]+")
_INNER = re.compile(r"(?<=\w)[.*\-_@$!|](?=\w)")
FEATURES = (
    "log_words", "seed_rate", "seed_count", "word_rate", "word_count", "stem_rate", "stem_count", "odds_max", "odds_sum", "second_rate", "second_near",
    "upper_rate", "shout_rate", "exclaim_rate", "question_rate", "symbol_rate", "digit_rate", "masked_rate", "distinct_rate", "top_share", "word_length",
)


def normal_words(text: str) -> list[str]:
    """Lower-case words with look-alike characters and separators inside words taken back to letters."""
    out = []
    for w in _WORD.findall(text.lower()):
        bare = w.strip("!|*.-")
        if not bare.isalpha():
            if bare.isdigit():
                continue
            bare = _INNER.sub("", bare.translate(_PLAIN)).strip("*.-")
        if bare:
            out.append(bare)
    return out


def features_of(text: str, lexicon: dict[str, float]) -> list[float]:
    """The numbers named in FEATURES; the lexicon maps words, and word beginnings followed by `*`, to log odds."""
    words = normal_words(text)
    n, chars = max(len(words), 1), max(len(text), 1)
    counts = Counter(words)
    seeds = sum(c for w, c in counts.items() if w in SEEDS)
    by_word = {w: lexicon[w] for w in counts if w in lexicon}
    by_stem = {w: lexicon[w[:STEM] + "*"] for w in counts if len(w) > STEM and w[:STEM] + "*" in lexicon}
    hits = SEEDS.intersection(counts) | by_word.keys() | by_stem.keys()
    near, second = 0, sum(c for w, c in counts.items() if w in SECOND)
    if hits and second:
        at = np.flatnonzero([w in SECOND for w in words])
        for i in np.flatnonzero([w in hits for w in words]):
            k = np.searchsorted(at, i)
            near += min((abs(int(at[j]) - int(i)) for j in (k - 1, k) if 0 <= j < len(at)), default=NEAR + 1) <= NEAR
    odds = [*by_word.values(), *by_stem.values()]
    stems, known = sum(counts[w] for w in by_stem), sum(counts[w] for w in by_word)
    raw = text.split()
    masked = sum(1 for w in raw if not w.isalpha() and _INNER.search(w))
    symbols = sum(map(text.count, "#$%&*@^~|"))
    return [
        math.log1p(len(words)), seeds / n, seeds, known / n, known, stems / n, stems, max(odds, default=0.0), sum(odds), second / n, near,
        sum(map(str.isupper, text)) / chars, sum(1 for w in raw if len(w) > 1 and w.isupper()) / n, text.count("!") / n, text.count("?") / n, symbols / n,
        sum(map(str.isdigit, text)) / chars, masked / n, len(counts) / n, max(counts.values(), default=0) / n, chars / n,
    ]


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Words and word beginnings (with `*`) that mark toxic texts of `labelled(text binary, label)`, with log odds.

    All that stand in LEAST_DOCS toxic texts and reach LEAST_ODDS; `labelled` is bounded, so this is too.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, label in zip(b.text, b.label):
                words = set(normal_words(text.decode("utf-8", "replace")))
                seen[int(label)].update(words | {w[:STEM] + "*" for w in words if len(w) > STEM})
            keys = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"word": keys, "clean": [seen[0][k] for k in keys], "toxic": [seen[1][k] for k in keys]})

    sizes = {int(r.label): r["count"] for r in labelled.groupBy("label").count().collect()}
    counts = labelled.select("text", "label").mapInPandas(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (sizes.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (sizes.get(0, 0) + 1))
    marked = counts.where(F.col("toxic") >= LEAST_DOCS).select("word", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS)
    return {r.word: r.odds for r in marked.collect()}


def featurise(docs: DataFrame, lexicon: dict[str, float], text_col: str = "text") -> DataFrame:
    """Add `features`, a vector of FEATURES over the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def rows(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[float(x) for x in features_of(t.decode("utf-8", "replace"), shared.value)] for t in batch])

    return docs.withColumn("features", array_to_vector(rows(utf8(F.col(text_col)))))


class ToxicityModel:
    """A lexicon, boosted trees and a calibration; `trees` is None where the labels had one class only."""

    def __init__(self, lexicon: dict[str, float], trees: GBTClassificationModel | None, calibration: IsotonicRegressionModel | None, rate: float):
        self.lexicon, self.trees, self.calibration, self.rate = lexicon, trees, calibration, rate

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Add `toxicity`, 0 to 1; null and empty texts are scored as texts without words.

        A column `toxicity` is replaced; repeated rows are scored row by row.
        """
        if self.trees is None:
            return docs.drop("toxicity").withColumn("toxicity", F.lit(float(self.rate)))
        columns = docs.columns
        names = {c: f"_tf_{k}" for k, c in enumerate(columns)}
        hidden = docs.select(*[F.col(c).alias(names[c]) for c in columns])
        raw = self.trees.transform(featurise(hidden, self.lexicon, names[text_col]))
        ready = raw.withColumn("p", vector_to_array("probability")[1])
        if self.calibration is not None:
            ready = self.calibration.transform(ready)
        else:
            ready = ready.withColumn("calibrated", F.col("p"))
        return ready.select(*[F.col(names[c]).alias(c) for c in columns if c != "toxicity"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))).alias("toxicity"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_rows: int = LABEL_ROWS) -> ToxicityModel:
    """Learn from at most `label_rows` labelled documents, those with the smallest hashes of their ids.

    A document that has several labels counts as toxic if one says so; null labels and ids and unlabelled
    documents are not used. Where an id has several texts, each is a row with its label; repeated rows count once.
    A quarter of the rows calibrates, the rest grows lexicon and trees.
    """
    label = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    few = label.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(label_rows)
    found = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text")).join(F.broadcast(few), "doc_id")
    rows = durable(found.dropDuplicates(["doc_id", "text"]).withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0))
    grow, hold = rows.where("not calibrates"), rows.where("calibrates")
    sizes = {int(r.label): r["count"] for r in grow.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return ToxicityModel({}, None, None, 1.0 if 1 in sizes else 0.0)
    lexicon = learn_lexicon(grow)
    ready = durable(featurise(rows, lexicon).select("calibrates", F.col("label").cast("double").alias("label"), "features"))
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, seed=1).fit(ready.where("not calibrates").coalesce(4))
    probed = trees.transform(ready.where("calibrates")).withColumn("p", vector_to_array("probability")[1])
    seen = {r.label for r in hold.groupBy("label").count().collect()}
    calibration = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(probed) if len(seen) == 2 else None
    return ToxicityModel(lexicon, trees, calibration, sizes[1] / sum(sizes.values()))
