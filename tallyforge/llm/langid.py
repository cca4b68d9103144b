"""Language identification with string kernels.

A text is the set of its character n-grams of one to four letters, hashed to buckets (a blended-spectrum presence
kernel, normalised by set sizes). Landmarks of the training sample give a Nyström approximation, kernel ridge
regression fits one scorer a language against the rest, and Python workers score batches by matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbering import running_sums

from .shared import durable, utf8

BUCKET_BITS, ORDERS = 15, 4
BUCKETS = 1 << BUCKET_BITS
#: Bounds of the training sample: rows in all, rows a language, landmarks in all.
SAMPLE_ROWS, ROWS_PER_LANGUAGE, LANDMARKS = 4096, 768, 192
#: Parts into which a language's hashes are dealt before they are ranked, so that no task ranks more than DEALT * ROWS_PER_LANGUAGE.
DEALT = 64
RIDGE = 1e-4
#: Share of correctly recognised rows that a learned limit may reject.
REJECTED = 0.002
UNDETERMINED = "und"
_SPREAD = np.uint32(2654435761)
_letters: list[np.ndarray] = []


def _letter_codes(text: str) -> np.ndarray:
    """Lower-case code points of the text, with every run of other characters as one space."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    letter = _letters[0][np.minimum(codes, 0xFFFF)]
    for c in np.unique(codes[codes > 0xFFFF]):
        letter[codes == c] = chr(c).isalpha()
    if not letter.any():
        return np.empty(0, dtype=np.uint32)
    codes[~letter] = 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)


def presence(text: str) -> np.ndarray:
    """Which n-gram buckets occur in the whole text; all False if it has no letter."""
    out = np.zeros(BUCKETS, dtype=bool)
    codes = _letter_codes(text)
    if not len(codes):
        return out
    with np.errstate(over="ignore"):
        gram = np.zeros(len(codes), dtype=np.uint32)
        for order in range(1, ORDERS + 1):
            if len(codes) < order:
                break
            gram = gram[: len(codes) - order + 1] * np.uint32(0x01000193) + codes[order - 1 :] + np.uint32(order)
            out[((gram ^ (gram >> np.uint32(15))) * _SPREAD) >> np.uint32(32 - BUCKET_BITS)] = True
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    buckets: np.ndarray  # those that occur in a landmark
    landmarks: np.ndarray  # buckets x landmarks, divided by the root of the landmark's size
    weights: np.ndarray  # landmarks x languages

    def kernel(self, rows: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """Kernel values of presence rows of so many buckets with the landmarks."""
        stack = np.stack([r[self.buckets] for r in rows]).astype(np.float32)
        return (stack @ self.landmarks) / np.sqrt(np.maximum(sizes, 1))[:, None]

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Best language of each text, its output moved to 0..1, and its lead; texts without letters are undetermined.

        The lead is the distance from the second scorer's output on the same scale, from 0 if there is no second.
        """
        rows = [presence(t) for t in texts]
        sizes = np.array([r.sum() for r in rows], dtype=np.float32)
        if not self.languages:
            return [UNDETERMINED] * len(rows), np.zeros(len(rows)), np.zeros(len(rows))
        outputs = self.kernel(rows, sizes) @ self.weights
        best = outputs.argmax(axis=1)
        score = np.clip((outputs[np.arange(len(best)), best] + 1) / 2, 0, 1)
        names = [self.languages[b] if n else UNDETERMINED for b, n in zip(best, sizes)]
        ranked = np.sort((np.concatenate([outputs, np.full((len(best), 1), -1, np.float32)], axis=1)[:, : max(2, outputs.shape[1])] + 1) / 2, axis=1)
        return names, np.where(sizes > 0, score, 0.0), np.where(sizes > 0, ranked[:, -1] - ranked[:, -2], 0.0)


def _unpacked(bits: np.ndarray, buckets: np.ndarray | slice = slice(None)) -> np.ndarray:
    return np.unpackbits(bits, axis=1)[:, buckets].astype(np.float32)


def fit_ridge(languages: list[str], bits: np.ndarray) -> LanguageModel:
    """Nyström kernel ridge regression, one against the rest, from the sample's presence rows as packed bits.

    Rows are unpacked a few hundred at a time, so the driver holds the bits and the kernel matrix only.
    """
    names = sorted(set(languages))
    if not names:
        return LanguageModel([], np.empty(0, int), np.empty((0, 0), np.float32), np.empty((0, 0), np.float32))
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    each = max(1, LANDMARKS // len(names))
    chosen = np.concatenate([np.flatnonzero(y[:, k] > 0)[:each] for k in range(len(names))])
    sizes = np.sqrt(np.maximum(np.bitwise_count(bits).sum(axis=1), 1)).astype(np.float32)
    buckets = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[chosen], axis=0)))
    landmarks = np.ascontiguousarray((_unpacked(bits[chosen], buckets) / sizes[chosen, None]).T)
    k_nm = np.concatenate([_unpacked(bits[at : at + 256], buckets) @ landmarks / sizes[at : at + 256, None] for at in range(0, len(bits), 256)]).astype(np.float64)
    k_mm = k_nm[chosen]
    balance = 1.0 / np.maximum((y > 0).sum(axis=0), 1)
    per_row = balance[np.array([names.index(x) for x in languages])] * len(bits) / len(names)
    left = k_nm.T @ (per_row[:, None] * k_nm) + RIDGE * len(bits) * k_mm + 1e-8 * len(bits) * np.eye(len(chosen))
    weights = np.linalg.solve(left, k_nm.T @ (per_row[:, None] * y))
    return LanguageModel(names, buckets, landmarks, weights.astype(np.float32))


def _smallest(hashes: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """The n rows `(lang, h)` of smallest h of each group of `keys`."""
    return hashes.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("n") <= n).select("lang", "h")


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on a bounded sample of `training`: of each language the rows with the smallest hashes of their texts.

    The sample has `sample_rows` rows at most (ROWS_PER_LANGUAGE a language), each sent to the driver as a bit
    row of 4 KB; of more languages than that, those of the most texts are learned. Rows with a null or letterless text or a null language are not used; repeated texts count once.
    """
    rows = training.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("sample"), text_col).alias("h"))
    hashes = durable(rows.select("lang", "h").distinct())
    known = hashes.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows).select("lang").collect()
    if not known:
        return fit_ridge([], np.empty((0, BUCKETS // 8), np.uint8))
    each = min(ROWS_PER_LANGUAGE, sample_rows // len(known))
    mine = hashes.where(F.col("lang").isin([r.lang for r in known]))
    few = _smallest(_smallest(mine, each, "lang", F.pmod("h", F.lit(DEALT))), each, "lang")
    last = few.groupBy("lang").agg(F.max("h").alias("h")).orderBy("lang").collect()
    cuts = F.create_map(*[F.lit(x) for r in last for x in (r.lang, r.h)])

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": b.lang, "h": b.h, "bits": [np.packbits(presence(t.decode("utf-8", "replace"))).tobytes() for t in b.text]})

    chosen = rows.where(F.col("h") <= F.try_element_at(cuts, F.col("lang"))).select("lang", "h", utf8(F.col("text")).alias("text"))
    sample = chosen.mapInPandas(featurise, "lang string, h long, bits binary").dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect()
    return fit_ridge([r.lang for r in sample], np.stack([np.frombuffer(r.bits, dtype=np.uint8) for r in sample]))


def fit_whole(training: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on all rows of `training` in the languages that `fit` learns: its bounded sample gives the landmarks only.

    The normal equations are sums over the rows. Tasks add up their own, and what reaches the driver is one sum for each
    pair of landmarks and for each landmark and language. Repeated texts of a language count once, as in `fit`.
    """
    model = fit(training, text_col, lang_col, sample_rows)
    if not model.languages:
        return model
    names, marks = model.languages, model.landmarks.shape[1]
    shared = training.sparkSession.sparkContext.broadcast(model)

    def kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 128):
                some = b.iloc[at : at + 128]
                rows = [presence(t.decode("utf-8", "replace")) for t in some.text]
                found = shared.value.kernel(rows, np.array([r.sum() for r in rows], dtype=np.float32))
                yield pd.DataFrame({"lang": some.lang, "h": some.h, "kernel": [k.astype(np.float32).tobytes() for k in found]})

    known = training.where(F.col(lang_col).isin(names) & F.col(text_col).rlike(r"\p{L}"))
    texts = known.select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit("sample"), text_col).alias("h"), utf8(F.col(text_col)).alias("text"))
    each = durable(texts.mapInPandas(kernels, "lang string, h long, kernel binary").dropDuplicates(["lang", "h"]))
    counts = {r.lang: r.n for r in each.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = np.array([total / len(names) / counts[x] for x in names])
    place = {x: k for k, x in enumerate(names)}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros((marks, marks + len(names)))
        for b in batches:
            k = np.frombuffer(b"".join(b.kernel), dtype=np.float32).reshape(-1, marks).astype(np.float64)
            lang = np.array([place[x] for x in b.lang], dtype=np.int64)
            target = np.where(lang[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
            own += (k * weight[lang][:, None]).T @ np.concatenate([k, target], axis=1)
        yield pd.DataFrame({"mark": np.arange(marks, dtype=np.int32), "sums": list(own)})

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"mark": parts.mark.iloc[:1], "sums": [np.sum(np.stack(parts.sums), axis=0)]})

    schema = "mark int, sums array<double>"
    rows = each.mapInPandas(sums, schema).groupBy("mark").applyInPandas(added, schema).collect()
    whole = np.array([r.sums for r in sorted(rows, key=lambda r: r.mark)])
    among = model.landmarks.T.astype(np.float64) @ model.landmarks.astype(np.float64)
    left = whole[:, :marks] + RIDGE * total * among + 1e-8 * total * np.eye(marks)
    return replace(model, weights=np.linalg.solve(left, whole[:, marks:]).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add `lang_pred`, `lang_score` (0 to 1) and `lang_lead` from the whole text; other columns stay.

    Null, empty and letterless texts, and all texts under a model without languages, get `und` and zeros. Columns of
    these names are replaced; repeated rows are scored row by row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, lead double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, values, leads = [], [], []
            for at in range(0, len(texts), 128):
                n, v, d = shared.value.score([t.decode("utf-8", "replace") for t in texts.iloc[at : at + 128]])
                names += n
                values.extend(v.tolist())
                leads.extend(d.tolist())
            yield pd.DataFrame({"lang": names, "score": values, "lead": leads})

    scored = docs.withColumn("_tf_s", scores(utf8(F.col(text_col))))
    return scored.withColumns({"lang_pred": F.col("_tf_s.lang"), "lang_score": F.col("_tf_s.score"), "lang_lead": F.col("_tf_s.lead")}).drop("_tf_s")


def _quantile(rows: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile of a column, between two values in proportion, from counts of equal values: no task holds all rows. None without rows."""
    ranked = durable(running_sums(rows.groupBy(column).agg(F.count("*").alias("n")), (), [column], {"n": "upto"}))
    last = ranked.agg(F.max("upto")).first()[0]
    if not last:
        return None
    at = share * (last - 1)
    low, high = (ranked.where(F.col("upto") > place).agg(F.min(column)).first()[0] for place in (math.floor(at), math.ceil(at)))
    return low + (high - low) * (at - math.floor(at))


def limits(scored: DataFrame, lang_col: str = "lang") -> tuple[float, float]:
    """The least score and lead of a text in a known language, learned from labelled rows outside the fit, with the columns of `predict`.

    Each limit leaves out REJECTED of all rows whose language is recognised; with few rows it is near the smallest value
    among them. Without any, the limits are those of an undecided model.
    """
    right = durable(scored.where(F.col(lang_col) == F.col("lang_pred")).select("lang_score", "lang_lead"))
    score, lead = (_quantile(right, c, REJECTED) for c in ("lang_score", "lang_lead"))
    return (score, lead) if score is not None else (0.5, 0.0)


def accepted(score: float, lead: float) -> Column:
    """A document stays if it has a language whose scorer reaches `score` and leads the second one by `lead`."""
    return (F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= score) & (F.col("lang_lead") >= lead)
