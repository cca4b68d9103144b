import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import langid
from tallyforge.llm.queries import op9_language_id

SCHEMA = "doc_id long, text string, lang string, lang_score string"


def test_presence_equals_a_plain_count():
    texts = ["Ab, ab 12!", "é", "x" * 9, "ÀÉ-ü ß", "𐐀𐐁 z"]
    for t in texts:
        plain = "".join(c if c.isalpha() else " " for c in t.lower())
        kept = "".join(c for k, c in enumerate(plain) if c != " " or (k and plain[k - 1] != " "))
        kept = f" {kept} "
        grams = {kept[i : i + n] for n in range(1, langid.ORDERS + 1) for i in range(len(kept) - n + 1)}
        assert 0.95 * len(grams) <= langid.presence(t).sum() <= len(grams)
    assert not langid.presence("12 !?").any() and not langid.presence("").any()


def test_long_text_and_repetition():
    assert langid.presence("ab " * 500_000).sum() < 20


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op9_language_id(spark, folder).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_inputs(spark):
    rows = [(1, "the cat sat on the mat", "en", "x"), (2, "der hund liegt auf dem sofa", "de", "x"), (3, None, "en", "x"), (4, "12 34", "de", "x"), (5, "", None, "x"), (None, "the dog sat", None, "x"), (1, "the cat sat on the mat", "en", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(df)
    assert model.languages == ["de", "en"]
    got = langid.predict(df.drop("lang_score"), model).collect()
    assert sorted(str(r.lang_pred) for r in got) == ["de", "en", "en", "en", "und", "und", "und"]
    nothing = langid.predict(df, langid.fit(df.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def foreign():
    rnd = random.Random(1)
    texts = [
        "η γρήγορη καφέ αλεπού πηδάει πάνω από τον τεμπέλη σκύλο", "быстрая коричневая лиса прыгает через ленивую собаку", "敏捷的棕色狐狸跳过懒狗然后跑进森林里去了",
        "الثعلب البني السريع يقفز فوق الكلب الكسول", "szybki brązowy lis przeskakuje nad leniwym psem i ucieka daleko do lasu", "a" * 500, " ".join(f"{rnd.getrandbits(128):032x}" for _ in range(40)),
    ]
    return texts + [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n)) for n in (20, 100, 1000)]


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_stage_rejects_unknown_languages_and_junk_only(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    kept = corpus_pipeline.keep_known_languages(spark, docs, "")
    lettered = docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert kept.count() >= 0.985 * lettered
    odd = spark.createDataFrame([(-1 - k, t, None, "odd", len(t)) for k, t in enumerate(foreign())], docs.schema)
    left = corpus_pipeline.keep_known_languages(spark, docs.unionByName(odd), "").where("doc_id < 0").collect()
    assert [r.text[:40] for r in left] == []


def test_scores_equal_a_plain_ridge_regression():
    """Kernel from sets of buckets pair by pair, and the normal equations of the landmarks, against the model."""
    rng = random.Random(3)
    vocabulary = {"en": ["the", "cat", "house", "river"], "de": ["der", "hund", "straße", "fluß"], "fr": ["le", "chien", "forêt"]}
    rows = [(lang, " ".join(rng.choice(w) for _ in range(rng.randrange(3, 12)))) for lang, w in vocabulary.items() for _ in range(rng.randrange(8, 20))]
    rng.shuffle(rows)
    languages, texts = [a for a, _ in rows], [b for _, b in rows]
    bits = np.stack([np.packbits(langid.presence(t)) for t in texts])
    model = langid.fit_ridge(languages, bits)

    sets = [set(np.flatnonzero(langid.presence(t)).tolist()) for t in texts]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    names = sorted(vocabulary)
    each = langid.LANDMARKS // len(names)
    marks = [i for n in names for i in [k for k, x in enumerate(languages) if x == n][:each]]
    weight = np.array([len(rows) / len(names) / languages.count(x) for x in languages])
    near, among = kernel[:, marks], kernel[np.ix_(marks, marks)]
    left = near.T @ np.diag(weight) @ near + langid.RIDGE * len(rows) * among + 1e-8 * len(rows) * np.eye(len(marks))
    target = np.array([[1.0 if x == n else -1.0 for n in names] for x in languages])
    outputs = near @ np.linalg.solve(left, near.T @ np.diag(weight) @ target)
    found, scores, leads = model.score(texts)
    assert found == [names[k] for k in outputs.argmax(axis=1)]
    ranked = np.sort((outputs + 1) / 2, axis=1)
    assert np.allclose(scores, np.clip(ranked[:, -1], 0, 1), atol=1e-3) and np.allclose(leads, ranked[:, -1] - ranked[:, -2], atol=1e-3)


def test_the_sample_is_the_smallest_hashes_of_each_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS_PER_LANGUAGE", 5)
    rows = [(k, f"word{chr(97 + k % 26)} text {chr(97 + k // 26)}x", "en" if k % 3 else "de", "c") for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    hashes = df.select("lang", "text", F.xxhash64(F.lit("sample"), "text").alias("h")).dropDuplicates(["h"]).collect()
    want = {lang: {r.text for r in sorted((x for x in hashes if x.lang == lang), key=lambda x: x.h)[:5]} for lang in ("de", "en")}
    seen = []
    monkeypatch.setattr(langid, "fit_ridge", lambda languages, bits: seen.append((languages, bits)))
    langid.fit(df)
    languages, bits = seen[0]
    for lang, texts in want.items():
        assert sorted(np.packbits(langid.presence(t)).tobytes() for t in texts) == sorted(b.tobytes() for x, b in zip(languages, bits) if x == lang)


def test_the_whole_fit_takes_every_row_and_equals_the_plain_one(spark, monkeypatch):
    """With a sample of a few rows a language: the landmarks are theirs, and the normal equations those of all distinct texts."""
    rng = random.Random(5)
    vocabulary = {"en": ["the", "cat", "house", "river", "wood"], "de": ["der", "hund", "straße", "fluß", "wald"]}
    rows = [(k, " ".join(rng.choice(vocabulary[x]) for _ in range(rng.randrange(4, 14))), x, "c") for k, x in enumerate(rng.choices(["en", "de"], [3, 1], k=400))]
    df = spark.createDataFrame(rows + rows[:50], SCHEMA).repartition(5)
    monkeypatch.setattr(langid, "ROWS_PER_LANGUAGE", 6)
    few, model = langid.fit(df), langid.fit_whole(df)
    assert model.languages == ["de", "en"] and (model.landmarks == few.landmarks).all() and model.landmarks.shape[1] == 12
    texts = sorted({(r[2], r[1]) for r in rows})
    near = np.concatenate([few.kernel([p], np.array([p.sum()])) for p in (langid.presence(t) for _, t in texts)]).astype(float)
    lang = np.array([x for x, _ in texts])
    weight = np.array([len(texts) / 2 / (lang == x).sum() for x in lang])
    target = np.array([[1.0 if x == n else -1.0 for n in ("de", "en")] for x in lang])
    among = few.landmarks.T.astype(float) @ few.landmarks
    want = np.linalg.solve(near.T @ (weight[:, None] * near) + langid.RIDGE * len(texts) * among + 1e-8 * len(texts) * np.eye(12), near.T @ (weight[:, None] * target))
    assert np.allclose(near @ model.weights, near @ want, atol=1e-3) and not np.allclose(near @ few.weights, near @ want, atol=1e-3)
    assert langid.fit_whole(df.limit(0)).languages == []


def test_limits_are_exact_quantiles_of_all_recognised_rows(spark):
    rng = np.random.default_rng(6)
    values = np.round(rng.random((30_000, 2)), 3)
    df = spark.createDataFrame([("en", "en" if k % 10 else "de", float(a), float(b)) for k, (a, b) in enumerate(values)], "lang string, lang_pred string, lang_score double, lang_lead double")
    right = values[np.arange(30_000) % 10 > 0]
    assert np.allclose(langid.limits(df), np.quantile(right, langid.REJECTED, axis=0), atol=1e-12)
    assert langid.limits(df.limit(0)) == (0.5, 0.0)
    one = df.where("lang = lang_pred").limit(1)
    assert langid.limits(one) == (one.first().lang_score, one.first().lang_lead)


def test_the_stage_fits_all_rows_and_sets_limits_by_all_others(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {}
    whole, limits = langid.fit_whole, langid.limits
    monkeypatch.setattr(langid, "fit_whole", lambda df: seen.update(fitted=df.count()) or whole(df))
    monkeypatch.setattr(langid, "limits", lambda df: seen.update(judged=df.count()) or limits(df))
    kept = corpus_pipeline.keep_known_languages(spark, docs, small)
    assert seen["fitted"] + seen["judged"] == docs.count() and kept.count() >= 0.97 * docs.where(F.col("text").rlike(r"\p{L}")).count()
