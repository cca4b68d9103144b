"""Quality, toxicity and neighbours."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import ann, quality, toxicity
from tallyforge.llm.queries import op4_toxicity
from tallyforge.llm.words import gram_hashes, word_hashes

DOCS = "doc_id long, text string, target string, label int, features string, p double"


def rows():
    good, bad = "the quick brown fox jumps over the lazy dog", "zz qq xx zz qq buy now"
    out = [(i, (good if i % 3 else bad) + f" {i}", "c", 1, "c", 0.0) for i in range(90)]
    return out + [(200, None, "c", 1, "c", 0.0), (201, "", "c", 1, "c", 0.0), (None, good, "c", 1, "c", 0.0), (1, out[1][1], "c", 1, "c", 0.0), (202, "word " * 100_000, "c", 1, "c", 0.0)]


def test_weights_equal_brute_force(spark):
    df = spark.createDataFrame(rows(), DOCS).repartition(3)
    targets = [i for i in range(90) if i % 3]
    got = quality.resample(df, spark.createDataFrame([(i,) for i in targets], "doc_id long"), 0.5).collect()
    assert len(got) == len(rows())
    raw, target = Counter(), Counter()

    def grams(t):
        w = word_hashes((t or "").encode())
        return [int(x) % quality.BUCKETS for x in [*w, *gram_hashes(w, 2)]]

    for i, t, *_ in rows():
        raw.update(grams(t))
        if i in targets:
            target.update(grams(t))
    n, m = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    weight = lambda t: sum(math.log((target[g] + 1) / m) - math.log((raw[g] + 1) / n) for g in grams(t))
    want = {i: weight(t) for i, t, *_ in rows()}
    assert all(math.isclose(r.log_weight, want[r.doc_id], rel_tol=1e-6, abs_tol=1e-6) for r in got)
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    k = math.ceil(len(got) / 2)
    assert {r.gumbel_key for r in got if r.selected} == {x for x in keys if x >= keys[k - 1]}
    assert quality.resample(df.limit(0), df.select("doc_id").limit(0)).count() == 0


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(1)
    values = [float(x) for x in np.round(rng.standard_cauchy(5000), 2)] + [7.0] * 3000
    df = spark.createDataFrame([(x,) for x in values], "v double")
    for k in (1, 2, 500, 3500, 5000, 8000):
        assert quality.kth_largest(df, "v", k, few=50, bins=32) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df.limit(0), "v", 1) is None


def test_gumbel_top_k_follows_the_weights(spark):
    drawn = spark.range(40_000).select(quality.gumbel(F.col("id")).alias("g")).agg(F.avg("g"), F.var_samp("g")).first()
    assert abs(drawn[0] - 0.5772) < 0.03 and abs(drawn[1] - math.pi**2 / 6) < 0.06


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op4_toxicity(spark, folder).collect()}
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    hit = sum(got[r.doc_id].predicted for r in labels if r.toxic)
    wrong = sum(got[r.doc_id].predicted for r in labels if not r.toxic)
    assert hit / sum(r.toxic for r in labels) > 0.8 and wrong / len(labels) < 0.02


def test_toxicity_odd_inputs(spark):
    df = spark.createDataFrame(rows(), DOCS)
    one = toxicity.fit(df, spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int"))
    assert one.trees is None and {r.toxicity for r in one.score(df).collect()} == {1.0}
    none = toxicity.fit(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score(df.limit(0)).count() == 0
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(0, 0)], "doc_id long, toxic int")
    scored = toxicity.fit(df, labels).score(df)
    assert scored.columns == [*df.columns, "toxicity"] and scored.count() == len(rows())
    assert toxicity.normal_words("You 1d10t! s.c.u.m 12") == ["you", "idiot", "scum"]


def plain_features(text, lexicon):
    """The features of FEATURES, each by its definition, word by word."""
    words, raw = toxicity.normal_words(text), text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    stem = lambda w: w[:5] + "*" if len(w) > 5 and w[:5] + "*" in lexicon else None
    bad = [w in toxicity.SEEDS or w in lexicon or stem(w) is not None for w in words]
    you = [k for k, w in enumerate(words) if w in toxicity.SECOND]
    odds = [lexicon[w] for w in set(words) if w in lexicon] + [lexicon[stem(w)] for w in set(words) if stem(w)]
    share = [words.count(w) for w in set(words)] or [0]
    return [
        math.log(len(words) + 1), sum(w in toxicity.SEEDS for w in words) / n, sum(w in toxicity.SEEDS for w in words), sum(w in lexicon for w in words) / n, sum(w in lexicon for w in words),
        sum(stem(w) is not None for w in words) / n, sum(stem(w) is not None for w in words), max(odds, default=0), sum(odds), len(you) / n, sum(b and any(abs(k - y) <= 6 for y in you) for k, b in enumerate(bad)),
        sum(c.isupper() for c in text) / chars, sum(len(w) > 1 and w.isupper() for w in raw) / n, text.count("!") / n, text.count("?") / n, sum(c in "#$%&*@^~|" for c in text) / n, sum(c.isdigit() for c in text) / chars,
        sum(any(w[k] in ".*-_@$!" and (w[k - 1].isalnum() or w[k - 1] == "_") and (w[k + 1].isalnum() or w[k + 1] == "_") for k in range(1, len(w) - 1)) for w in raw) / n, len(set(words)) / n, max(share) / n, chars / n,
    ]


def test_toxicity_equals_brute_force(spark):
    """Features by their definitions, the trees walked node by node, the calibration interpolated by hand."""
    rng = np.random.default_rng(9)
    mild, rude = "the nice garden tree you river walk song".split(), "you are an idiot moron s.t.u.p.i.d GRUMBLERS grumblemore !! loser".split()
    docs = [(k, " ".join(rng.choice(rude if k % 4 == 0 else mild, size=rng.integers(3, 30)).tolist() + [f"w{k}"])) for k in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = toxicity.fit(df, spark.createDataFrame([(k, int(k % 4 == 0 or k % 37 == 0)) for k in range(400)], "doc_id long, toxic int"))
    assert model.trees is not None and model.calibration is not None and model.lexicon

    def walk(node, x):
        if node.subtreeDepth() == 0:
            return node.prediction()
        return walk(node.leftChild() if x[node.split().featureIndex()] <= node.split().threshold() else node.rightChild(), x)

    roots, edges, levels = [t._call_java("rootNode") for t in model.trees.trees], list(model.calibration.boundaries), list(model.calibration.predictions)
    for r in model.score(df).collect():
        x = plain_features(r.text or "", model.lexicon)
        assert np.allclose(x, toxicity.features_of(r.text or "", model.lexicon))
        margin = sum(w * walk(root, x) for w, root in zip(model.trees.treeWeights, roots))
        want = np.interp(1 / (1 + math.exp(-2 * margin)), edges, levels)
        assert abs(r.toxicity - min(1, max(0, want))) < 1e-9


def test_toxicity_replaces_a_column_of_its_name_and_takes_every_text_of_an_id(spark):
    df = spark.createDataFrame([(k % 30, f"idiot moron {k}" if k % 3 == 0 else f"garden {k}", "mine") for k in range(90)], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(30)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert model.score(df).columns == ["doc_id", "text", "toxicity"] and model.score(df).schema["toxicity"].dataType.typeName() == "double"
    none = toxicity.fit(df, labels.limit(0))
    assert none.score(df).columns == ["doc_id", "text", "toxicity"]


def brute(vectors, query_ids, k):
    out = {}
    for q in query_ids:
        s = {i: float(np.dot(v, vectors[q]) / (np.linalg.norm(v) * np.linalg.norm(vectors[q]))) for i, v in vectors.items() if i != q}
        out[q] = sorted(s, key=lambda i: (-round(s[i], 12), i))[:k]
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = {i: v for i, v in enumerate(rng.normal(size=(1500, 24)).round(3).tolist())}
    for i in range(100, 160):
        vectors[i] = vectors[100]
    table = [(i, v, "c", 1.0) for i, v in vectors.items()]
    odd = [(3000, None, "c", 1.0), (3050, [0.0] * 24, "c", 1.0), (3100, [float("nan")] * 24, "c", 1.0), (3150, [1.0] * 23, "c", 1.0), (3200, [None] * 24, "c", 1.0), (None, vectors[3], "c", 1.0), (50, vectors[50], "c", 1.0)]
    vectors[3150] = [1.0] * 23 + [0.0]  # a shorter vector counts as one with zeros at its end
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<double>, node string, score double")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    want = brute(vectors, [i for i in vectors if i % 50 == 0], 5)
    assert set(got) == set(want)
    found = {q: [v[k] for k in sorted(v)] for q, v in got.items()}
    assert np.mean([len(set(found[q]) & set(want[q])) / 5 for q in want]) >= 0.97
    assert found[100] == [101, 102, 103, 104, 105] and found[150] == [100, 101, 102, 103, 104]


def test_neighbours_of_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0])], schema)
    assert ann.nearest(one, F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], schema)
    assert [(r.rank, r.vec_id) for r in ann.nearest(few, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]


@pytest.mark.parametrize("noise,size", [(2e-2, 1000), (1e-3, 1000), (1e-6, 1000)])
def test_recall_in_a_hot_cluster_of_near_copies(spark, noise, size):
    """Vectors around one direction, closer to each other than 8-bit codes can tell apart, beside others."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    near = centre + noise * np.linalg.norm(centre) / 8 * rng.normal(size=(size, 64))
    vectors = np.concatenate([near, rng.normal(size=(1000, 64))])
    got = {q: {i for i, _ in found} for q, found in answers(spark, vectors).items()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    recall = []
    for q in range(0, len(vectors), 50):
        apart = ((unit - unit[q]) ** 2).sum(axis=1)  # orders as the cosine does, with more digits left
        apart[q] = 9
        recall.append(len(got.get(q, set()) & set(np.argsort(apart)[:5].tolist())) / 5)
    print("recall", noise, np.mean(recall[: size // 50]), np.mean(recall[size // 50 :]))
    assert np.mean(recall[: size // 50]) >= 0.9 and np.mean(recall[size // 50 :]) >= 0.9


def test_a_group_within_a_group(spark):
    """Two hundred copies much nearer to each other than a thousand around them are, which is near already."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=32)
    outer = centre + 1e-3 * rng.normal(size=(1000, 32))
    inner = outer[0] + 1e-6 * rng.normal(size=(400, 32))
    vectors = np.concatenate([inner, outer, rng.normal(size=(400, 32))])
    got = {q: {i for i, _ in found} for q, found in answers(spark, vectors).items()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {q: set(np.argsort(np.where(np.arange(len(unit)) == q, 9, ((unit - unit[q]) ** 2).sum(axis=1)))[:5].tolist()) for q in range(0, len(unit), 50)}
    assert np.mean([len(got[q] & want[q]) / 5 for q in want if q < 400]) >= 0.9 and np.mean([len(got[q] & want[q]) / 5 for q in want]) >= 0.9


def answers(spark, vectors, kind="double"):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>").repartition(4)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_many_vectors_of_one_direction(spark):
    """Scaled copies tie but for the last digits of their cosines: they are answered from the smallest ids."""
    rng = np.random.default_rng(4)
    one, scale = rng.normal(size=64), rng.uniform(0.1, 1e3, size=2000)
    scale[:3] = 1e-150, 1e150, 2.0
    got = answers(spark, scale[:, None] * one)
    assert len(got) == 40
    for q, found in got.items():
        assert len(found) == 5 and {i for i, _ in found} <= set(range(6)) - {q} and all(abs(s - 1) < 1e-12 for _, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    for q, found in answers(spark, (scale[3:, None] * one).astype(np.float32), "float").items():
        assert len(found) == 5 and all(s > 1 - 1e-12 for _, s in found) and q not in dict(found)


def test_vectors_of_two_lengths(spark):
    rng = np.random.default_rng(6)
    short, long = rng.normal(size=(300, 8)), rng.normal(size=(700, 12))
    padded = np.concatenate([np.concatenate([short, np.zeros((300, 4))], axis=1), long])
    got = answers(spark, [*short, *long])
    want = brute(dict(enumerate(padded.tolist())), range(0, 1000, 50), 5)
    assert {q: [i for i, _ in found] for q, found in got.items()} == want


def test_a_search_goes_on_until_it_settles(spark):
    """A path whose every node knows only the next one: the nearest node is 29 steps away."""
    code = lambda *x: np.float32(1).tobytes() + np.rint(127 * np.array(x)).astype(np.int8).tobytes()
    turn = [code(np.cos(a), np.sin(a)) for a in np.linspace(3, 0.05, 30)]
    turn[0] = code(1, 0)
    graph = spark.createDataFrame([(i, [(i + 1, turn[i + 1])]) for i in range(29)], "node long, near array<struct<m:long,vec:binary>>")
    beam = ann.greedy_search(graph, spark.createDataFrame([(0, turn[0])], "node long, vec binary"))
    assert {r.node for r in beam.collect()} == set(range(1, 30))
