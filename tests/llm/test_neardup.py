"""Near duplicates by shingles against brute-force Jaccard."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tallyforge.llm import neardup

SCHEMA = "doc_id long, text string, node long, key string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    """Smallest id reachable over pairs with a similarity of 0.8, by searching all pairs."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in sets}


def texts():
    rnd = random.Random(5)
    say = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    out = [None, "", " \n\t", "one", "ONE", "one two", "a b c d e", "A b c d e", "word " * 20_000]
    for n in (40, 90, 200, 400):
        for _ in range(6):
            base = say(n)
            for changes in range(1, 8):
                w = list(base)
                for _ in range(changes):
                    w[rnd.randrange(n)] = "other"
                out.append(" ".join(w))
            out += [" ".join(base), " ".join(base).upper()]
    hot, passage = say(150), say(120)
    out += [" ".join([*hot[:k], "x", *hot[k + 1 :]]) for k in range(0, 150)]
    out += [" ".join([*passage, *say(60)]) for _ in range(60)]
    chain = say(300)
    return out + [" ".join(chain[k : k + 200]) for k in range(0, 100, 10)]


def test_classes_equal_brute_force_jaccard(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], SCHEMA).repartition(5)
    want = brute(rows)
    assert len(set(want.values())) < len(rows) - 150
    assert {r.doc_id: r.component_id for r in neardup.near_duplicate_classes(df).collect()} == want
    kept = neardup.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_stage_equals_brute_force_jaccard(spark, name):
    folder = f"/root/testdata/{name}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "a b c d", 1, "r"), (1, "a b c d", 1, "r"), (2, "A b c d", 2, "s"), (None, "q w e r", 3, "t"), (None, "q w e r", 3, "t"), (5, None, 4, "u"), (6, "", 4, "u")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id or -1, r.node) for r in neardup.keep_one_of_each(df).collect()) == [(-1, 3), (1, 1), (5, 4)]
    assert len(neardup.near_duplicate_classes(df).collect()) == len(rows)
    assert neardup.keep_one_of_each(df.limit(0)).collect() == [] and neardup.near_duplicate_classes(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [60, 240])
def test_texts_of_a_template_cost_a_bounded_number_of_pairs(spark, monkeypatch, n):
    """Texts of one template that stay under the limit: few pairs a member become rows, and true copies among them are found."""
    rnd = random.Random(n)
    template = [f"t{i}" for i in range(150)]

    def variant(words, changes):
        words = list(words)
        for at in rnd.sample(range(len(words)), changes):
            words[at] = f"x{rnd.random()}"
        return words

    texts = [variant(template, 4) for _ in range(n)]
    texts += [variant(t, 1) for t in texts[:: n // 12]]
    counted = []
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, sets, least: (counted.append(pairs.count()), verified(pairs, sets, least))[1])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: find(i) for i in range(len(texts))}
    assert len(set(got.values())) > n // 2 and sum(counted) <= 100 * len(texts)


def test_intersections_and_spanning_links(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    one, two = ([np.unique(rng.integers(0, 60, rng.integers(0, 25))) for _ in range(k)] for k in (9, 13))
    got = neardup._intersections(*(pa.array([x.tolist() for x in side], pa.list_(pa.int64())) for side in (one, two)))
    assert (got == [[len(np.intersect1d(a, b)) for b in two] for a in one]).all()
    near = np.array([[1, 1, 0], [0, 1, 0], [0, 0, 1]], dtype=bool)
    i, j = neardup._spanning(near, np.array([5, 6, 7]), np.array([8, 9, 5]))
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2)]


def test_fingerprints_propose_links_and_bands_compare_only_the_rest(spark, monkeypatch):
    """Long texts with one or two other words differ in a few bits: signatures link them, and no later step compares them."""
    rnd = random.Random(8)
    texts = []
    for _ in range(6):
        base = [f"w{rnd.randrange(5000)}" for _ in range(2500)]
        texts += [" ".join([*base[:at], *["other"] * n, *base[at + n :]]) for n, at in ((0, 0), (1, 40), (1, 900), (2, 1700))]
    rounds, verified = [], neardup._verified

    def seen(pairs, sets, least):
        out = verified(pairs, sets, least)
        rounds.append(([tuple(r) for r in pairs.collect()], [tuple(r) for r in out.collect()]))
        return out

    monkeypatch.setattr(neardup, "_verified", seen)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicate_classes(df).collect()} == brute(rows)
    (proposed, linked), later = rounds[0], [pair for pairs, _ in rounds[1:] for pair in pairs]
    fps = {r.node: r.fp for r in neardup._marked(df, "doc_id", "text", 5).dropDuplicates(["key"]).selectExpr("doc_id as node", "fp").collect()}
    near = sum(min(int(np.bitwise_count(np.uint64((fps[i] ^ fps[j]) & (2**64 - 1)))) for j in range(i - i % 4, i - i % 4 + 4) if j != i) <= 3 for i in range(len(texts)))
    assert near > len(texts) // 2 and len(linked) >= near // 2 and len(proposed) < 4 * len(texts)
    assert not set(linked) & {p for a, b in later for p in ((a, b), (b, a))}
