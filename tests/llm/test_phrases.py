import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import phrases
from tallyforge.llm.queries import OP12_SQL, op12_phrases

SCHEMA = "lang string, text string, rank int, phrase string"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def pieces(text):
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER))]


def brute(rows, least, top):
    count, total = Counter(), Counter()
    for lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            count.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    often = {x: n for x, n in count.items() if n >= least}
    hidden = set()
    for (lang, w), n in often.items():
        for k in range(2, len(w)):
            hidden.update((lang, w[i : i + k]) for i in range(len(w) - k + 1) if 100 * n >= 80 * often[lang, w[i : i + k]])
    by = {}
    for (lang, w), a in often.items():
        if len(w) > 1 and (lang, w) not in hidden:
            ends = [(often[lang, w[:k]], often[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(ends))
            by.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    out = []
    for lang, found in by.items():
        for rank, (score, a, words, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, words.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def result(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def odd_rows(seed=1):
    rnd = random.Random(seed)
    names = [f"w{i}" for i in range(25)] + ["Of", "THE", "Ünï", "é", "a b", "x\x01"]
    text = lambda: "".join(rnd.choice(names) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "!?"]) for _ in range(rnd.randint(0, 60)))
    rows = [(rnd.choice(["en", "de", None, "und", ""]), text()) for _ in range(400)]
    rows += [("en", "of the house of the house of the")] * 50 + [("en", None), (None, ""), ("xx", " . ,"), ("yy", "only these words here. only these words here. only these words here")] * 5
    rows += [("en", "of the long road " * 40_000)]
    return [(*r, 0, "x") for r in rows]


@pytest.mark.parametrize("budget,portion,cells", [(1_000_000, 16 << 20, 1 << 14), (500, 4000, 8), (50, 100_000, 4)])
def test_equals_brute_force(spark, monkeypatch, budget, portion, cells):
    """Whole groups, many groups, and cells cut by their following words; texts taken whole and in parts."""
    monkeypatch.setattr(phrases, "PORTION", portion)
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(4)
    assert result(phrases.collocations(df, 12, 150, budget)) == brute(odd_rows(), 12, 150)


def test_query_equals_its_statement(spark, small):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = sorted(tuple(r) for r in duckdb.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({OP12_SQL})").fetchall())
    assert want and result(op12_phrases(spark, small)) == want


def test_large_dictionaries_are_ranked_in_pairs():
    rng = np.random.default_rng(3)
    wide, narrow = rng.integers(0, 1 << 30, (4, 50)), rng.integers(1, 5, (4, 3000))
    columns = [np.where(narrow == 1, a[0], narrow + a[1])[i] for i, a in enumerate(wide)]
    got, n = phrases._leaves(columns)
    want = Counter(zip(*(c.tolist() for c in columns)))
    assert list(zip(*(c.tolist() for c in got))) == sorted(want) and dict(zip(zip(*(c.tolist() for c in got)), n.tolist())) == want
    again, m = phrases._leaves([np.concatenate([c, c]) for c in got], np.concatenate([n, n]))
    assert all((x == y).all() for x, y in zip(got, again)) and (m == 2 * n).all()


def test_groups_keep_to_the_budget():
    sizes = np.random.default_rng(5).integers(0, 40, 1000)
    sizes[7] = 1234
    first, parts, count = phrases.groups_of(sizes, 100)
    assert parts[7] == 13 and parts.sum() == 1012 and count == first[7] + 13
    assert np.bincount(first[sizes <= 100], weights=sizes[sizes <= 100]).max() <= 100


def test_scores_beyond_64_bits(spark):
    big = 10**17
    rows = [("en", "a", 1, 3 * big), ("en", "b", 1, big + 7), ("en", "a b", 2, big + 1)]
    out = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, k int, a long")).first()
    assert (out.l, out.r, out.score) == (3 * big, big + 7, 2_000_000 * (big + 1) // (4 * big + 7))


def test_the_set_of_frequent_words_leaves_out_rare_ones(spark):
    """Suffixes stop before a word below the limit, so that rare words aren't sent."""
    df = spark.createDataFrame([("en", f"often here rare{i}") for i in range(40)], "lang string, text string")
    counts, totals = phrases.phrase_counts(df, 30)
    assert {(r.phrase, r.a) for r in counts.collect()} == {("often", 40), ("here", 40), ("often here", 40)}
    assert totals.first().n == 120


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = phrases.collocations(df)
    assert out.count() == 0 and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.collocations(df.union(spark.createDataFrame([(None, None, 1, "x")], SCHEMA)).withColumn("n", F.lit(1))).count() == 0
