import random

import numpy as np
import pytest

from tallyforge.llm import decontaminate as D
from tallyforge.llm.words import gram_hashes, word_hashes

DOCS, ITEMS = "doc_id long, text string, item_id string, edits string", "item_id long, text string, doc_id string"


def plain_words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def plain_infix(item, words):
    row = [0] * (len(words) + 1)
    for k, w in enumerate(item):
        new = [k + 1]
        for j, x in enumerate(words):
            new.append(min(row[j + 1] + 1, row[j] + (x != w), new[j] + 1))
        row = new
    return min(row)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        p, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[p] = f"new{rng.randrange(99)}"
        elif kind == 1:
            out.insert(p, f"more{rng.randrange(99)}")
        elif len(out) > 1:
            out.pop(p)
    return out


def world():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6, 60)))) for i in range(30)] + [(90, "one two three"), (91, None), (92, " ,. "), (93, "")]
    docs = []
    for n in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))]
        if n % 2:
            i, text = items[rng.randrange(31)]
            own = text.split()
            allowed = D.edits_allowed(len(own))
            words[len(words) // 2 : len(words) // 2] = edited(rng, own, rng.choice([0, 0, 1, allowed, allowed + 3]))
        docs.append((n, " ".join(w.upper() + "," if rng.random() < 0.1 else w for w in words)))
    docs += [(900, None), (901, ""), (902, "w1 " * 60_000), (None, items[0][1]), (5, docs[5][1])]
    return docs, items


def test_words_and_infix_distance():
    assert len(word_hashes(b"Ab,c  d", marks=True)) == 3 and len(word_hashes(b" \t")) == 0
    assert word_hashes("ÀB x".encode())[1] == word_hashes(b"x")[0]
    long = b"abc " * 800_000
    assert len(word_hashes(long)) == 800_000 and len(set(word_hashes(long).tolist())) == 1
    assert len(gram_hashes(word_hashes(b"a b"), 3)) == 0
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(1, 9))], [rng.randrange(5) for _ in range(rng.randrange(12))]
        assert D.infix_distance(np.array(a), np.array(b)) == plain_infix(a, b)


def test_finds_what_brute_force_finds(spark):
    docs, items = world()
    df = spark.createDataFrame([(*d, "c", "c") for d in docs], DOCS).repartition(4)
    bench = spark.createDataFrame([(*i, "c") for i in items], ITEMS)
    got = {(r.doc_id, r.item_id): r.edits for r in D.find_leaks(df, bench).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            words = plain_words(item or "")
            if words and text and len(text) < 100_000:
                edits = plain_infix(words, plain_words(text))
                if edits <= D.edits_allowed(len(words)):
                    want[d, i] = edits
    assert len(want) > 60
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.98 * len(want)
    assert all(k in got for k, e in want.items() if e == 0)
    kept = D.drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in {k[0] for k in got})


def test_an_index_too_large_to_broadcast_is_joined(spark, monkeypatch):
    docs, items = world()
    df, bench = spark.createDataFrame([(*d, "c", "c") for d in docs], DOCS), spark.createDataFrame([(*i, "c") for i in items], ITEMS)
    key = lambda rows: sorted((str(r.doc_id), r.item_id, r.edits) for r in rows)
    whole, kept = key(D.find_leaks(df, bench).collect()), sorted(str(r.doc_id) for r in D.drop_leaks(df, bench).collect())
    monkeypatch.setattr(D, "BROADCAST_KEYS", 0)
    assert key(D.find_leaks(df, bench).collect()) == whole
    assert sorted(str(r.doc_id) for r in D.drop_leaks(df, bench).collect()) == kept


def test_empty_tables(spark):
    docs, items = world()
    df, bench = spark.createDataFrame([(*d, "c", "c") for d in docs], DOCS), spark.createDataFrame([(*i, "c") for i in items], ITEMS)
    assert D.find_leaks(df.limit(0), bench).count() == 0 and D.find_leaks(df, bench.limit(0)).count() == 0
    assert D.drop_leaks(df, bench.limit(0)).count() == len(docs) and D.drop_leaks(df.limit(0), bench).count() == 0


def test_large_ids_beside_null_ones(spark):
    big, text = 2**53 + 1, "one two three four five six seven"
    df = spark.createDataFrame([(big, text), (None, text), (big + 2, "other")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(big + 4, text), (None, "other")], "item_id long, text string").coalesce(1)
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(df, bench).collect()}
    assert got == {(big, big + 4), (None, big + 4), (big + 2, None)}
    assert D.drop_leaks(df, bench).count() == 0


@pytest.mark.parametrize("words", [5, 6, 8, 10, 14, 20, 31, 45, 59, 95, 200])
def test_recall_at_the_most_edits(words):
    """The share of items found by collisions alone that carry every edit allowed, and of unedited ones."""
    rng, found, whole, n = random.Random(words), 0, 0, 200
    for _ in range(n):
        item = [f"w{rng.randrange(400)}" for _ in range(words)]
        around = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(40, 60))] for _ in range(2)]
        index = D.ItemIndex([word_hashes(" ".join(item).encode(), marks=True)])
        texts = [" ".join(around[0] + part + around[1]).encode() for part in (edited(rng, item, D.edits_allowed(words)), item)]
        hits = {k for k, _, _ in index.leaks(texts)}
        found, whole = found + (0 in hits), whole + (1 in hits)
    print(words, found / n)
    assert found / n >= D.TARGET_RECALL and whole == n
