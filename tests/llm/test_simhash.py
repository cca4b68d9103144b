import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tallyforge.llm import simhash

SCHEMA = "doc_id long, text string, fp int, root string"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps):
    """Smallest id reachable, by searching all pairs."""
    out = {}
    for start in fps:
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for y in fps:
                if y not in seen and bin(fps[x] ^ fps[y]).count("1") <= 3:
                    seen.add(y)
                    todo.append(y)
        out[start] = min(seen)
    return out


def texts():
    rnd = random.Random(7)
    base = [" ".join(rnd.choice(["Alpha", "beta", "gÄmma", "delta", "eps", "zeta"]) for _ in range(120)) for _ in range(8)]
    out = [None, "", " \t\n", "one", "one two", "ONE TWO", "x" * 5000]
    for b in base:
        out += [b, b, b + " end"]
        words = b.split()
        for _ in range(6):
            w = list(words)
            w[rnd.randrange(len(w))] = "other"
            out.append(" ".join(w))
    out.append(" ".join(rnd.choice(["a", "b", "c"]) for _ in range(60_000)))
    return out


def test_fingerprints_and_classes_equal_brute_force(spark):
    rows = [(i, t, 1, "clash") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in simhash.near_duplicate_classes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    fps = {i: plain(t) for i, t, *_ in rows}
    assert {i: r.fp % 2**64 for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == brute(fps)


def test_near_pairs_finds_every_pair_once_a_segment(spark):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for k in (1, 2, 3, 4):
            fps.add(f ^ sum(1 << b for b in rnd.sample(range(64), k)))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = {frozenset((r.a, r.b)) for r in simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= 3}
    assert got == want


def test_keep_one_and_repeated_rows_and_nulls(spark):
    rows = [(1, "a b c d", 1, "r"), (1, "a b c d", 1, "r"), (2, "A b c d", 2, "s"), (None, "q w e r", 3, "t"), (None, "q w e r", 3, "t"), (5, None, 4, "u"), (6, "", 4, "u")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.fp) for r in kept.collect()) == [(-1, 3), (1, 1), (5, 4)]
    assert len(simhash.near_duplicate_classes(df).collect()) == len(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicate_classes(df).collect() == []
    assert simhash.keep_one_of_each(df).collect() == []


@pytest.mark.parametrize("few,block", [(8, 2048), (2, 50)])
def test_many_near_fingerprints_get_a_few_links_each(spark, monkeypatch, few, block):
    """Thousands of fingerprints around a few others, chains among them: the classes of all pairs from a few links a member."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(11)
    fps = set()
    for count in (3000 if few == 8 else 300, 200, 40, 5):
        center = rnd.getrandbits(64)
        for k in range(count):
            fps.add(center ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 5] if k % 9 else [6, 8]))))
    chain = rnd.getrandbits(64)
    for _ in range(60):
        chain ^= sum(1 << b for b in rnd.sample(range(64), 3))
        fps.add(chain)
    signed = np.array([f - 2**64 if f >= 2**63 else f for f in fps])
    links = simhash.near_links(spark.createDataFrame([(int(f),) for f in signed], "fp long"))
    assert links.count() <= 12 * len(fps)
    near = np.bitwise_count(signed.view(np.uint64)[:, None] ^ signed.view(np.uint64)[None, :]) <= 3
    label = np.arange(len(signed))
    while True:
        low = np.array([label[row].min() for row in near])
        if (low == label).all():
            break
        label = low
    want = {}
    for f, x in zip(signed.tolist(), label.tolist()):
        want.setdefault(x, set()).add(f)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in links.collect():
        root[find(r.a)] = find(r.b)
    got = {}
    for f in signed.tolist():
        got.setdefault(find(f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_buckets_over_batches_and_blocks(monkeypatch):
    """Buckets of all sizes cut by batches of rows: links and pairs of blocks join what a bucket's near pairs join."""
    monkeypatch.setattr(simhash, "BLOCK", 20)
    rng = np.random.default_rng(6)
    rows = []
    for part, size in enumerate([1, 300, 2, 1, 7, 8, 9, 40, 41, 1, 55, 3, 120, 1]):
        low = rng.integers(0, 1 << 30)
        high = rng.integers(0, 1 << 31)
        for f in sorted({int(low | ((high ^ sum(1 << int(b) for b in rng.choice(31, rng.integers(0, 6), replace=False))) << 32)) for _ in range(size)}):
            rows.append((simhash.HALF, part, f))
    table = pa.table({"slot": pa.array([r[0] for r in rows], pa.int32()), "part": [r[1] for r in rows], "fp": [r[2] for r in rows]})
    for batch in (1, 7, 64, 1000):
        joined, blocks = {}, {}

        def find(x):
            while joined.setdefault(x, x) != x:
                x = joined[x]
            return x

        def link(a, b):
            for x, y in zip(a.tolist(), b.tolist()):
                joined[find(x)] = find(y)

        for out in simhash._scan(iter(table.to_batches(max_chunksize=batch))):
            for r in out.to_pylist():
                if r["a"] is not None:
                    joined[find(r["a"])] = find(r["b"])
                else:
                    blocks.setdefault(r["part"], {})[r["block"]] = np.array(r["fps"])
        sizes = {p: sum(r[1] == p for r in rows) for p in range(14)}
        assert {p for p in sizes if sizes[p] > 40} <= set(blocks) <= {p for p in sizes if sizes[p] >= 40}
        for own in blocks.values():
            assert sorted(own) == list(range(len(own))) and max(map(len, own.values())) <= 20
            for i in own:
                for j in own:
                    if i <= j:
                        link(*simhash._stars(own[i], own[j]))
        got = {frozenset(x for _, p, x in rows if find(x) == f and p == part) for _, part, f in rows}
        want = set()
        for part in range(14):
            own = np.array([r[2] for r in rows if r[1] == part])
            near = np.bitwise_count(own[:, None].view(np.uint64) ^ own[None, :].view(np.uint64)) <= 3
            label = np.arange(len(own))
            while (low := np.array([label[n].min() for n in near])).tolist() != label.tolist():
                label = low
            want |= {frozenset(own[label == k].tolist()) for k in set(label.tolist())}
        assert {g for g in got if g} == want
