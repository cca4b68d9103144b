import math
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyforge.llm import bestfit, tokenbin, tokens

SCHEMA = "doc_id long, text string, piece string, uid int"


def texts():
    rnd = random.Random(2)
    words = ["the", "naïve", "über", "x1", "foo.bar", "\n", "  ", "<|endoftext|>", "😀", "don't", "\t", "١٢"]
    out = [None, "", " ", "a" * 300_000, " " * 30_000, "\n" * 9_000, "word " * 40_000]
    return out + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(900))) for _ in range(150)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + [(None, "no id", "c", 1), (7, rows[7][1], "c", 1)], SCHEMA)


@lru_cache(maxsize=1)
def library():
    """The tokenizer as its own library reads it, untouched by the package."""
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]


def coded(text):
    coder = tokens.encoder()
    return np.frombuffer(coder.encode(text), dtype=coder.dtype).tolist()


def test_ids_equal_the_tokenizer(spark):
    assert tokens.encoder().ranked is not None
    for t in texts():
        assert coded(t or "") == ids_of(t)[:-1]
    assert len(coded("x <|endoftext|> y")) == 4


@pytest.mark.parametrize("c", [" ", "\n", "\u2003", "a", "é", "!", "7", " \n", "ab "])
def test_ids_of_very_long_runs(c):
    for text in (c * 1_000_000, f"begin {c * 200_000}end <|endoftext|>{c * 70_000} 'll"):
        assert coded(text) == ids_of(text)[:-1]


def test_ten_million_spaces():
    assert len(coded(" " * 10_000_000)) == 10_000_000
    assert len(coded(" " * 9_999_999 + "a")) == 9_999_999  # the last space and the letter are one token


def test_ids_across_segments(monkeypatch):
    """Whatever is cut where, the ids are those of the whole text."""
    rnd, alphabet = random.Random(6), ["a", "B", "é", "7", " ", "  ", "\n", "'", "'s", "'ll", "!", ".", "\u00a0", "\u3000", "\x1c", "<|endoftext|>", "😀", "٣", "ab"]
    for size in (1, 3, 17):
        monkeypatch.setattr(tokens, "SEGMENT", size)
        for _ in range(400):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60)))
            assert coded(text) == ids_of(text)[:-1], text


def test_every_character_is_encoded_alike():
    """The two libraries take every code point for the same kind of character."""
    coder = tokens.encoder()
    for at in range(0, 0x110000, 64):
        text = " ".join(f"x{chr(c)}y 1{chr(c)}2 {chr(c)}{chr(c)}" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000)
        assert coder.ranked.encode_ordinary(text) == library().encode(text, add_special_tokens=False).ids


def test_large_ids_beside_null_ones(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "a b"), (None, "c"), (big + 2, None)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in bestfit.pack_documents(df).collect()} == {big, None, big + 2}
    assert {d for r in tokenbin.pack_rows(df).collect() for d in r.doc_ids} == {big, None, big + 2}
    named = df.selectExpr("cast(doc_id as string) as doc_id", "text")
    assert {d for r in tokenbin.pack_rows(named).collect() for d in r.doc_ids} == {str(big), None, str(big + 2)}


def check_packing(rows, want, capacity):
    """Every document whole and in order, every sequence gapless and within capacity."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for doc_id, ids in want.items():
        parts = sorted(by_doc.pop(doc_id), key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert sum(p.length for p in parts) == len(ids)
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert all(p.length == capacity for p in parts[1:]) and (len(ids) > capacity or len(parts) == 1)
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
    assert not by_doc
    return len(by_seq)


def test_genetic_packing_is_whole_and_close_to_the_bound(spark, docs):
    distinct = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = bestfit.pack_documents(distinct.repartition(3)).collect()
    n = check_packing(rows, {i: ids_of(t) for i, t in enumerate(texts())}, 1024)
    assert n <= math.ceil(sum(r.length for r in rows) / 1024) * 1.05 + 1
    assert bestfit.pack_documents(docs).count() == len(rows) + 1 + sum(r.doc_id == 7 for r in rows)


def test_several_blocks_and_levels(spark):
    rnd = random.Random(4)
    lengths = [(i, rnd.choice([1, 3, 100, 500, 700, rnd.randrange(1, 1024), 1024])) for i in range(3000)]
    pieces = bestfit.durable(spark.createDataFrame(lengths, "uid long, length long"))
    rows = bestfit.pack(pieces, 1024, block=200).collect()
    assert sorted((r.uid, r.length) for r in rows) == lengths
    loads = defaultdict(list)
    for r in rows:
        loads[r.sequence_id].append((r.offset, r.length))
    for spots in loads.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(spots), sorted(spots)[1:] + [(sum(x for _, x in spots), 0)]))
        assert sum(n for _, n in spots) <= 1024
    at_once = tokenbin.best_fit_decreasing(np.array([n for _, n in lengths]), 1024).max() + 1
    assert len(loads) <= at_once * 1.01


def test_crossover_and_mutation_keep_every_piece():
    rng = np.random.default_rng(1)
    group = bestfit.Grouping(np.sort(rng.integers(1, 64, 300)), 64, 5)
    a, b = group.first(0.0), group.first(0.5)
    for _ in range(50):
        a = group.mutation(group.crossover(a, b))
        assert len(a) == 300 and group.loads(a).max() <= 64 and group.loads(a).min() > 0


def test_best_fit_decreasing_equals_a_plain_search():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(1, 33, rng.integers(1, 80))
        got = tokenbin.best_fit_decreasing(sizes, 32)
        rooms: list[int] = []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [k for k, r in enumerate(rooms) if r >= s]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= s
            else:
                rooms.append(32 - s)
        assert sorted(32 - np.bincount(got, weights=sizes).astype(int)) == sorted(rooms)


def test_token_rows_round_trip(spark, docs, tmp_path):
    distinct = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    packed = tokenbin.pack_rows(distinct)
    tokenbin.write_rows(packed, str(tmp_path / "rows"))
    back = spark.read.parquet(str(tmp_path / "rows"))
    assert {r.doc_id: r.text for r in tokenbin.texts_of(back).collect()} == {i: t or "" for i, t in enumerate(texts())}
    for r in back.collect():
        assert len(r.ids) == 2 * tokenbin.CAPACITY and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert all((p == 0) == (k == 0) for p, k in zip(r.position_starts, r.pieces))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bestfit.pack_documents(none).count() == 0
    assert tokenbin.pack_rows(none).count() == 0
