import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lagwise.llm import packing, tokens, topk

RNG = np.random.default_rng(11)


def test_encoder_is_the_tokenizer():
    whole = Tokenizer.from_file(tokens.vocabulary_path())
    own = tokens.Encoder(tokens.vocabulary_path())
    odd = ["Ünïcode — “quotes” it's DON'T", "á é ÀÉ ß ÿ µª", "<|endoftext|> x <|StartOfText|>", "a\x1cb\x85c\xa0d", "tab\tnew\nline\r x", "I'm 1234.5, ok.,! a., é. 1. ²³ ½", ".", "x'll. 'S, 日本語. тест,", "", "a" * 5000, "İSTANBUL ς"]
    for t in odd * 2:
        assert own.ids(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    assert own.ids(None) == b""


def test_plan_fills_like_one_by_one_best_fit():
    for _ in range(30):
        cap = int(RNG.integers(5, 60))
        lengths = RNG.integers(1, cap + 1, 300).tolist()
        counts = defaultdict(int)
        for n in lengths:
            counts[n] += 1
        segments, made = packing.plan(counts, cap)
        room = []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in room if r >= n]
            if fit:
                room.remove(min(fit))
                room.append(min(fit) - n)
            else:
                room.append(cap - n)
        assert made == len(room)
        used = defaultdict(list)
        for length, low, high, first, per, offset in segments:
            for r in range(low, high):
                used[first + (r - low) // per].append((offset + (r - low) % per * length, length))
        assert sum(map(len, used.values())) == 300 and sorted(used) == list(range(made))
        for own in used.values():
            at = 0
            for a, n in sorted(own):
                assert a == at
                at += n
            assert at <= cap


def test_pack_places_every_piece(spark):
    texts = [None, "", "a b c", "a b c", "word " * 5000, "x"] + ["t " * int(n) for n in RNG.integers(0, 90, 200)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", "x"), (2, "a b c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(5)
    out = packing.pack(docs, capacity=100).collect()
    whole = Tokenizer.from_file(tokens.vocabulary_path())
    want = defaultdict(int)
    for i, t, _ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 100)):
            part = ids[a : a + 100]
            want[(i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got, by = defaultdict(int), defaultdict(list)
    for r in out:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        by[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 100
    assert len(by) <= -(-sum(r.length for r in out) // 100) * 1.1 + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_fill_gives_the_sequences(spark):
    docs = spark.createDataFrame([(i, f"some words {i} " * (i % 40)) for i in range(60)], "doc_id long, text string")
    placed = packing.pack(docs, capacity=64)
    rows = {r.sequence_id: bytes(r.ids) for r in packing.fill(docs, placed).collect()}
    for r in placed.collect():
        assert zlib.crc32(rows[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32


def brute(vectors, is_query, k):
    want = set()
    for q, x in vectors:
        if not is_query(q):
            continue
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(np.floor(np.array(x) * 256), np.floor(np.array(y) * 256), strict=False)), c) for c, y in vectors if c != q)
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])}
    return want


def test_top_k_is_exact_with_ties_nulls_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "CHUNK_BYTES", 600)
    base = RNG.normal(0, 0.2, (230, 6)) * RNG.exponential(1, (230, 1))
    base[40:120] = base[40]
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(1000, []), (1001, [0.5]), (1002, [0.0] * 6)]
    bad = [(2000, None, 0), (2001, [1.0, None], 0), (2002, [float("nan")] * 6, 0), (2003, [float("inf")] * 6, 0), (2004, [1e307, 1.0], 0), (2005, [-1e308], 0), (None, [1.0] * 6, 0)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors] + bad, "vec_id long, embedding array<double>, score int")
    out = topk.exact_top_k(df, F.col("vec_id") % 10 == 0, 5)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in out.collect()} == brute(vectors, lambda q: q % 10 == 0, 5)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.exact_top_k(few, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.exact_top_k(few.limit(0), F.lit(True), 5).count() == 0


def test_top_k_with_huge_components(spark):
    vectors = [(0, [1e200, 1.0]), (1, [1e200, -5.0]), (2, [-1e200, 3.0]), (3, [0.0, 2.0]), (4, [1.0, 1.0])]
    out = topk.exact_top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 4).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank)] == [(1, 1, (1 << 63) - 1), (2, 4, (1 << 63) - 1), (3, 3, 256 * 512), (4, 2, -(1 << 63))]


def test_top_k_with_products_beyond_doubles(spark):
    vectors = [(i, [float(2**40 + i), 3.0, -float(i)]) for i in range(5)]
    out = topk.exact_top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") < 2, 2).collect()
    assert {r.score for r in out} == {(1 << 63) - 1} and {(r.query_id, r.vec_id) for r in out} == {(0, 1), (0, 2), (1, 0), (1, 2)}
