"""What operators move and hold stays in proportion, however large a group of near copies is."""

import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType
from tokenizers import Tokenizer

from lagwise.llm import jaccard_join as J
from lagwise.llm import textbytes, tokens, training_order

RNG = np.random.default_rng(11)
WORDS = [f"w{i}" for i in range(4000)]


def near_copies(n, length=120, edits=2):
    base = list(RNG.choice(WORDS, length))
    out = []
    for i in range(n):
        own = list(base)
        for p in RNG.integers(0, length, edits):
            own[p] = f"e{i}x{p}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("n", [240, 480])
def test_a_large_group_gives_a_few_pairs_a_set(spark, monkeypatch, n):
    rows, seen = list(enumerate(near_copies(n) + near_copies(3))), []
    save = J.Scratch.save

    def counted(self, df, name, *more):
        out = save(self, df, name, *more)
        if name in ("pairs", "passed"):
            seen.append(out.count())
        return out

    monkeypatch.setattr(J.Scratch, "save", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in J.near_duplicates(docs).collect()}
    assert got == plain.brute_components(rows)
    assert max(seen) <= 6 * len(rows)


class Plan:
    """Stands for a table: its function of batches is called as a task would."""

    schema = {"doc_id": type("F", (), {"dataType": LongType()})}

    def select(self, *cols):
        return self

    def mapInArrow(self, f, ddl):
        return f


def test_rows_of_the_exchange_are_small_and_whole(monkeypatch):
    """However many signatures a bucket takes, no row has more than ROW_SIGNATURES, and none is lost."""
    texts = near_copies(400, 400) + [" ".join(f"v{i}" for i in range(60_000))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    common = type("B", (), {"value": None})
    monkeypatch.setattr(J, "GATHER", 1 << 30)  # all in one go, as a long text is
    out = list(J.dealt(Plan(), 5, Fraction(3, 4), common, np.zeros(0, np.int64), 2)(iter([batch])))
    rows = [(b, *(x.as_py() for x in r)) for o in out for b, *r in zip(o.column("bucket").to_pylist(), o.column("sigs"), o.column("sizes"), o.column("fps"), strict=True)]
    assert max(sum(map(len, r[1:])) for r in rows) <= 14 << 14 and max(o.nbytes for o in out) <= 2 << 20
    sets, at = J.shingle_sets(*[x for x in J.chunks(pa.array(texts), 1 << 30)][0][1:])
    sig, owner = J.Signer(Fraction(3, 4), None).emit(sets, at)
    fp = J.prints(sets, at)[0]
    got = sorted((b, s, f) for b, sigs, _, fps in rows for s, f in zip(np.frombuffer(sigs, "<u4").tolist(), np.frombuffer(fps, np.int64).tolist(), strict=True))
    assert got == sorted(zip((sig % np.uint64(2)).tolist(), (sig >> np.uint64(32)).tolist(), fp[owner].tolist(), strict=True))


def test_encoder_remembers_pieces_and_not_words():
    """The same letters with other marks behind are no new work, and marks don't go to the whole tokenizer."""
    e = tokens.Encoder(tokens.vocabulary_path())
    whole, asked = e.tokenizer, []
    e.pieces.tokenize = lambda x, f=e.pieces.tokenize: asked.append(x) or f(x)
    e.tokenizer = None  # only texts that are not sure go there
    text = " ".join(w + m for w in ("alpha", "Beta", "bêta", "it's") for m in ("", ".", ",", ".***", "$$$", "½", "7"))
    assert e.ids(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(asked) == len(set(asked)) == 11


def test_encoder_takes_every_sign_of_latin_1():
    e = tokens.Encoder(tokens.vocabulary_path())
    signs = [*map(chr, range(256)), "'s", "'LL", "<|", "don't", "3.5", " ", " ", "ab"]
    for _ in range(3000):
        text = "".join(RNG.choice(signs[: 128 if RNG.random() < 0.5 else None], int(RNG.integers(1, 30))))
        assert e.ids(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_checksums_need_no_worker_of_their_own(spark, tmp_path):
    """Records of a shard are cut by a worker; their checksums are summed by the engine."""
    docs = spark.createDataFrame([(i, f"w{i} and more " * 9) for i in range(40)], "doc_id long, text string").repartition(3)
    n = training_order.write_shards(docs, f"{tmp_path}/s", 1, length=30, per_shard=8)
    for first, last in ((0, None), (3, 5), (7, 17), (n - 1, n + 9)):
        got = training_order.checksums(training_order.read_slots(spark, f"{tmp_path}/s", first, last))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan
        rows = sorted(got.collect())
        assert [(r.slot, r.shard) for r in rows] == [(t, t // 8) for t in range(first, min(n, last or n))]
        for r in rows:
            (name,) = (tmp_path / "s/shards").glob(f"part-{r.shard:05d}-*")
            with name.open("rb") as f:
                (ids,) = training_order.read_records(f, 60, r.slot % 8, 1)
            assert (bytes(r.ids), r.ids_crc32) == (ids, zlib.crc32(ids))


def test_shingle_hashes_are_those_of_plain_sets():
    """What test_texts.py means to compare, where a local name hides the module of plain versions."""
    texts = ["", None, " \n", "one", "One two", "a b c d e", "A B c d e f", "é ü\u00a0x\u3000y z  q\tr", "x " * 3000, "long" * 9000 + " b c d e f"] + [" ".join(RNG.choice(WORDS, int(n))) for n in RNG.integers(0, 60, 50)]
    hashes, at = {}, 0
    for _, data, offsets in textbytes.chunks(pa.array(texts), 500):
        sets, begin = textbytes.shingle_sets(data, offsets)
        for r in range(len(offsets) - 1):
            want, own = plain.shingles_of(texts[at + r]), sets[begin[r] : begin[r + 1]].tolist()
            assert len(own) == len(want) and own == sorted(set(own))
            for s in want:
                hashes[s] = hashes.get(s, set(own)) & set(own)
        at += len(offsets) - 1
    assert at == len(texts) and all(hashes.values())


def test_a_bucket_is_held_once(monkeypatch):
    """Signatures that a task gathers are held once, and give the same pairs and groups."""
    n, row = 1_200_000, 2_000
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 1 << 32, n, np.uint64).astype("<u4")
    sig[: n // 100] = np.repeat(sig[: n // 200], 2)
    fp, code = rng.integers(1, 1 << 62, n), np.full(n, 900, np.uint16)
    rows = [slice(i, i + row) for i in range(0, n, row)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([7] * 50, pa.int32()), *(pa.array([x[r].tobytes() for r in rows[i : i + 50]], pa.binary()) for x in (sig, code, fp))], names=["bucket", "sigs", "sizes", "fps"])
        for i in range(0, len(rows), 50)
    ]
    monkeypatch.setattr(J, "SLICES", 16)
    pairs = set()
    tracemalloc.start()
    for out in J.candidates(Plan(), Fraction(3, 4))(iter(batches)):
        pairs |= {p for p in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True) if p[0] is not None}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {tuple(sorted(p)) for p in fp[: n // 100].reshape(-1, 2).tolist()} <= pairs
    assert peak < 1.5 * 14 * n


@pytest.mark.parametrize("wide", [False, True])
def test_sequences_are_moved_packed(spark, monkeypatch, tmp_path, wide):
    """What is written and sent on the way to the shards compresses better than the shards (unless wide), and nothing of it is lost."""
    encode, size, seen, save = tokens.encoder(tokens.vocabulary_path()).ids, 4 if wide else 2, [], J.Scratch.save
    words = sorted(w for w in Tokenizer.from_file(tokens.vocabulary_path()).get_vocab() if w.isascii() and w.isalpha() and w.islower())[::7]
    texts = [" ".join(words[int(i) * 31 % len(words)] for i in RNG.zipf(1.3, int(n)) % 3000) for n in RNG.integers(300, 3000, 60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)

    def counted(self, df, name, *more):
        out = save(self, df, name, *more)
        if name == "sequences":
            (kept,) = (f.name for f in out.schema if f.dataType.simpleString() == "binary")
            seen.extend(bytes(r[0]) for r in out.select(kept).collect())
        return out

    monkeypatch.setattr(training_order.Scratch, "save", counted)
    n = training_order.write_shards(docs, f"{tmp_path}/s", 3, length=512, per_shard=32, end_id=9, wide=wide)
    stored = {r.slot: bytes(r.ids) for r in training_order.read_slots(spark, f"{tmp_path}/s").collect()}
    assert len(seen) == len(stored) == n
    moved, plain_ids = (len(pa.compress(b"".join(x), codec="lz4", asbytes=True)) for x in (seen, stored.values()))
    assert moved < 0.95 * plain_ids or wide
    pieces = {}
    for r in spark.read.parquet(f"{tmp_path}/s/index").collect():
        ids = np.frombuffer(stored[r.slot], f"<u{size}")
        assert len(ids) == 512 and (ids[r["count"] :] == 9).all()
        for d in r.docs:
            pieces.setdefault(d.doc_id, []).append((d.start, ids[d["at"] : d["at"] + d["count"]].tolist()))
    for i, text in enumerate(texts):
        assert sum((p for _, p in sorted(pieces[i])), []) == [*np.frombuffer(encode(text), "<u4").tolist(), 9]


@pytest.mark.parametrize("wide", [False, True])
def test_any_ids_can_be_packed(wide):
    top = (1 << 32 if wide else 1 << 16) - 1
    for common in (np.zeros(0, np.int64), np.array([5, 70_000, 3, top], np.int64)):
        p = training_order.Packing(common, wide)
        rows = [RNG.integers(0, top, int(k), np.uint32, endpoint=True).astype(p.kind) for k in (64, 1, 63, 64, 7)]
        got = p.records(pa.array([p.pack(r) for r in rows], pa.binary()), 64, 11)
        assert got == b"".join(r.tobytes() + np.array([11], p.kind).tobytes() * (64 - len(r)) for r in rows)
