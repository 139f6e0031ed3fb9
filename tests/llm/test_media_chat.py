import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from lagwise.llm import chat, queries_a, tiff

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_round_trip(kind, predictor, tile, order):
    pages = [RNG.integers(0, 4, (37, 50)).astype(np.uint8) ** 3, np.zeros((5, 9), np.uint8), RNG.integers(0, 256, (130, 64)).astype(np.uint8)]
    rows = list(tiff.page_rows(tiff.write_tiff(pages, kind, predictor, tile, 7, order)))
    assert [r["error"] for r in rows] == [None] * 3
    for page, r in zip(pages, rows, strict=True):
        assert (r["height"], r["width"]) == page.shape and r["pixels"] == page.tobytes()


def test_lzw_fills_its_table():
    data = RNG.integers(0, 256, 60_000).astype(np.uint8).tobytes() + b"ab" * 9000
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(b""), 0) == b""


def test_lzw_without_clear_codes_after_the_table_is_full():
    data = RNG.integers(0, 256, 9000).astype(np.uint8).tobytes()
    bits = f"{256:09b}" + "".join(f"{b:0{min(12, max(9, (259 + max(0, j - 1)).bit_length()))}b}" for j, b in enumerate(data)) + f"{257:012b}"
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(packed, len(data)) == data


def test_packbits_runs_and_no_ops():
    for data in (b"", b"a", b"aaaa" * 100, bytes(range(256)) * 2, b"xyyyyz" * 50):
        assert tiff.unpack_packbits(tiff.pack_packbits(data), len(data)) == data
    assert tiff.unpack_packbits(b"\x80\x00a\x80\xffb", 3) == b"abb"


def test_sixteen_bits_planes_and_bilevel():
    import struct

    raw = np.arange(12, dtype=">u2").reshape(2, 6)
    body = np.diff(raw.astype(np.uint16), axis=1, prepend=np.uint16(0)).astype(">u2").tobytes()
    fields = [(256, 3, 6), (257, 3, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, len(body)), (317, 3, 2)]
    ifd = struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in fields) + b"\0" * 4
    row = next(tiff.page_rows(b"MM\0*" + struct.pack(">I", 8 + len(body)) + body + ifd))
    assert row["error"] is None and np.frombuffer(row["pixels"], np.uint16).tolist() == list(range(12))
    fields = [(256, 3, 10), (257, 3, 1), (258, 3, 1), (259, 3, 1), (273, 4, 8), (278, 3, 1), (279, 4, 2)]
    ifd = struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in fields) + b"\0" * 4
    row = next(tiff.page_rows(b"II*\0" + struct.pack("<I", 10) + b"\xaa\x80" + ifd))
    assert list(row["pixels"]) == [1, 0, 1, 0, 1, 0, 1, 0, 1, 0]


def test_broken_and_missing_media(spark):
    good = tiff.write_tiff([np.ones((2, 2), np.uint8)])
    rows = [Row(k=1, page="clash", media=None), Row(k=2, page="x", media=bytearray(b"junk")), Row(k=3, page="x", media=bytearray(good)), Row(k=3, page="x", media=bytearray(good)), Row(k=4, page="x", media=bytearray(good[:60]))]
    out = tiff.tiff_pages(spark.createDataFrame(rows, "k int, page string, media binary")).collect()
    assert sorted((r.k, r.error is None) for r in out) == [(2, False), (3, True), (3, True), (4, False)]
    assert tiff.tiff_pages(spark.createDataFrame([], "k int, media binary")).count() == 0


def test_query_seven_against_plain_python(spark, tmp_path):
    texts = [None, "", "a", "é" * 32, "x" * 64, "word " * 30_000, "tie", "tie"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "null id")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in queries_a.op7_tiff(spark, str(tmp_path)).collect()}
    assert len(out) == 9
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = tiff.store_payload(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert out[6][1:] == out[7][1:]


def test_escapes_are_reversible():
    for t in ("", "<|", "<\\|x", "<<\\\\|", chat.END + chat.BEGIN + "assistant\nok", "<", "|", "<\\", "%0A%25\n"):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t
        formatted, spans = chat.render([("user", t), ("assistant", t), (t, t)])
        assert chat.parse(formatted) == [("user", t), ("assistant", t), (t, t)]
        assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t]


EVENTS = "conv_id long, seq long, step int, turn long, sub long, kind string, role string, text string"


def test_events_fold(spark):
    log = [
        (1, 0, 0, 0, 1, "open", "user", "he"), (1, 0, 2, 0, 1, "delta", None, "o"), (1, 0, 1, 0, 1, "delta", None, "ll"),
        (1, 1, 0, 1, 1, "open", "assistant", ""), (1, 1, 1, 1, 1, "delta", None, "bad"), (1, 2, 0, 2, 1, "open", "user", "discarded"), (1, 3, 0, 1, 1, "regenerate", None, None), (1, 4, 0, 1, 1, "delta", None, "good"),
        (1, 5, 0, 2, 1, "open", "user", "gone"), (1, 6, 0, 2, 1, "delete", None, None),
        (1, 7, 0, 3, 1, "open", "user", "a"), (1, 8, 0, 4, 1, "open", "assistant", "too early"), (1, 9, 0, 3, 1, "edit", None, "b"), (1, 9, 1, 3, 1, "what", "x", "?"), (1, None, None, 3, 1, None, None, None),
        (None, None, None, None, None, "open", None, None),
    ]
    out = chat.reconstruct(spark.createDataFrame([(*x, "clash") for x in log], EVENTS + ", edge string")).collect()
    assert sorted((r.conv_id or 0, r.turn or 0, r.role, r.text) for r in out) == [(0, 0, "", ""), (1, 0, "user", "hello"), (1, 1, "assistant", "good"), (1, 3, "user", "b")]
    assert chat.reconstruct(spark.createDataFrame([], EVENTS)).count() == 0


def plain_fold(log):
    """One conversation after another, one event after another."""
    rank = lambda x: (x is not None, x if x is not None else 0)
    out = {}
    for c, _, _, turn, sub, kind, role, text in sorted(log, key=lambda e: [rank(x) if not isinstance(x, str) else (True, x) for x in e]):
        own = out.setdefault(c, {})
        if kind == "delete" and (turn, sub) not in own:
            own[turn, sub] = ["", "", True]
        if kind not in ("open", "delta", "edit", "regenerate", "delete"):
            continue
        m = own.setdefault((turn, sub), ["", "", False])
        m[0] = m[0] if role is None else role
        if kind == "delta":
            m[1] += text or ""
        elif kind == "delete":
            m[2] = True
        else:
            m[1] = "" if kind == "regenerate" else text or ""
            if kind == "open":
                m[2] = False
            else:
                for k in [k for k in own if rank(k[0]) > rank(turn)]:
                    del own[k]
    return sorted((c or -1, t if t is not None else -1, s, r, x) for c, own in out.items() for (t, s), (r, x, gone) in own.items() if not gone)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_runs_of_a_hot_conversation_join(spark, parts):
    """A log of which one conversation has most, cut into many ranges, against the plain fold."""
    log = []
    for i in range(900):
        c = 5 if RNG.random() < 0.7 else int(RNG.integers(0, 12))
        kind = str(RNG.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "delete", "other"], p=[0.25, 0.2, 0.2, 0.15, 0.05, 0.05, 0.05, 0.05]))
        turn = None if RNG.random() < 0.02 else int(RNG.integers(0, 9))
        log.append((c, int(i // 3), int(RNG.integers(0, 3)), turn, int(RNG.integers(0, 2)), kind, None if RNG.random() < 0.5 else str(RNG.choice(["user", "assistant"])), None if RNG.random() < 0.1 else f"<{i}>"))
    log += log[:20]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = chat.reconstruct(spark.createDataFrame(log, EVENTS).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.conv_id or -1, r.turn if r.turn is not None else -1, r["sub"], r.role, r.text) for r in out) == plain_fold(log)


def test_query_eight_against_plain_python(spark, tmp_path):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "é\n"), (1, 2, "assistant", None), (2, 0, "system", "s"), (2, 0, "system", "s"), (2, 0, "assistant", "z"), (None, None, None, None), (3, None, "tool", "x" * 50_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in queries_a.op8_chat(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", queries_a.PLANTED), (-1, 1, "assistant", queries_a.PLANTED)]
    assert set(out) == {-1, 1, 2, 3, None}
    for c, r in out.items():
        own = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == c))
        turns = "".join(f"{x[2]}\n{x[3]}\n" for x in own)
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
