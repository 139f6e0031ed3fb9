"""Training-order materialisation: a keyed permutation gives every sequence its slot in fixed-stride shards."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwise.llm import tokens
from lagwise.llm.scratch import Scratch
from lagwise.llm.textbytes import U, frugal, mix

#: Ids of a sequence, sequences of a shard, rounds of the permutation.
LENGTH, PER_SHARD, ROUNDS = 1024, 1024, 6
#: Texts, and characters of each, whose ids tell which ones are common; that changes the size of what is moved, never the result.
LOOKED_AT, LOOKED_AT_CHARS = 200, 4_000
#: Bytes of ids after which a batch goes out.
FLUSH = 8 << 20
#: Shards that are named one by one when a part of them is read; beyond, all are listed.
NAMED = 1_000


def permute(index: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0 .. n - 1: a Feistel network on the smallest even number of bits, walked until it is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = U((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(key & (1 << 64) - 1))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> U(half), x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return left << U(half) | right

    out = once(index.astype(U))
    while (out >= n).any():
        far = out >= n
        out[far] = once(out[far])
    return out.astype(np.int64)


SPANS = "array<struct<doc_id:long,start:long,at:int,count:int>>"
SEQUENCE_DDL = f"part int, place long, count int, docs {SPANS}, packed binary"


def _kind(wide: bool) -> str:
    return "<u4" if wide else "<u2"


class Packing:
    """Ids on their way to a shard, in a form that compresses better: their ranks, the low bytes of all before the high ones (wide: as they are).

    common: ids, the commonest first. They only make what is moved smaller; any id and any number of them can be packed.
    """

    def __init__(self, common: np.ndarray, wide: bool):
        self.kind, self.size = _kind(wide), 4 if wide else 2
        self.id_of = self.rank = None
        if not wide:
            first = common[common <= 0xFFFF].astype(np.int64)
            self.id_of = np.concatenate((first, np.setdiff1d(np.arange(1 << 16), first))).astype(self.kind)
            self.rank = np.empty(1 << 16, self.kind)
            self.rank[self.id_of] = np.arange(1 << 16)

    def pack(self, ids: np.ndarray) -> bytes:
        if self.rank is None:
            return ids.tobytes()
        own = self.rank.take(ids)
        return own.astype(np.uint8).tobytes() + (own >> 8).astype(np.uint8).tobytes()

    def records(self, packed: pa.Array, length: int, end_id: int) -> bytes:
        """Sequences, one after another, each filled up with end_id to `length` ids."""
        whole, full = [x.as_buffer() for x in packed], length * self.size
        for i, x in enumerate(whole):
            if x.size < full:
                own, more = x.to_pybytes(), length - x.size // self.size
                end = self.pack(np.array([end_id], self.kind))
                n = len(own) // 2
                whole[i] = own + end * more if self.rank is None else own[:n] + end[:1] * more + own[n:] + end[1:] * more
        out = b"".join(whole)
        if self.id_of is None:
            return out
        low, high = np.frombuffer(out, np.uint8).reshape(-1, 2, length).transpose(1, 0, 2)
        return self.id_of.take(low | high.astype(self.kind) << 8).tobytes()


def common_ids(docs: DataFrame, vocabulary: str) -> np.ndarray:
    """The ids of a few texts, the commonest first."""
    encode = tokens.encoder(vocabulary).ids
    some = [encode(r["text"]) for r in docs.select(F.substring("text", 1, LOOKED_AT_CHARS).alias("text")).limit(LOOKED_AT).collect()]
    tokens.forget()
    ids, n = np.unique(np.frombuffer(b"".join(some), "<u4"), return_counts=True)
    return ids[np.argsort(-n, kind="stable")]


def sequences(docs: DataFrame, vocabulary: str, length: int, end_id: int, wide: bool, packing: Packing) -> DataFrame:
    """(part, place, count, docs, packed): each task's texts, one after another with end_id behind each, cut every `length` ids.

    docs: which ids of which documents: doc_id, the first one's number in the document and in the
    sequence, and how many. Only a task's last sequence is shorter.
    """
    kind, size = _kind(wide), 4 if wide else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.encoder(vocabulary).ids, np.array([end_id], "<u4").tobytes()
        part, place, held, filled = TaskContext.get().partitionId(), 0, bytearray(), 0
        rows: list[bytes] = []
        counts: list[int] = []
        spans: list[tuple] = []
        cuts = [0]

        def send() -> pa.RecordBatch:
            nonlocal rows, counts, spans, cuts
            cols = list(zip(*spans, strict=True)) or [[]] * 4
            kinds = (("doc_id", pa.int64()), ("start", pa.int64()), ("at", pa.int32()), ("count", pa.int32()))
            own = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])
            k = len(rows)
            arrays = [np.full(k, part, np.int32), np.arange(place - k, place), np.array(counts, np.int32)]
            batch = pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), own), pa.array(rows, pa.binary())], names=["part", "place", "count", "docs", "packed"])
            rows, counts, spans, cuts = [], [], [], [0]
            return batch

        def close() -> None:
            nonlocal place, filled
            rows.append(packing.pack(np.frombuffer(bytes(held), kind)))
            counts.append(filled)
            cuts.append(len(spans))
            held.clear()
            place, filled = place + 1, 0

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.frombuffer(encode(text.as_py()) + end, "<u4")
                if not wide and ids.max() > 0xFFFF:
                    raise ValueError("an id needs more than 16 bits")
                ids, start = ids.astype(kind), 0
                while start < len(ids):
                    n = min(length - filled, len(ids) - start)
                    spans.append((doc_id, start, filled, n))
                    held += ids[start : start + n].tobytes()
                    start, filled = start + n, filled + n
                    if filled == length:
                        close()
                if len(rows) * length * size > FLUSH:
                    yield send()
        if filled:
            close()
        yield send()

    return docs.select("doc_id", "text").mapInArrow(frugal(run), SEQUENCE_DDL)


def write_shards(
    docs: DataFrame, path: str, seed: int = 0, vocabulary: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, end_id: int = 0, wide: bool = False, text: str = "text", key: str = "doc_id"
) -> int:
    """Writes all sequences in training order and returns their number.

    path/shards has a file a shard, part-<shard>-..., which is nothing but the ids of the slots from
    shard * per_shard on, 2 bytes each (wide: 4, little-endian), uncompressed, every record filled up
    with end_id to the same stride; one line feed follows the last. So a reader finds slot t at byte
    (t - shard * per_shard) * stride of shard t // per_shard, and goes on from any slot in order.
    path/index has (slot, shard, offset, count, docs), docs naming the documents of a record's ids;
    path/facts has one row: n, per_shard, length, stride, wide, seed.

    Sequences are written once, numbered by the counts of the tasks before their own, and sent
    once, to the task of their slot's shard, which holds that shard only. Until then, unless wide,
    they are ranks among the ids of a few texts looked at first, which compress better. As the slots
    are a permutation, shards are even whatever the documents are. The same documents in the same files,
    seed and sizes give the same order. A null or empty text is the end id alone; a null id stays
    null in the index. Very long texts go on over sequences. Repeated rows are texts of their own.
    Other columns are ignored, whatever their names. An empty table writes no shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "order")
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    vocabulary = vocabulary or tokens.vocabulary_path()
    packing = Packing(np.zeros(0, np.int64) if wide else common_ids(docs, vocabulary), wide)
    rows = scratch.save(sequences(docs, vocabulary, length, end_id, wide, packing), "sequences")
    per_task = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row a task goes through this window.
    base = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per_task = scratch.save(per_task.select(F.col("part").alias("c_part"), base.alias("base"), "n"), "counts")
    total = per_task.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    stride = length * (4 if wide else 2)
    spark.createDataFrame([(total, per_shard, length, stride, wide, seed)], "n long, per_shard long, length long, stride long, wide boolean, seed long").write.parquet(f"{path}/facts")

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), total, seed))

    numbered = rows.join(F.broadcast(per_task.select("c_part", "base")), F.col("part") == F.col("c_part")).withColumn("slot", slot_of(F.col("base") + F.col("place")))
    shard = F.floor(F.col("slot") / per_shard).cast("long")
    offset = F.pmod(F.col("slot"), F.lit(per_shard)) * stride
    numbered.select("slot", shard.alias("shard"), offset.alias("offset"), "count", "docs").write.option("compression", "zstd").parquet(f"{path}/index")
    if not total:
        return 0
    shards = -(-total // per_shard)
    sent = numbered.select("slot", "packed").repartitionById(shards, shard.cast("int")).sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        body = bytearray()
        for batch in batches:
            body += packing.records(batch.column("packed"), length, end_id)
        if body:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(body)], pa.binary())], names=["payload"])

    files = sent.mapInArrow(frugal(write), "payload binary").select(F.col("payload").cast("string").alias("value"))
    files.write.option("compression", "none").option("lineSep", "\n").text(f"{path}/shards")
    scratch.drop(rows)
    return total


def read_records(file: BinaryIO, stride: int, first: int, n: int) -> Iterator[bytes]:
    """n records of a shard's open file from its first-th on: one seek, then reads in order."""
    file.seek(first * stride)
    for _ in range(n):
        yield file.read(stride)


def read_slots(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """(slot, shard, ids) of the slots first <= slot < last, each shard in order; ids with what fills them up.

    Only the shards that hold them are read. Slots beyond the last give no rows.
    """
    facts = spark.read.parquet(f"{path}/facts").first()
    n, per_shard, stride = facts["n"], facts["per_shard"], facts["stride"]
    first, last = max(0, first), n if last is None else min(n, last)
    schema = "slot long, shard long, ids binary"
    if first >= last:
        return spark.createDataFrame([], schema)
    a, b = first // per_shard, -(-last // per_shard)
    files = [f"{path}/shards/part-{s:05d}-*" for s in range(a, b)] if b - a <= NAMED else [f"{path}/shards"]
    found = spark.read.format("binaryFile").load(files).select(F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("long").alias("shard"), "content").filter(F.col("shard").between(a, b - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                base = shard * per_shard
                low, high = max(first, base) - base, min(last, base + per_shard) - base
                data = content.as_buffer()[low * stride : high * stride]
                ids = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((np.arange(high - low + 1) * stride).astype(np.int32).tobytes()), data])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(base + low, base + high)), pa.array(np.full(high - low, shard)), ids], names=["slot", "shard", "ids"])

    return found.mapInArrow(frugal(run), schema)


def checksums(rows: DataFrame) -> DataFrame:
    """Adds ids_crc32, of the stored ids."""
    return rows.withColumn("ids_crc32", F.crc32("ids"))
