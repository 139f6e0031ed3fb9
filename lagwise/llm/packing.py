"""Best-fit packing of token sequences, planned over counts of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwise.llm import tokens
from lagwise.llm.scratch import Scratch
from lagwise.llm.textbytes import frugal

CAPACITY, END_ID = 2048, 0
#: Rows in a batch that a task sends on.
ROWS = 20_000
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
SEGMENT_DDL = "s_length long, low long, high long, first long, per long, s_offset long"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram: segments and the number of sequences.

    A segment (length, low, high, first, per, offset) places the pieces of that length with ranks
    low to high - 1: `per` in each of the sequences from `first` on, side by side from `offset`.
    Sequences with equal room are held as ranges of numbers, so the work and the segments depend
    on the capacity and not on the number of pieces. All pieces of a length go where one by one
    best fit would put them: the fullest sequence that has room, until that has none.
    """
    rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}
    out, made = [], 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                new = -(-left // (capacity // length))
                put(capacity, made, new)
                made += new
                continue
            room = rooms[at]
            first, count = ranges[room].pop()
            if not ranges[room]:
                del ranges[room]
                rooms.pop(at)
            per = room // length
            used = min(count, left // per)
            if not used:
                per, used = left, 1
            out.append((length, rank, rank + used * per, first, per, capacity - room))
            put(room - per * length, first, used)
            put(room, first + used, count - used)
            rank += used * per
            left -= used * per
    return out, made


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, place): each text's ids and end_id, cut where longer than capacity.

    place counts a task's pieces of the same length; part is the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.encoder(vocabulary).ids, np.array([end_id], "<u4").tobytes()
        part, placed, rows = TaskContext.get().partitionId(), Counter(), []
        step = 4 * capacity

        def send() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECE_DDL.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + end
                for k, a in enumerate(range(0, len(ids), step)):
                    own = ids[a : a + step]
                    n = len(own) // 4
                    rows.append((doc_id, k, a // 4, n, zlib.crc32(own), part, placed[n]))
                    placed[n] += 1
                if len(rows) >= ROWS:
                    yield send()
                    rows = []
        yield send()

    return docs.select("doc_id", "text").mapInArrow(frugal(run), PIECE_DDL)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are written once. The driver gets one count per length (capacity rows at most) and
    plans best fit over them. A piece's rank within its length is the count of that length in the
    tasks before its own, plus its place in its task; so no length is ever sorted or gathered,
    however many share it. Slots come by joining on length and rank with the plan's segments.
    A null or empty text is the end id alone. A null id stays null; repeated rows and ids are
    packed each on their own. Very long texts give many pieces. Other columns are ignored, whatever
    their names. Empty table: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = scratch.save(pieces(docs, vocabulary or tokens.vocabulary_path(), capacity, end_id), "pieces")
    per_task = scratch.save(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments, _ = plan(histogram, capacity)
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per_task = per_task.select(F.col("length").alias("c_length"), F.col("part").alias("c_part"), before.alias("before"))
    ranked = rows.join(per_task, (F.col("length") == F.col("c_length")) & (F.col("part") == F.col("c_part")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place"))
    slots = spark.createDataFrame(segments, SEGMENT_DDL)
    if len(segments) <= 1_000_000:
        slots = F.broadcast(slots)
    found = ranked.join(slots, (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return found.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("per")).cast("long")).alias("sequence_id"),
        (F.col("s_offset") + F.pmod(nth, F.col("per")) * F.col("length")).alias("offset"),
    )


def fill(docs: DataFrame, placed: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, as little-endian 32-bit ids.

    Needs ids of documents that are unique. Sequences gather at most capacity ids each.
    """
    path = vocabulary or tokens.vocabulary_path()
    where = placed.groupBy(F.col("doc_id").alias("p_id")).agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("own"))
    joined = docs.select(F.col(f"`{key}`").alias("d_id"), F.col(f"`{text}`").alias("text")).join(where, F.col("d_id").eqNullSafe(F.col("p_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.encoder(path).ids, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist(), strict=True):
                ids = encode(text) + end
                rows += [(p["sequence_id"], p["offset"], ids[4 * p["start"] : 4 * (p["start"] + p["length"])]) for p in own]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["sequence_id", "offset", "ids"])

    parts = joined.select("text", "own").mapInArrow(frugal(run), "sequence_id long, offset long, ids binary")
    joined_ids = F.aggregate(F.array_sort(F.collect_list(F.struct("offset", "ids"))), F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return parts.groupBy("sequence_id").agg(joined_ids.alias("ids"))
