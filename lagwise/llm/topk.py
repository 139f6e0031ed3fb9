"""Exact top-k by inner product: blocks by descending length, bounds on SVD-rotated partial sums."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwise.llm.scratch import Scratch

SCALE = 256
#: Vectors in a block of candidates and of queries, blocks that seed the thresholds.
BLOCK, QUERIES, SEEDS = 2048, 512, 2
#: Bytes of query vectors, as doubles, that all tasks get at once, and of candidates that a task should read.
CHUNK_BYTES, TASK_BYTES = 16 << 20, 32 << 20
#: Share of the rotated dimensions in the first partial sums.
LEADING = 0.5
#: Below EXACT, products of whole numbers are exact in doubles; beyond LARGE, bounds may overflow; relative slack of the bounds above rounding.
EXACT, LARGE, SLACK = 2.0**53, 1e300, 1e-9


def narrowest(x: np.ndarray) -> str:
    """The smallest of 2- and 4-byte integers and doubles that holds these whole numbers."""
    most = np.abs(x).max(initial=0)
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"


ROW_DDL = "id long, asks boolean, length double, kind string, vec binary"


def quantised(rows: DataFrame) -> DataFrame:
    """(id, values, asks) -> (id, asks, length, kind, vec): floor(256 x) of each component, in few bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("values")
            at = col.offsets.to_numpy().astype(np.int64)
            x = np.floor(col.flatten().to_numpy(zero_copy_only=False) * SCALE)
            at, size = at - at[0], np.diff(at)
            most = np.abs(x).max(initial=0) or 1.0
            length = most * np.sqrt(np.bincount(np.repeat(np.arange(len(size)), size), (x / most) ** 2, len(size)))
            kind = narrowest(x)
            data = x.astype(kind).tobytes()
            cuts = at * np.dtype(kind).itemsize
            vec = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("asks"), pa.array(length), pa.array([kind] * len(size)), vec], names=["id", "asks", "length", "kind", "vec"])

    return rows.select("id", "values", "asks").mapInArrow(run, ROW_DDL)


BLOCK_DDL = "block long, ids binary, vectors binary, kind string, dims int, longest double"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, length, kind, vec) of each partition, in their order, as blocks of at most `size` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, vs, longest = TaskContext.get().partitionId(), 0, [], [], 0.0

        def send() -> pa.RecordBatch:
            x = np.zeros((len(vs), max(len(v) for v in vs)))
            for i, v in enumerate(vs):
                x[i, : len(v)] = v
            kind = narrowest(x)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.float64())
            row = (part << 24 | number, np.array(ids, np.int64).tobytes(), x.astype(kind).tobytes(), kind, x.shape[1], longest)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["block", "ids", "vectors", "kind", "dims", "longest"])

        for batch in batches:
            for i, length, kind, vec in zip(batch.column("id").to_pylist(), batch.column("length").to_pylist(), batch.column("kind").to_pylist(), batch.column("vec"), strict=True):
                ids.append(i)
                vs.append(np.frombuffer(vec.as_py(), kind))
                longest = max(longest, length)
                if len(ids) == size:
                    yield send()
                    number, ids, vs, longest = number + 1, [], [], 0.0
        if ids:
            yield send()

    return rows.select("id", "length", "kind", "vec").mapInArrow(run, BLOCK_DDL)


def _matrix(vectors, kind: str, dims: int, n: int) -> np.ndarray:
    return np.frombuffer(vectors, kind).reshape(n, dims).astype(np.float64)


def rotation(packed: DataFrame) -> np.ndarray:
    """Right singular vectors of all candidates, from the sum of outer products (dims squared numbers).

    Any rotation gives right bounds, so vectors too long for their squares are left out of the sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0))
        for batch in batches:
            for ids, v, kind, d, longest in zip(*(batch.column(c) for c in ("ids", "vectors", "kind", "dims", "longest")), strict=True):
                d = d.as_py()
                if not longest.as_py() < LARGE**0.25:
                    continue
                x = _matrix(v.as_buffer(), kind.as_py(), d, len(ids.as_buffer()) // 8)
                if d > len(total):
                    total = np.pad(total, ((0, d - len(total)),) * 2)
                total[:d, :d] += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    cells = packed.select("ids", "vectors", "kind", "dims", "longest").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    d = int(cells[["i", "j"]].to_numpy().max(initial=0)) + 1
    gram = np.zeros((d, d))
    gram[cells["i"], cells["j"]] = cells["s"]
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


def products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, bound: float) -> np.ndarray:
    """Whole inner products of the pairs (i, j); beyond doubles' exact range by Python's integers, held to 64 bits."""
    if bound < EXACT:
        if len(i) > 0.05 * len(q) * len(x):
            return (q @ x.T)[i, j].astype(np.int64)
        return np.concatenate([np.einsum("ab,ab->a", q[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)]).astype(np.int64)
    out = [sum(int(a) * int(b) for a, b in zip(q[m], x[n], strict=True)) for m, n in zip(i.tolist(), j.tolist(), strict=True)]
    return np.array([max(-(1 << 63), min(v, (1 << 63) - 1)) for v in out], np.int64)


def lengths(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(initial=0) or 1.0
    return most * np.sqrt(((x / most) ** 2).sum(1))


class Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, turn: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        dims = max(q.shape[1], len(turn))
        self.turn = np.eye(dims)
        self.turn[: len(turn), : len(turn)] = turn
        self.q = np.pad(q, ((0, 0), (0, dims - q.shape[1])))
        with np.errstate(over="ignore", invalid="ignore"):  # such blocks are not bounded
            self.rotated, self.length = self.q @ self.turn, lengths(self.q)
            self.lead = max(1, int(dims * LEADING))
            self.rest = np.sqrt((self.rotated[:, self.lead :] ** 2).sum(1))
        self.scores = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.full = np.zeros(len(ids), np.int64)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor

    def least(self) -> np.ndarray:
        """What a candidate must reach to matter."""
        return np.maximum(self.floor, np.where(self.full >= self.k, self.scores[:, -1].astype(np.float64), -np.inf))

    def take(self, ids: np.ndarray, x: np.ndarray, longest: float) -> None:
        x = np.pad(x, ((0, 0), (0, self.q.shape[1] - x.shape[1])))
        top = float(self.length.max())
        if max(top, longest) < LARGE**0.25:
            need = self.least() - SLACK * (self.length * longest + 1)
            live = np.flatnonzero(self.length * longest >= need)  # Cauchy-Schwarz on the whole block
            if not len(live):
                return
            y = x @ self.turn
            rest = np.sqrt((y[:, self.lead :] ** 2).sum(1))
            bound = self.rotated[live, : self.lead] @ y[:, : self.lead].T + self.rest[live, None] * rest
            i, j = np.nonzero((bound >= need[live, None]) & (self.ids[live, None] != ids))
            i = live[i]
            score = products(self.q, x, i, j, top * longest)
        else:
            i, j = np.nonzero(self.ids[:, None] != ids)
            score = products(self.q, x, i, j, np.inf)
        all_i = np.concatenate((np.repeat(np.arange(len(self.ids)), self.full), i))
        old = np.arange(self.k) < self.full[:, None]
        all_s, all_c = np.concatenate((self.scores[old], score)), np.concatenate((self.found[old], ids[j]))
        order = np.lexsort((all_c, -1 - all_s, all_i))  # -1 - s does not overflow
        all_i, all_s, all_c = all_i[order], all_s[order], all_c[order]
        place = np.arange(len(all_i)) - np.searchsorted(all_i, all_i)
        keep = place < self.k
        self.scores[all_i[keep], place[keep]], self.found[all_i[keep], place[keep]] = all_s[keep], all_c[keep]
        self.full = np.bincount(all_i[keep], minlength=len(self.ids))

    def rows(self) -> pa.RecordBatch:
        held = np.arange(self.k) < self.full[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.full)), pa.array(self.found[held]), pa.array(self.scores[held])], names=["query_id", "vec_id", "score"])


def search(packed: DataFrame, chunk, turn: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): for each task's blocks, the best k of each query of the chunk that reach its floor.

    chunk: a broadcast list of (ids, vectors, floors). A task streams through its blocks, longest
    first, and holds the chunk and the best so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = []
        for batch in batches:
            for ids, v, kind, d, longest in zip(*(batch.column(c) for c in ("ids", "vectors", "kind", "dims", "longest")), strict=True):
                every = every or [Best(q_ids, q, turn, k, floors) for q_ids, q, floors in chunk.value]
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                x = _matrix(v.as_buffer(), kind.as_py(), d.as_py(), len(ids))
                for best in every:
                    best.take(ids, x, longest.as_py())
        yield from (best.rows() for best in every)

    return packed.select("ids", "vectors", "kind", "dims", "longest").mapInArrow(run, "query_id long, vec_id long, score long")


def _chunks(queries: DataFrame) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The query blocks (ids, vectors), some CHUNK_BYTES of them at a time."""
    sizes = queries.select("block", (F.length("ids") * F.col("dims")).alias("bytes")).orderBy("block").toPandas()
    names, held = [], 0
    for block, size in [*zip(sizes["block"].tolist(), sizes["bytes"].tolist(), strict=True), (None, CHUNK_BYTES + 1)]:
        if names and held + size > CHUNK_BYTES:
            rows = queries.filter(F.col("block").between(names[0], names[-1])).orderBy("block").collect()
            yield [(np.frombuffer(r["ids"], np.int64), _matrix(r["vectors"], r["kind"], r["dims"], len(r["ids"]) // 8)) for r in rows]
            names, held = [], 0
        names.append(block)
        held += size


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products of floor(256 x), ties to the smaller id.

    Candidates are all rows but those with the query's id. Vectors that are null, hold a null or a
    component whose 256-fold is not a finite double, or have a null id take no part; shorter ones
    count as filled up with 0, empty ones have product 0. Repeated rows are candidates of their
    own, and queries with one id share their k. Sums beyond 64 bits are held at the ends of the
    range. Other columns are ignored. Empty table: no rows; fewer than k candidates: all of them.

    Candidates are sorted once, by descending length, into blocks of 2- or 4-byte numbers. Queries
    come in chunks of a fixed size, which every task gets; only each task's best are shuffled, so
    what moves grows with the vectors and the answers, not with their pairs. The longest blocks
    give every query of a chunk a floor; blocks that no query can reach it with are not read (length
    times length), others are left out query by query, and then pair by pair: the leading rotated
    dimensions plus the product of the residual lengths.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.col(f"`{key}`").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * float(SCALE)) == float("inf")))
    rows = vectors.filter(fine).select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("values"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = scratch.save(quantised(rows), "rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("vec")), F.lit(0)).alias("bytes"), F.count_if("asks").alias("asked")).first()
    if not size["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cores = spark.sparkContext.defaultParallelism
    parts = max(-(-size["bytes"] // TASK_BYTES), min(2 * cores, -(-size["n"] // BLOCK)), 1)
    # Long vectors reach more queries, so lengths are dealt out in runs of a block's size.
    packed = scratch.save(blocks(rows.repartitionByRange(parts, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id"), BLOCK), "blocks")
    asked = rows.filter("asks").repartitionByRange(max(1, -(-size["asked"] // (8 * QUERIES))), F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    queries = scratch.save(blocks(asked, QUERIES), "queries")
    turn = rotation(packed)
    seeds = [r["block"] for r in packed.select("block", "longest").orderBy(F.desc("longest"), "block").limit(SEEDS).collect()]
    found = []
    for chunk in _chunks(queries):
        none = [(ids, q, np.full(len(ids), -np.inf)) for ids, q in chunk]
        sent = spark.sparkContext.broadcast(none)
        head = scratch.save(search(packed.filter(F.col("block").isin(seeds)), sent, turn, k), "head")
        ranked = head.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") == k)
        least = dict(ranked.select("query_id", "score").toPandas().itertuples(index=False, name=None))
        ready = [(ids, q, np.array([least.get(i, -np.inf) for i in ids.tolist()], np.float64)) for ids, q, _ in none]
        sent.destroy()
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = min(float(np.nan_to_num((floors - 1) / (lengths(q) * (1 + 2 * SLACK)), nan=-np.inf, posinf=np.inf, neginf=-np.inf).min()) for _, q, floors in ready)
        others = packed.filter(~F.col("block").isin(seeds))
        if np.isfinite(reach):
            others = others.filter(F.col("longest") >= reach)
        sent = spark.sparkContext.broadcast(ready)
        found += [head, scratch.save(search(others, sent, turn, k), "tail")]
        sent.destroy()
    both = reduce(DataFrame.unionByName, found)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
