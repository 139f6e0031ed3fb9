"""Near-duplicate documents: an exact Jaccard join on word shingles with PartEnum signatures.

Sets that share a signature (partenum) meet. They are first compared by sketches, half a byte for
each of about as many ranges of the hash as a set has elements: ranges whose sums differ are
spoiled, and more than H = (a + b)(1 - g)/(1 + g) spoiled ones settle it. Only what passes has its
elements compared: pairs are grouped into components by their names alone, and a set goes once to
the task that has its component. A task tells which sets its links connect, each set with the
smallest one, so that few rounds join the components of all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.components import connected_components
from lagwise.llm.partenum import Signer
from lagwise.llm.scratch import Scratch
from lagwise.llm.textbytes import WORDS, U, chunks, frugal, mix, shingle_sets

#: Groups up to this size are compared whole at once; of larger ones, each set with a few others first.
SMALL_GROUP = 8
#: A signature is common if one task sees it in COMMON_LOCAL sets and all tasks in COMMON_TOTAL; at
#: most COMMON_KEPT, the commonest, are sent to all tasks (16 bytes each).
COMMON_LOCAL, COMMON_TOTAL, COMMON_KEPT = 3, 4, 1_000_000
#: Bits of the table in which a task marks signatures it has met (a byte each); marks that coincide only
#: make a signature look more common.
MET_BITS = 24
#: Bytes of signatures that a task gathers before it sends them on; signatures of a row (14 bytes each), so that no
#: row takes half a region of an executor's heap; and of the rows that go out at once.
GATHER, ROW_SIGNATURES, SENT_SIGNATURES = 4 << 20, 1 << 14, 1 << 17
#: Signatures of a bucket (14 bytes each), about; slices in which a task takes a bucket; signatures of an element, about.
BUCKET_SIGNATURES, SLICES, PER_ELEMENT = 2_500_000, 4, 1.2
#: Bytes of sets, and pairs, that a task of the comparison should hold.
TASK_BYTES, TASK_PAIRS = 24 << 20, 20_000
#: Sets, and bytes of them, of a block of an open group; sets that meet another block at once, and common elements counted at once.
BLOCK, BLOCK_BYTES, ROWS, MEETINGS = 512, 2 << 20, 64, 1 << 19
#: Rows of a few numbers up to which they are sent to all tasks (some 100 bytes each in a hash table, 25 MB); beyond, a shuffled join.
SENT = 250_000
#: Steps of a size code for each doubling of the size.
CODE = 1024


def prints(sets: np.ndarray, at: np.ndarray, clash: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of each row's set, of an empty one 0, and a second one; names in clash give way to the second."""
    one, two = np.zeros(len(at) - 1, U), np.zeros(len(at) - 1, U)
    some = np.diff(at) > 0
    if some.any():
        n = np.diff(at)[some].astype(U)
        one[some] = mix(np.add.reduceat(mix(sets ^ U(0x5851F42D4C957F2D)), at[:-1][some]) + n)
        two[some] = mix(np.add.reduceat(mix(sets + U(0x2545F4914F6CDD1D)), at[:-1][some]) ^ n)
    one, two = one.view(np.int64), two.view(np.int64)
    return (one if clash is None or not len(clash) else np.where(np.isin(one, clash), two, one)), two


def sketches(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Each row's size (4 bytes), then half a byte per range of the hash: the sum of its elements' lowest bits.

    The ranges are the smallest power of two that is 0.4 times the size or more, 2 at least;
    neighbours added give the sketch with half as many.
    """
    size = np.diff(at)
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size, 1) * 0.4))).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(1 << bits)))
    row = np.repeat(np.arange(len(size)), size)
    where = begin[row] + (sets >> (U(64) - bits[row].astype(U))).astype(np.int64)
    out = np.zeros(begin[-1], np.uint8)
    if len(sets):
        heads = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        out[where[heads]] = np.add.reduceat(sets.astype(np.uint8) & 15, heads, dtype=np.uint8) & 15
    out = out[0::2] | out[1::2] << 4
    return [np.uint32(n).tobytes() + out[a:b].tobytes() for n, a, b in zip(size, begin[:-1] // 2, begin[1:] // 2, strict=True)]


def opened(sketch: bytes) -> tuple[int, np.ndarray]:
    """A sketch's size and its ranges, a byte each."""
    half = np.frombuffer(sketch, np.uint8, offset=4)
    out = np.empty(2 * len(half), np.uint8)
    out[0::2], out[1::2] = half & 15, half >> 4
    return int.from_bytes(sketch[:4], "little"), out


def folded(x: np.ndarray, width: int) -> np.ndarray:
    """Neighbours added until `width` are left: fewer spoiled ranges, never more."""
    return x if len(x) == width else x.reshape(width, -1).sum(1, dtype=np.uint8) & 15


def may_be_similar(u: tuple[int, np.ndarray], v: tuple[int, np.ndarray], c: Fraction) -> bool:
    """False only if two sets with these opened sketches differ in more than c times the sum of their sizes."""
    width = min(len(u[1]), len(v[1]))
    return np.count_nonzero(folded(u[1], width) != folded(v[1], width)) <= (u[0] + v[0]) * c.numerator // c.denominator


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in cols.values()], names=list(cols))


def keys(docs: DataFrame, size: int, similarity: Fraction) -> DataFrame:
    """Rows (doc_id, tag, n, fp, fp2, sketch) of all documents, and rows (sig, seen) of what a task saw often."""
    signer = Signer(similarity, None)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        met, again, times = np.zeros(1 << MET_BITS, bool), [], []
        id_type = None

        for batch in batches:
            id_type = batch.column("doc_id").type
            for a, data, offsets in chunks(batch.column("text")):
                sets, at = shingle_sets(data, offsets, size)
                n, (fp, fp2) = np.diff(at), prints(sets, at)
                none = pa.nulls(len(n), pa.int64())
                yield _batch(doc_id=batch.column("doc_id").slice(a, len(n)), tag=batch.column("tag").slice(a, len(n)), n=n.astype(np.int64), fp=fp, fp2=fp2, sketch=pa.array(sketches(sets, at), pa.binary()), sig=none, seen=none)
                fresh = [r for r, f in enumerate(fp.tolist()) if n[r] and f not in known and not known.add(f)]
                sig, _ = signer.emit(*_only(sets, at, np.array(fresh, np.int64)), every=True)
                sig, count = np.unique(sig, return_counts=True)
                where = (sig >> U(64 - MET_BITS)).astype(np.int64)
                more = met[where] | (count > 1)
                again.append(sig[more])
                times.append(count[more].astype(np.int32))
                met[where] = True
        if id_type is None:
            return
        sig, count = np.concatenate(again or [np.zeros(0, U)]), np.concatenate(times or [np.zeros(0, np.int32)])
        again.clear()
        times.clear()
        slices = (sig >> U(60)).astype(np.uint8)
        for part in range(16):
            own, where = np.unique(sig[slices == part], return_inverse=True)
            seen = 1 + np.bincount(where, count[slices == part], len(own)).astype(np.int64)
            often = seen >= COMMON_LOCAL
            k = int(often.sum())
            if k:
                none = pa.nulls(k, pa.int64())
                yield _batch(doc_id=pa.nulls(k, id_type), tag=none, n=none, fp=none, fp2=none, sketch=pa.nulls(k, pa.binary()), sig=own[often].view(np.int64), seen=seen[often])

    return docs.select("doc_id", "tag", "text").mapInArrow(frugal(run), f"doc_id {kind}, tag long, n long, fp long, fp2 long, sketch binary, sig long, seen long")


def _only(sets: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = at[rows + 1] - at[rows]
    to = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    return sets[np.arange(to[-1]) + np.repeat(at[rows] - to[:-1], size)], to


def size_codes(n: np.ndarray) -> np.ndarray:
    """Two bytes that tell a set's size to a part in 1,477, rounded down; larger sets never have smaller codes."""
    return np.floor(np.log2(np.maximum(n, 1)) * CODE).astype(np.uint16)


def dealt(docs: DataFrame, size: int, similarity: Fraction, common, clash: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, sigs, sizes, fps): signatures of a task's documents for one bucket; copies in a task count once.

    A signature takes 14 bytes however many buckets there are: 4 of its own beside those that chose
    the bucket (two that coincide only make more to compare), its set's size code and its set's name.
    """
    signer_of = lambda: Signer(similarity, common.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, known = signer_of(), set()
        sigs, fps, codes, held = [], [], [], 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal held
            sig, fp, code = (np.concatenate(x) for x in (sigs, fps, codes))
            for x in (sigs, fps, codes):
                x.clear()
            held = 0
            bucket = (sig % U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            own, fp, code, bucket = (sig[order] >> U(32)).astype("<u4"), fp[order], code[order], bucket[order]
            new = np.flatnonzero(np.diff(bucket, prepend=bucket[:1])) if len(bucket) else np.zeros(0, np.int64)
            heads = np.concatenate(([0], new))
            # A bucket's signatures start new rows every ROW_SIGNATURES.
            cut = np.concatenate([np.arange(a, b, ROW_SIGNATURES) for a, b in zip(heads, np.append(new, len(own)), strict=True)] + [[len(own)]]).astype(np.int64)
            i = 0
            while i < len(cut) - 1:
                j = max(i + 1, int(np.searchsorted(cut, cut[i] + SENT_SIGNATURES, "right")) - 1)
                rows = [slice(a, b) for a, b in zip(cut[i:j], cut[i + 1 : j + 1], strict=True)]
                yield _batch(bucket=bucket[cut[i:j]].astype(np.int32), **{k: pa.array([x[r].tobytes() for r in rows], pa.binary()) for k, x in (("sigs", own), ("sizes", code), ("fps", fp))})
                i = j

        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                sets, at = shingle_sets(data, offsets, size)
                n, fp = np.diff(at), prints(sets, at, clash)[0]
                fresh = np.array([r for r, f in enumerate(fp.tolist()) if n[r] and f not in known and not known.add(f)], np.int64)
                sig, owner = signer.emit(*_only(sets, at, fresh))
                sigs.append(sig)
                fps.append(fp[fresh][owner])
                codes.append(size_codes(n[fresh])[owner])
                held += sig.nbytes
                if held >= GATHER:
                    yield from send()
        if sigs:
            yield from send()

    return docs.select("text").mapInArrow(frugal(run), "bucket int, sigs binary, sizes binary, fps binary")


def candidates(blobs: DataFrame, similarity: Fraction) -> DataFrame:
    """(a, b, lead, gid, fp, shared): pairs to compare, and the members of large groups (gid set).

    Groups of one signature up to SMALL_GROUP sets give all their pairs. Of larger ones only the members
    are told, by the group's smallest set, with how many signatures of a slice they share there.
    """
    apart = int(np.ceil(CODE * np.log2(similarity.denominator / similarity.numerator))) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each column of a bucket grows in one place, so that it is never held twice.
        told: dict[int, tuple[bytearray, bytearray, bytearray]] = {}
        for batch in batches:
            for bucket, *own in zip(batch.column("bucket").to_pylist(), *(batch.column(k) for k in ("sigs", "fps", "sizes")), strict=True):
                for held, x in zip(told.setdefault(bucket, (bytearray(), bytearray(), bytearray())), own, strict=True):
                    held += x.as_buffer()
        for bucket in list(told):
            sig, fp, n = (np.frombuffer(x, kind) for x, kind in zip(told.pop(bucket), ("<u4", np.int64, np.uint16), strict=True))
            slices = (sig >> np.uint32(28)).astype(np.uint8) % SLICES
            for part in range(SLICES):
                some = np.flatnonzero(slices == part)
                if len(some):
                    yield from meet(sig[some], fp[some], n[some].astype(np.int64))

    def meet(sig: np.ndarray, fp: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        same = np.zeros(len(sig) + 1, bool)
        same[1:-1] = sig[1:] == sig[:-1]
        some = same[1:] | same[:-1]
        sig, order = sig[some], order[some]
        fp, n = fp[order], n[order]
        order = np.lexsort((fp, n, sig))
        sig, fp, n = sig[order], fp[order], n[order]
        one = np.ones(len(sig), bool)
        one[1:] = (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])
        sig, fp, n = sig[one], fp[one], n[one]
        heads = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
        count = np.diff(np.append(heads, len(sig)))
        many = np.repeat(count, count)
        head = np.repeat(heads, count)
        if not len(heads):
            return
        lead = np.repeat(np.minimum.reduceat(fp, heads), count)
        left, right = [], []
        for d in range(1, SMALL_GROUP):
            i = np.flatnonzero((np.arange(len(sig)) + d < head + many) & (many <= SMALL_GROUP))
            left.append(i)
            right.append(i + d)
        i, j = np.concatenate(left), np.concatenate(right)
        ok = (n[i] >= n[j] - apart) & (fp[i] != fp[j])
        i, j = i[ok], j[ok]
        pairs = np.unique(np.rec.fromarrays([np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j]), lead[i]], names="a,b,lead"))
        none = lambda k: pa.nulls(k, pa.int64())
        k = len(pairs)
        yield _batch(a=np.ascontiguousarray(pairs.a), b=np.ascontiguousarray(pairs.b), lead=np.ascontiguousarray(pairs.lead), gid=none(k), fp=none(k), shared=none(k))
        # Large groups meet again by their smallest set: those of one cluster mostly share it, and so
        # a set goes there once and not with every signature.
        large = many > SMALL_GROUP
        own, shared = np.unique(np.rec.fromarrays([lead[large], fp[large]], names="gid,fp"), return_counts=True)
        k = len(own)
        yield _batch(a=none(k), b=none(k), lead=none(k), gid=np.ascontiguousarray(own.gid), fp=np.ascontiguousarray(own.fp), shared=shared.astype(np.int64))

    return blobs.mapInArrow(frugal(run), "a long, b long, lead long, gid long, fp long, shared long")


def along(groups: DataFrame, key: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b, lead) that connect most of what is similar in large groups (gid, fp, shared).

    However many groups a set is in, it gives three pairs at most: with the smallest sets of the two
    groups with which it shares most signatures, and with the next one by size in the first of them.
    What that leaves open is settled later.
    """
    best = groups.groupBy("fp").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("s"), "gid"))), 1, 2).alias("best"))
    best = scratch.save(best.select("fp", F.col("best")[0]["gid"].alias("gid"), F.get("best", F.lit(1))["gid"].alias("other")), "best")
    rows = best.join(key.select("fp", "n"), "fp").select("gid", "n", "fp").repartitionByRange("gid", "n", "fp").sortWithinPartitions("gid", "n", "fp")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((2, 0), np.int64)
        for batch in batches:
            gid, fp = np.concatenate((last, [batch.column(c).to_numpy() for c in ("gid", "fp")]), axis=1)
            last = np.array([gid[-1:], fp[-1:]])
            i = np.flatnonzero(gid[1:] == gid[:-1])
            yield _batch(a=fp[i], b=fp[i + 1], lead=gid[i])

    out = rows.mapInArrow(neighbours, "a long, b long, lead long")
    for c in ("gid", "other"):
        out = out.unionByName(best.filter(F.col(c) != F.col("fp")).select(F.col("fp").alias("a"), F.col(c).alias("b"), F.col(c).alias("lead")))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "lead")


def _placed(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(a, b, bucket) of pairs (a, b, lead), (fp, rep, bucket) of what each bucket needs, and the buckets.

    sets: (fp, rep, bytes). The pairs of a lead share a bucket, and sets that share leads rarely
    move twice. A lead with more pairs, or bytes of sets, than a task should hold is cut by a hash
    of both ends, so a hub is cut as well.
    """
    need = pairs.select("lead", F.explode(F.array("a", "b")).alias("fp")).distinct().join(sets, "fp")
    need = scratch.save(need, "sets")
    load = need.groupBy("lead").agg(F.sum("bytes").alias("bytes")).join(pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("n")), "lead")
    load = load.select("lead", "bytes", F.ceil(F.greatest(F.col("bytes") / F.lit(float(TASK_BYTES)), F.col("n") / F.lit(float(TASK_PAIRS)))).cast("long").alias("cuts"))
    load = scratch.save(load, "load")
    total = load.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n"), F.coalesce(F.max("cuts"), F.lit(1)).alias("cuts")).first()
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    buckets = int(max(1, -(-2 * total["bytes"] // TASK_BYTES), min(total["n"] + total["cuts"] - 1, 2 * cores)))
    # Leads without a cut are told by their name alone; the cut ones' buckets have to be found for their sets.
    place = lambda lead, cut: F.pmod(F.xxhash64(lead, cut), F.lit(buckets)).cast("int")
    placed = pairs.join(load.select("lead", "cuts"), "lead")
    placed = placed.select("a", "b", "lead", "cuts", place(F.col("lead"), F.pmod(F.xxhash64("a", "b"), F.col("cuts"))).alias("bucket"))
    placed = scratch.save(placed, "placed")
    whole = need.join(load.filter("cuts = 1").select("lead"), "lead").select("fp", "rep", place(F.col("lead"), F.lit(0).cast("long")).alias("bucket"))
    if total["cuts"] > 1:
        cut = placed.filter("cuts > 1").select(F.explode(F.array("a", "b")).alias("fp"), "bucket").distinct().join(sets.select("fp", "rep"), "fp")
        whole = whole.unionByName(cut.select("fp", "rep", "bucket"))
    return placed.select("a", "b", "bucket"), whole.distinct(), buckets


def _sent(df: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The written table, marked to be sent to all tasks if it is small enough."""
    df = scratch.save(df, name)
    return F.broadcast(df) if df.count() <= SENT else df


def _compared(held: DataFrame, placed: DataFrame, buckets: int, read, same, spanning: bool) -> DataFrame:
    """The pairs (a, b, lead) of placed that same(x, y) accepts; lead is the smallest set that they reach in their bucket.

    spanning: each set with its lead instead, and no comparison of what is connected already.
    held: (bucket, fp, body). A bucket's sets come first, once each, then its pairs.
    """
    held = held.select("bucket", F.lit(None).cast("long").alias("a"), F.col("fp").alias("b"), "body")
    asked = placed.select("bucket", "a", "b", F.lit(None).cast("binary").alias("body"))
    rows = held.unionByName(asked).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", F.col("body").isNull(), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, root, found = None, {}, {}, []

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        def ended() -> pa.RecordBatch:
            out = [(find(x), x, find(x)) for x in root if find(x) != x] if spanning else [(a, b, find(a)) for a, b in found]
            return _batch(**{k: pa.array([x[i] for x in out], pa.int64()) for i, k in enumerate(("a", "b", "lead"))})

        for batch in batches:
            for bucket, a, b, body in zip(batch.column("bucket").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("body"), strict=True):
                if bucket != now:
                    if root:
                        yield ended()
                    now, sets, root, found = bucket, {}, {}, []
                if a is None:
                    if b not in sets:
                        sets[b] = read(body.as_py())
                    continue
                if spanning and find(a) == find(b):
                    continue
                if same(sets[a], sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
                    if not spanning:
                        found.append((a, b))
        yield ended()

    return rows.mapInArrow(frugal(run), "a long, b long, lead long")


def verified(pairs: DataFrame, key: DataFrame, docs: DataFrame, size: int, similarity: Fraction, clash: np.ndarray, scratch: Scratch) -> DataFrame:
    """Of pairs (a, b, lead) links (a, b) that span what the similar ones connect: sketches, then elements.

    key: (fp, rep, n, sketch), a row for each set; rep is the tag of one row of docs that has it.
    """
    p, q, c = similarity.numerator, similarity.denominator, (1 - similarity) / (1 + similarity)
    pairs = scratch.save(pairs, "pairs")
    placed, need, buckets = _placed(pairs, key.select("fp", "rep", F.length("sketch").alias("bytes")), scratch)
    held = key.select("fp", F.col("sketch").alias("body")).join(_sent(need, scratch, "need"), "fp")
    passed = scratch.save(_compared(held, placed, buckets, opened, lambda u, v: may_be_similar(u, v, c), False), "passed")
    # What passed is mostly similar: components are small, and those of a bucket have their sets once.
    placed, need, buckets = _placed(passed, key.select("fp", "rep", (F.col("n") * 8).alias("bytes")), scratch)
    need = need.groupBy("rep").agg(F.collect_set("bucket").alias("buckets"))
    texts = docs.join(_sent(need, scratch, "need"), F.col("tag") == F.col("rep")).select("buckets", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch.column("buckets")
            for a, data, offsets in chunks(batch.column("text")):
                sets, at = shingle_sets(data, offsets, size)
                fp = prints(sets, at, clash)[0].tolist()
                rows = [(b, f, sets[at[r] : at[r + 1]].tobytes()) for r, f in enumerate(fp) for b in buckets[a + r].as_py()]
                yield _batch(bucket=pa.array([x[0] for x in rows], pa.int32()), fp=pa.array([x[1] for x in rows], pa.int64()), body=pa.array([x[2] for x in rows], pa.binary()))

    def similar(u: np.ndarray, v: np.ndarray) -> bool:
        either = len(np.union1d(u, v))
        return (len(u) + len(v) - either) * q >= p * either

    return _compared(texts.mapInArrow(frugal(sets_of), "bucket int, fp long, body binary"), placed, buckets, lambda x: np.frombuffer(x, U), similar, True)


def open_pairs(groups: DataFrame, labels: DataFrame, key: DataFrame, docs: DataFrame, size: int, similarity: Fraction, clash: np.ndarray, exact: bool, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) that may join what no link connects yet among the members of large groups (gid, fp).

    A group all of whose members are connected has none to give. The members of the others meet in a
    task with their elements, cut to 4 bytes unless exact, so that a pair may only seem more similar
    than it is: a small group as a whole, a larger one in blocks, by classes of size of which only
    neighbours can link. A task counts common elements by an index, and lets out no more pairs than
    connect what is apart. So few rows leave, however large a group is and however close its members are.
    """
    p, q = similarity.numerator, similarity.denominator
    kind, width = ("<u8", 8) if exact else ("<u4", 4)
    member = groups.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    apart = member.groupBy("gid").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("gid")
    member = scratch.save(member.join(apart, "gid").join(key.select("fp", "rep", "n"), "fp"), "members")
    texts = docs.join(_sent(member.select("rep").distinct(), scratch, "reps"), F.col("tag") == F.col("rep")).select("text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                sets, at = shingle_sets(data, offsets, size)
                own, fp = sets if exact else (sets >> U(32)).astype(kind), prints(sets, at, clash)[0]
                fresh = [r for r, f in enumerate(fp.tolist()) if f not in known and not known.add(f)]
                yield _batch(fp=fp[fresh], body=pa.array([own[at[r] : at[r + 1]].tobytes() for r in fresh], pa.binary()))

    # Rows that repeat an id may give a set once a task; that it stands twice in a block does no harm.
    bodies = scratch.save(texts.mapInArrow(frugal(sets_of), "fp long, body binary"), "bodies")
    n, load = F.count(F.lit(1)), F.sum("n") * width
    step = max(0.01, 1.0001 * float(np.log(q / p)))
    small = member.groupBy("gid").agg(((n <= BLOCK) & (load <= BLOCK_BYTES)).alias("small"))
    cls = F.when(F.col("small"), F.lit(0)).otherwise(F.floor(F.log("n") / F.lit(step)) + 1).cast("long")
    member = member.join(small, "gid").withColumn("cls", cls).drop("small")
    blocks = member.groupBy("gid", "cls").agg(F.ceil(F.greatest(n / F.lit(float(BLOCK)), load / F.lit(float(BLOCK_BYTES)))).cast("long").alias("blocks"))
    blocks = scratch.save(blocks, "classes")
    packed = member.join(blocks, ["gid", "cls"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks"))).join(bodies, "fp")
    packed = scratch.save(packed.groupBy("gid", "cls", "block", "blocks").agg(F.collect_list(F.struct("fp", "root", "body")).alias("own")), "blocks")
    large = packed.filter("cls > 0")
    above = blocks.filter("cls > 0").select("gid", (F.col("cls") - 1).alias("cls"), F.col("blocks").alias("more"))
    beside = large.filter("block < blocks - 1").select("gid", "own", F.col("cls").alias("cls2"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block2"))
    next_up = large.join(above, ["gid", "cls"]).select("gid", "own", (F.col("cls") + 1).alias("cls2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("more") - 1)).alias("block2"))
    other = large.select("gid", F.col("cls").alias("cls2"), F.col("block").alias("block2"), F.col("own").alias("own2"))
    across = beside.unionByName(next_up).join(other, ["gid", "cls2", "block2"]).select("own", "own2")
    meet = packed.select("own", F.lit(None).cast(packed.schema["own"].dataType).alias("own2")).unionByName(across)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, own2 in zip(batch.column("own"), batch.column("own2"), strict=True):
                (fp, root, sets), (fp2, root2, sets2) = ((x.values.field(0).to_numpy(), x.values.field(1).to_numpy(), [np.frombuffer(y.as_buffer(), kind) for y in x.values.field(2)]) for x in (own, own2 if own2.is_valid else own))
                left, right, above = [], [], {}

                def find(x: int, above: dict[int, int] = above) -> int:
                    while above.setdefault(x, x) != x:
                        above[x] = x = above[above[x]]
                    return x

                for i, j in _similar_pairs(sets, sets2, p, q):
                    some = root[i] != root2[j]
                    for a, b in zip(i[some].tolist(), j[some].tolist(), strict=True):
                        x, y = find(int(root[a])), find(int(root2[b]))
                        if x != y:
                            above[max(x, y)] = min(x, y)
                            left.append(int(fp[a]))
                            right.append(int(fp2[b]))
                yield _batch(a=pa.array(left, pa.int64()), b=pa.array(right, pa.int64()))

    return meet.mapInArrow(frugal(run), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar_pairs(sets: list[np.ndarray], others: list[np.ndarray], p: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the similar ones among all pairs of two blocks, from counts of their common elements."""
    size, size2 = np.array([len(x) for x in sets]), np.array([len(x) for x in others])
    held = np.concatenate(others)
    order = np.argsort(held, kind="stable")
    held, owner = held[order], np.repeat(np.arange(len(others)), size2)[order]
    for a in range(0, len(sets), ROWS):
        some = np.arange(a, min(a + ROWS, len(sets)))
        both = np.zeros(len(some) * len(others), np.int64)
        x, row = np.concatenate(sets[a : a + ROWS]), np.repeat(np.arange(len(some)), size[some])
        low, high = np.searchsorted(held, x), np.searchsorted(held, x, "right")
        met = np.cumsum(high - low)
        begin = 0
        while begin < len(x):  # a slice's meetings are at most MEETINGS, or one element's
            end = max(begin + 1, int(np.searchsorted(met, (met[begin - 1] if begin else 0) + MEETINGS, "right")))
            n = high[begin:end] - low[begin:end]
            at = np.arange(n.sum()) + np.repeat(low[begin:end] - (np.cumsum(n) - n), n)
            both += np.bincount(np.repeat(row[begin:end], n) * len(others) + owner[at], minlength=len(both))
            begin = end
        both = both.reshape(len(some), -1)
        i, j = np.nonzero(both * q >= p * (size[some][:, None] + size2 - both))
        yield some[i], j


def near_duplicates(docs: DataFrame, similarity: Fraction = Fraction(75, 100), size: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Words are runs of anything but ASCII white space, A-Z as a-z; a set holds the distinct runs of
    `size` words, or all words as one run where there are fewer. Two rows link if |A n B| >=
    similarity * |A u B|. A null, empty or blank text has no set and links with nothing (its
    component is its own id). Equal sets are one node from the start, so copies cost nothing;
    repeated rows and repeated ids each get their row. Ids may be of any type with an order; a null
    id has a null id, and a component of null ids only is null. Very long texts are taken whole.
    Sets are compared element by element, as 64-bit hashes, and told apart by two 64-bit names.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{key}`")).alias("tag"))
    first = scratch.save(keys(docs, size, similarity), "keys")
    rows = first.filter("n is not null")
    often = first.filter("sig is not null").groupBy("sig").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= COMMON_TOTAL)
    top = often.orderBy(F.desc("seen"), "sig").limit(COMMON_KEPT).toPandas()
    sig = top["sig"].to_numpy(np.int64).view(U)
    order = np.argsort(sig)
    level = np.minimum(255, np.log2(np.maximum(top["seen"].to_numpy(np.float64), 1)) * 4).astype(np.int64)
    common = spark.sparkContext.broadcast((sig[order], level[order]))
    some = rows.filter("n > 0")
    # Names that two different sets share: none is expected below some billion sets.
    clash = some.groupBy("fp").agg(F.min("fp2").alias("x"), F.max("fp2").alias("y"), F.count(F.lit(1)).alias("m"), F.min("tag").alias("rep"), F.first("n").alias("n"))
    reps = scratch.save(clash, "sets")
    clash = np.array([r["fp"] for r in reps.filter("x != y").select("fp").collect()], np.int64)
    if len(clash):
        # Their rows go by the second name.
        rows = scratch.save(rows.withColumn("fp", F.when(F.col("fp").isin(clash.tolist()), F.col("fp2")).otherwise(F.col("fp"))), "renamed")
        some = rows.filter("n > 0")
        reps = scratch.save(some.groupBy("fp").agg(F.count(F.lit(1)).alias("m"), F.min("tag").alias("rep"), F.first("n").alias("n")), "sets")
    elements = reps.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    buckets = int(max(2 * spark.sparkContext.defaultParallelism, -(-elements * PER_ELEMENT // BUCKET_SIGNATURES)))
    blobs = dealt(docs, size, similarity, common, clash, buckets).repartitionById(buckets, F.col("bucket"))
    found = scratch.save(candidates(blobs, similarity), "candidates")
    common.destroy()
    key_rows = scratch.save(_of_each_set(some, found, scratch), "sketches")
    groups = scratch.save(found.filter("gid is not null").groupBy("gid", "fp").agg(F.sum("shared").alias("shared")), "groups")
    some_large = groups.limit(1).count() > 0
    pairs = found.filter("gid is null").select("a", "b", "lead")
    if some_large:
        pairs = pairs.unionByName(along(groups, key_rows, scratch))
    pairs = pairs.groupBy("a", "b").agg(F.min("lead").alias("lead"))
    links = scratch.save(verified(pairs, key_rows, docs, size, similarity, clash, scratch), "links")
    labels = connected_components(links.select("a", "b"), scratch)
    if some_large:
        groups = groups.select("gid", "fp")
        for exact in (False, True):
            more = scratch.save(open_pairs(groups, labels, key_rows, docs, size, similarity, clash, exact, scratch), "open")
            if not more.limit(1).count():
                break
            again = more if exact else scratch.save(verified(more.withColumn("lead", F.col("a")), key_rows, docs, size, similarity, clash, scratch), "again")
            links = scratch.save(links.select("a", "b").unionByName(again.select("a", "b")), "links")
            labels = connected_components(links, scratch)
            # A pair that connected others and then did not link may have hidden one that does: then once more, exactly.
            root = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}"))  # noqa: E731, B023
            ends = more.join(root("a"), "a", "left").join(root("b"), "b", "left")
            if not ends.filter("r_a is null or r_b is null or r_a != r_b").limit(1).count():
                break
    # Only sets that copies or links have can share a component with another row.
    placed = rows.select("doc_id", "n", "fp").join(_sent(labels.select("node", "root"), scratch, "labels"), F.col("fp") == F.col("node"), "left")
    placed = placed.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "fp")).alias("root"))
    least = placed.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("root").alias("l_root"), "least")
    out = placed.join(_sent(least, scratch, "least"), F.col("root") == F.col("l_root"), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("l_root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    scratch.sweep(out)
    return out


def _of_each_set(rows: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, rep, n, sketch) of the sets that are in a pair or a group, from one of the rows that have them."""
    ends = found.select(F.explode(F.array("a", "b", "fp")).alias("w")).filter("w is not null").distinct()
    met = rows.select("fp", "tag", "n", "sketch").join(_sent(ends, scratch, "met"), F.col("fp") == F.col("w"), "left_semi")
    return met.groupBy("fp").agg(F.min(F.struct("tag", "n", "sketch")).alias("r")).select("fp", F.col("r.tag").alias("rep"), "r.n", "r.sketch")


def drop_near_duplicates(docs: DataFrame, similarity: Fraction = Fraction(75, 100), size: int = WORDS) -> DataFrame:
    """The rows of documents less all but one of each group of near-duplicates: the smallest doc_id stays.

    Rows are told apart by their id and two 64-bit hashes of all they hold, so repeated or null ids
    do no harm (a null id is the smallest); of fully repeated rows one stays. Rows whose text has
    no words are in no group and stay. An empty table gives no rows; other columns stay as they are,
    whatever their names. Rows that go are sent to all tasks while they are few; texts move beyond.
    """
    scratch = Scratch(docs.sparkSession, "deduplicate")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(F.col("doc_id").alias("d"), F.xxhash64(*cols).alias("h"), F.xxhash64(F.lit("again"), *reversed(cols)).alias("g"))
    found = near_duplicates(docs.select(row.alias("row"), "text"), similarity, size, key="row").filter("n_shingles > 0")
    found = scratch.save(found.groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("first"), F.count(F.lit(1)).alias("m")), "found")
    gone = found.filter("row != first").select("row.d", "row.h", "row.g")
    whole = docs.select(F.struct(*cols).alias("__whole"), row.alias("__row"))
    on = lambda t: F.col("__row.d").eqNullSafe(F.col("d")) & (F.col("__row.h") == F.col("h")) & (F.col("__row.g") == F.col("g"))
    left = whole.join(_sent(gone, scratch, "gone"), on("gone"), "left_anti")
    again = found.filter("row = first and m > 1").select("row.d", "row.h", "row.g")
    if again.limit(1).count():
        again = _sent(again, scratch, "again")
        left = left.join(again, on("again"), "left_anti").unionByName(left.join(again, on("again"), "left_semi").dropDuplicates(["__row"]))
    return left.select(*(F.col(f"__whole.`{c}`") for c in docs.columns))
