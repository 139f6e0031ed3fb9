"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.llm.scratch import Scratch
from lagwise.llm.textbytes import U, chunks, frugal, spans, word_hashes

#: Bits of a term's bucket, terms that are taken for what they tell alone, factors, bytes of a word's beginning that are a term too.
BITS, TERMS, FACTORS, STEM = 20, 768, 8, 5
#: Labelled rows that it learns from, at most: those first by a hash of the id.
SAMPLE = 24_000
#: Texts that a term, or a pair of terms, must be in.
LEAST_TEXTS, LEAST_PAIR = 5, 12
#: Pairs that are taken for what they tell together, and standard errors by which their rate must leave that of both terms.
PAIRS, PAIR_Z = 128, 6.0
#: For pairs: sampled texts with up to PAIR_TERMS terms, as many as give PAIR_WORK meetings; share of them that a candidate is in at most.
PAIR_TERMS, PAIR_WORK, PAIR_SHARE = 192, 120_000_000, 0.6
THRESHOLD = 0.3
#: Everything in ASCII but letters and digits parts words here.
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every word, and of the first STEM bytes of every longer word."""
    begins, ends, first = spans(data, offsets, APART)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    long = np.flatnonzero(ends - begins > STEM)
    words = word_hashes(data, begins, ends)
    stems = word_hashes(data, begins[long], begins[long] + STEM) ^ U(0x5DEECE66D)
    return np.concatenate((row, row[long])), (np.concatenate((words, stems)) >> U(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class Machine:
    """sigmoid(bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 where a text has term i."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -60, 60)))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.bias + x @ self.weights + ((x @ self.factors) ** 2 - (x * x) @ self.factors**2).sum(1) / 2


def fit(x: np.ndarray, y: np.ndarray, terms: np.ndarray, pairs: np.ndarray | None = None, epochs: int = 25, rate: float = 0.02, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Logistic loss by Adam over shuffled batches; the same rows give the same machine.

    pairs: rows (i, j, sign) of columns that begin with a factor in common, as strongly as singles are learned.
    """
    rng = np.random.default_rng(seed)
    n, f = x.shape
    base = (y.sum() + 0.5) / (n + 5)
    p = [np.array([np.log(base / (1 - base))]), np.zeros(f), rng.normal(0, 0.02, (f, FACTORS))]
    for r, (i, j, sign) in enumerate(pairs if pairs is not None else ()):
        p[2][i, r % FACTORS] += 0.5
        p[2][j, r % FACTORS] += 0.5 * sign
    m, s, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs if f else 0):
        order = rng.permutation(n)
        for a in range(0, n, 256):
            xb, yb = x[order[a : a + 256]].astype(np.float64), y[order[a : a + 256]]
            xv = xb @ p[2]
            g = Machine(terms, p[0][0], p[1], p[2]).score(xb) - yb
            g /= len(g)
            grads = [np.array([g.sum()]), xb.T @ g + decay * p[1], xb.T @ (g[:, None] * xv) - (xb * xb).T @ g[:, None] * p[2] + decay * p[2]]
            t += 1
            step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for i, d in enumerate(grads):
                m[i] += 0.1 * (d - m[i])
                s[i] += 0.001 * (d * d - s[i])
                p[i] = p[i] - step * m[i] / (np.sqrt(s[i]) + 1e-8)
    return Machine(terms, float(p[0][0]), p[1], p[2])


def telling_terms(term: np.ndarray, a: np.ndarray, b: np.ndarray, n: float, pos: float) -> np.ndarray:
    """Of terms in a of n texts, b of the pos labelled 1: the TERMS with the largest chi-square, ascending."""
    with np.errstate(divide="ignore", invalid="ignore"):
        # 2 x 2 table of term and label: chi-square = n (b n - a pos)^2 / (a (n - a) pos (n - pos)).
        chi = n * (b * n - a * pos) ** 2 / (a * (n - a) * pos * (n - pos))
    found = np.flatnonzero((a >= LEAST_TEXTS) & np.isfinite(chi))
    return np.sort(term[found[np.lexsort((term[found], -chi[found]))][:TERMS]])


def telling_pairs(idx: np.ndarray, at: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, bucket, sign) of pairs whose label rate is beyond that of either term, the most telling first.

    All pairs of candidate terms are counted, whatever the terms tell alone: a pair's rate is set
    against the higher rate of its two terms (sign 1), or the lower one (-1).
    """
    n = len(y)
    df = np.bincount(idx, minlength=1 << BITS)
    own = np.full(1 << BITS, -1)
    names = np.flatnonzero((df >= LEAST_PAIR) & (df <= PAIR_SHARE * n))
    own[names] = np.arange(len(names))
    keep = own[idx] >= 0
    begin = np.concatenate(([0], np.cumsum(keep)))[at]
    term, size = own[idx[keep]], np.diff(begin)
    rows = np.flatnonzero((size > 1) & (size <= PAIR_TERMS))
    rows = rows[: np.searchsorted(np.cumsum(size[rows].astype(np.int64) ** 2), PAIR_WORK) + 1]
    if not len(rows):
        return []
    row = np.repeat(rows, size[rows])
    place = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows.tolist()])
    order = np.argsort(term[place], kind="stable")
    place, row = place[order], row[order]
    end, y = begin[row + 1], y.astype(np.float64)
    a1, b1 = np.bincount(term[place], minlength=len(names)), np.bincount(term[place], y[row], len(names))
    base = y[rows].mean()
    rate = (b1 + base) / (a1 + 1)
    heads = np.searchsorted(term[place], np.arange(len(names) + 1))
    found = []
    for i in np.flatnonzero(np.diff(heads) >= LEAST_PAIR).tolist():
        s = slice(heads[i], heads[i + 1])
        left = end[s] - place[s] - 1
        run = np.concatenate(([0], np.cumsum(left)))
        other = term[np.arange(run[-1]) + np.repeat(place[s] + 1 - run[:-1], left)]
        a = np.bincount(other, minlength=len(names))
        b = np.bincount(other, np.repeat(y[row[s]], left), len(names))
        j = np.flatnonzero(a >= LEAST_PAIR)
        high, low = np.maximum(rate[i], rate[j]), np.minimum(rate[i], rate[j])
        up, down = ((b[j] - a[j] * r) / np.sqrt(np.maximum(a[j] * r * (1 - r), 0.25)) for r in (high, low))
        for z, sign in ((up, 1), (-down, -1)):
            found += [(-float(z[k]), int(names[i]), int(names[j[k]]), sign) for k in np.flatnonzero(z >= PAIR_Z).tolist()]
    return [x[1:] for x in sorted(found)[:PAIRS]]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Machine:
    """The machine for the labelled rows: at most `sample` of them, first by a hash of the id.

    Every one of the 2^20 buckets is weighed: alone by grouped counts over the sample's whole texts,
    and in pairs over the sample's texts of up to PAIR_TERMS terms, as longer ones say little about
    any one pair. The machine sees the TERMS with the largest chi-square against the label, and the
    terms of up to PAIRS pairs that tell what neither of their terms does. The driver gets the counts
    of the buckets, the terms of those short texts (18 MB at most), and which of the machine's terms
    each sampled text has.

    Several labels of an id: the highest; null labels and ids are left out. Several texts of an id
    are learned from each on its own. Ties, of chi-square or z, go to the smaller bucket. Null and
    empty texts have no terms. Repeated rows count as often as they come. Other columns are ignored,
    whatever their names. No labels: a machine with no terms, whose score is 0.1.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    own = labels.select(F.col(f"`{key}`").alias("l_id"), F.col(f"`{label}`").cast("int").alias("y")).filter("l_id is not null and y is not null").groupBy("l_id").agg(F.max("y").alias("y"))
    chosen = scratch.save(own.orderBy(F.xxhash64("l_id"), "l_id").limit(sample), "sample")
    texts = docs.select(F.col(f"`{key}`").alias("d_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), F.col("d_id") == F.col("l_id")).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, data, offsets in chunks(batch.column("text")):
                row, bucket = buckets(data, offsets)
                both = np.unique(row << BITS | bucket)
                at = np.searchsorted(both >> BITS, np.arange(len(offsets)))
                held = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(both & (1 << BITS) - 1, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(a, len(offsets) - 1), held], names=["y", "terms"])

    rows = scratch.save(texts.mapInArrow(frugal(run), "y int, terms array<int>").withColumn("h", F.xxhash64("terms", "y")), "terms")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    seen = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("a"), F.sum("y").alias("b")).filter(F.col("a") >= LEAST_TEXTS).toPandas()
    single = telling_terms(*(seen[c].to_numpy(np.float64 if c != "term" else np.int64) for c in ("term", "a", "b")), float(total["n"]), float(total["pos"]))
    short = _terms_of(rows.filter(F.size("terms").between(2, PAIR_TERMS)))
    pairs = telling_pairs(*short)
    terms = np.unique(np.concatenate((single, np.array([t for i, j, _ in pairs for t in (i, j)], np.int64))))
    picked = F.array_intersect("terms", F.array(*(F.lit(int(t)) for t in terms))) if len(terms) else F.array().cast("array<int>")
    idx, at, y = _terms_of(rows.select("y", picked.alias("terms"), "h"))
    x = np.zeros((len(y), len(terms)), np.float32)
    x[np.repeat(np.arange(len(y)), np.diff(at)), np.searchsorted(terms, idx)] = 1
    place = {t: k for k, t in enumerate(terms.tolist())}
    return fit(x, y, terms, np.array([(place[i], place[j], sign) for i, j, sign in pairs], np.int64).reshape(-1, 3))


def _terms_of(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All terms of bounded rows (y, terms, h) in the order of h, the first of each row, and the labels."""
    got = rows.select("y", F.array_sort("terms").alias("terms"), "h").toArrow().combine_chunks().sort_by([("h", "ascending")])
    col = got.column("terms").combine_chunks()
    sizes = col.value_lengths().to_numpy(zero_copy_only=False)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), got.column("y").to_numpy().astype(np.float64)


def score(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold) to every row, from its whole text alone.

    No shuffle. Null and empty texts get the machine's score of no terms, and very long ones are
    read whole. Other columns stay; one named score or predicted is replaced. Repeated rows score
    alike, and a score equal to the threshold is predicted 1. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    ddl = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + ["score double, predicted int"])
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        place = np.full(1 << BITS, -1, np.int32)
        place[own.terms] = np.arange(len(own.terms))
        for batch in batches:
            out = np.zeros(len(batch))
            for a, data, offsets in chunks(batch.column(text)):
                row, bucket = buckets(data, offsets)
                term = place[bucket]
                known = term >= 0
                x = np.zeros((len(offsets) - 1, len(own.terms)), np.float32)
                x[row[known], term[known]] = 1
                out[a : a + len(x)] = own.score(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    if text not in names:
        raise ValueError(f"the text's column must not be {text}")
    return docs.select(*[docs[c] for c in names]).mapInArrow(frugal(run), ddl)
