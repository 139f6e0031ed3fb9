"""Language identification: text, declared language, address and host fused by Bayes' rule."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.llm.scratch import Scratch
from lagwise.llm.textbytes import U, chunks, frugal

#: The class of texts in none of the languages, and what it gets before all evidence.
NONE, NONE_PRIOR = "und", 0.005
#: Bits of a trigram's bucket; rows of a language to learn from, about (first by a hash of the text).
BITS, SAMPLE = 16, 12_000
#: Trigrams are not independent: n of them count as n / (1 + n / EVIDENCE).
EVIDENCE = 60.0
#: What smoothing adds: to a trigram's count, and rows of the parent level to each level of hosts.
ADDED, PARENT_ROWS = 0.05, 20.0
CONFIDENCE = 0.5
#: Rejected rows up to which they are broadcast (some 100 bytes each in a hash table, 25 MB).
BROADCAST_ROWS = 250_000
#: Steps of a 63-bit hash, each 1/32 of where it begins at most: its length in bits, then the five bits after the first.
_HASH = "(xxhash64(text, declared) & 9223372036854775807)"
_STEP = f"length(bin({_HASH})) * 32 + cast(shiftright({_HASH}, greatest(length(bin({_HASH})) - 6, 0)) & 31 as int)"
# Letters keep their folded byte, digits are one class, all else is a space.
_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = _CLASS[65:91] = np.arange(97, 123)
_CLASS[48:58], _CLASS[128:] = 48, np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams with a letter in the middle, and the first of each row."""
    c = _CLASS[data]
    n = max(len(c) - 2, 0)
    ok = np.zeros(len(c), bool)
    ok[:n] = (c[1 : n + 1] > 48) if n else False
    for t in (1, 2):
        x = offsets[1:] - t
        ok[x[(x >= 0) & (x < len(ok))]] = False
    at = np.flatnonzero(ok)
    code = (c[at] << 16 | c[at + 1] << 8 | c[at + 2]).astype(U)
    return (code * U(0x9E3779B97F4A7C15) >> U(64 - BITS)).astype(np.int64), np.searchsorted(at, offsets)


@dataclass(frozen=True)
class TextModel:
    """Languages, the last of them NONE, and log P(trigram | language) for each."""

    names: tuple[str, ...]
    table: np.ndarray

    def log_likelihoods(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bucket, first = trigrams(data, offsets)
        n = np.diff(first)
        out = np.empty((len(n), len(self.names)))
        for k in range(len(self.names)):
            run = np.concatenate(([0.0], np.cumsum(self.table[k][bucket], dtype=np.float64)))
            out[:, k] = run[first[1:]] - run[first[:-1]]
        return out / (1 + n / EVIDENCE)[:, None]


def learn(rows: DataFrame, sample: int = SAMPLE, scratch: Scratch | None = None) -> TextModel:
    """From (text, declared): trigram counts of about `sample` rows of each declared language.

    A language's rows are taken in the order of a hash of the text, by whole steps of the hash
    (1/32 of its size), up to the step that reaches `sample`; a language with no more rows has all
    of them. Copies share a hash, so they come along. A language whose sampled text has fewer
    trigrams than the smoothing adds would be all but NONE, so it is left out. The driver gets one
    number a language and bucket, and the table takes 256 KB a language.
    """
    scratch = scratch or Scratch(rows.sparkSession, "language")
    named = rows.filter(F.col("declared") != NONE).select("declared", "text", F.expr(_STEP).alias("step"))
    steps = scratch.save(named.groupBy("declared", "step").agg(F.count(F.lit(1)).alias("n")), "steps")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("declared").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = steps.withColumn("before", before).filter(F.col("before") < sample).groupBy("declared").agg(F.max("step").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column("declared").dictionary_encode()
            who = tags.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for a, data, offsets in chunks(batch.column("text")):
                bucket, first = trigrams(data, offsets)
                cell, n = np.unique(np.repeat(who[a : a + len(offsets) - 1], np.diff(first)) << BITS | bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([tags.dictionary.take(pa.array(cell >> BITS)), pa.array(cell & (1 << BITS) - 1, pa.int32()), pa.array(n, pa.int64())], names=["declared", "b", "n"])

    used = named.join(F.broadcast(last), "declared").filter(F.col("step") <= F.col("last")).select("declared", "text")
    cells = scratch.save(used.mapInArrow(frugal(run), "declared string, b int, n long").groupBy("declared", "b").agg(F.sum("n").alias("n")), "trigrams")
    totals = cells.groupBy("declared").agg(F.sum("n").alias("n")).filter(F.col("n") >= ADDED * (1 << BITS))
    names = tuple(sorted(r["declared"] for r in totals.collect()))
    table = np.empty((len(names) + 1, 1 << BITS), np.float32)
    table[:-1], table[-1] = ADDED, -np.log(1 << BITS)
    places = rows.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "declared string, k int")
    got = cells.join(F.broadcast(places), "declared").select("k", "b", "n").toPandas()
    table[got["k"], got["b"]] += got["n"].to_numpy()
    for k in range(len(names)):
        table[k] = np.log(table[k] / table[k].sum(dtype=np.float64))
    return TextModel((*names, NONE), table)


def _log_sum(c: Column) -> Column:
    top = F.array_max(c)
    return top + F.log(F.aggregate(F.transform(c, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))


def identify(rows: DataFrame, accepted: tuple[str, ...] | None = None, confidence: float = CONFIDENCE, model: TextModel | None = None) -> DataFrame:
    """Rows (id, text, declared, suffix, tld, domain, host) -> id, lang, confidence, kept, declared.

    log posterior = text + log P(declared | lang) + log P(suffix | lang) + log P(lang | host).
    Text: a trigram model of every language, damped for long texts. The two tables of evidence and
    the prior are counts of all rows by the language that their text alone suggests, summed by
    grouped aggregation: a host's prior is its counts plus PARENT_ROWS rows shared out as its
    domain's prior says, that one's likewise from its top-level domain, and that from all rows.
    kept: the language is one of `accepted` (null: any but und) and its posterior >= confidence.

    A text that declares a language that the model lacks, for want of text to learn from, is in that
    language, with confidence 1: nothing here can gainsay it, and it is not rejected for that.

    Nulls: an evidence that is null says nothing; a null host falls back to its parent. A null
    text, or one without a letter, is und. Ties go to the language that comes first by its name,
    und last. Repeated rows are judged alike, each for itself. Very long texts are read whole. Other
    columns are ignored, whatever their names. An empty table gives no rows. Texts are read once
    after learning and never shuffled; a row's numbers are.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "language")
    model = model or learn(rows, scratch=scratch)
    names, n_lang = model.names, len(model.names)
    cols = ("id", "declared", "suffix", "tld", "domain", "host")
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for a, data, offsets in chunks(batch.column("text")):
                ll = own.log_likelihoods(data, offsets)
                run = np.concatenate(([0], np.cumsum(_CLASS[data] > 48)))
                n = run[offsets[1:]] - run[offsets[:-1]]
                k = len(n)
                best = np.where(n > 0, ll.argmax(1), n_lang - 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * n_lang + 1, n_lang), pa.int32()), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, k) for c in cols), lists, pa.array(best, pa.int32()), pa.array(n)], names=[*cols, "ll", "best", "n"])

    id_type = rows.schema["id"].dataType.simpleString()
    seen = scratch.save(rows.select(*cols, "text").mapInArrow(frugal(run), f"id {id_type}, declared string, suffix string, tld string, domain string, host string, ll array<double>, best int, n long"), "seen")
    # Counts and priors are arrays over the languages, so that plans don't grow with these.
    places = F.sequence(F.lit(0), F.lit(n_lang - 1))

    def counted(df: DataFrame, level: list[str]) -> DataFrame:
        """The level's keys and counts, rows by the language that their text suggests."""
        some = df.groupBy(*level, "best").agg(F.count(F.lit(1)).cast("double").alias("c"))
        some = some.groupBy(*level).agg(F.map_from_entries(F.collect_list(F.struct("best", "c"))).alias("m"))
        return some.select(*level, F.transform(places, lambda k: F.coalesce(F.try_element_at(F.col("m"), k.cast("int")), F.lit(0.0))).alias("counts"))

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def prior(level: list[str], parent: DataFrame | None) -> DataFrame:
        """The level's keys (prefixed p_) and prior; a parent has all but the last key."""
        got = counted(seen, level)
        if parent is None:
            got = got.withColumn("prior", F.transform(places, lambda k: F.when(k == n_lang - 1, NONE_PRIOR).otherwise((1 - NONE_PRIOR) / max(n_lang - 1, 1))))
        else:
            on = F.lit(True)
            for c in level[:-1]:
                on = on & F.col(c).eqNullSafe(F.col(f"p_{c}"))
            got = got.join(parent, on) if level[:-1] else got.join(F.broadcast(parent))
        got = got.withColumn("total", total("counts"))
        out = F.zip_with("counts", "prior", lambda c, p: (c + PARENT_ROWS * p) / (F.col("total") + PARENT_ROWS))
        return scratch.save(got.select(*[F.col(c).alias(f"p_{c}") for c in level], out.alias("prior")), "-".join(["prior", *level]))

    every = prior([], None)
    by_host = prior(["tld", "domain", "host"], prior(["tld", "domain"], prior(["tld"], every)))

    def evidence(c: str) -> DataFrame:
        """log P(value | language), smoothed by the values' shares over all languages."""
        some = seen.filter(f"{c} is not null")
        got = counted(some, [c]).join(F.broadcast(counted(some, []).select(F.col("counts").alias("sums"))))
        got = got.withColumn("share", PARENT_ROWS * total("counts") / total("sums"))
        value = F.zip_with("counts", "sums", lambda x, s: F.log((x + F.col("share")) / (s + PARENT_ROWS)))
        return scratch.save(got.select(F.col(c).alias(f"e_{c}"), value.alias(f"v_{c}")), c)

    on = F.lit(True)
    for c in ("tld", "domain", "host"):
        on = on & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    fused = seen.join(by_host, on, "left")
    for c in ("declared", "suffix"):
        fused = fused.join(evidence(c), F.col(c) == F.col(f"e_{c}"), "left")
    zero = F.array_repeat(F.lit(0.0), n_lang)
    logs = F.transform(F.arrays_zip(F.col("ll").alias("a"), F.col("prior").alias("b"), F.coalesce("v_declared", zero).alias("c"), F.coalesce("v_suffix", zero).alias("d")), lambda x: x["a"] + F.log(x["b"]) + x["c"] + x["d"])
    fused = fused.withColumn("logs", logs)
    best = F.array_max("logs")
    every_name = F.array(*(F.lit(x) for x in names))
    lacking = F.col("declared").isNotNull() & ~F.array_contains(every_name, F.col("declared"))
    lang = F.when(F.col("n") == 0, F.lit(NONE)).when(lacking, F.col("declared")).otherwise(F.element_at(every_name, F.array_position("logs", best).cast("int")))
    sure = F.when((F.col("n") == 0) | lacking, F.lit(1.0)).otherwise(F.exp(best - _log_sum(F.col("logs"))))
    good = (F.col("lang") != NONE) if accepted is None else F.col("lang").isin(*accepted)
    return fused.select("id", "declared", lang.alias("lang"), sure.alias("confidence")).withColumn("kept", good & (F.col("confidence") >= confidence))


# --- evidence of documents and pages ---


def primary(tag: Column) -> Column:
    """The primary subtag of a language tag, lower-cased; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(tag, r"^\s*([A-Za-z]{2,3})\b", 1)), F.lit(""))


def document_rows(docs: DataFrame, id_: Column) -> DataFrame:
    """Documents declare their lang; their source stands for a host."""
    none = F.lit(None).cast("string")
    return docs.select(id_.alias("id"), F.col("text"), primary(F.col("lang")).alias("declared"), none.alias("suffix"), F.lit("").alias("tld"), F.col("source").alias("domain"), F.col("source").alias("host"))


def page_rows(pages: DataFrame, id_: Column) -> DataFrame:
    """Pages declare <html lang>; the address says a country's domain or else a first path segment of two letters."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    tld, domain = F.regexp_extract(host, r"([^.]*)$", 1), F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1)
    segment = F.lower(F.regexp_extract("url", r"^[^:]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    suffix = F.nullif(F.when(F.length(tld) == 2, tld).otherwise(segment), F.lit(""))
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    return pages.select(id_.alias("id"), body.alias("text"), primary(F.regexp_extract("html", r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([^\"'>\s]+)", 1)).alias("declared"), suffix.alias("suffix"), tld.alias("tld"), domain.alias("domain"), host.alias("host"))


def drop_rejected(docs: DataFrame, accepted: tuple[str, ...] | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """The rows of documents that identify() keeps, with their own columns, whatever their names.

    Nulls, ties and very long texts as in identify(): a document with a null or empty text goes, one
    with a null id, declaration or source is judged by the rest. Repeated rows go or stay together.
    An empty table gives no rows. Rejected rows are few, and are told by their id and a hash of what
    was judged; so texts move only if there are more of them than BROADCAST_ROWS.
    """
    judged = F.xxhash64("doc_id", "text", "lang", "source")
    out = identify(document_rows(docs, F.struct(F.col("doc_id").alias("d"), judged.alias("h"))), accepted, confidence)
    scratch = Scratch(docs.sparkSession, "language")
    gone = scratch.save(out.filter(~F.col("kept")).select(F.col("id.d").alias("r_id"), F.col("id.h").alias("r_hash")).distinct(), "rejected")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["r_id"]) & (judged == gone["r_hash"]), "left_anti")
