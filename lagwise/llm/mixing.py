"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwise.llm.scratch import Scratch

#: Weights up to which they are sent to all tasks (some 100 bytes each in a hash table, 25 MB); beyond, a shuffled join.
SENT = 250_000
#: Rows that a bucket of one source should hold; buckets only bound the work of a task.
BUCKET_ROWS = 4_096
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(*cols: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) that depends on the values only: 52 bits of an MD5."""
    text = F.concat_ws("\x1f", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("\x1e")) for c in cols))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """source, source_size, n -> with target: weights repeat over the sources by code point, null last.

    The budget is share * all sizes. What a source would get beyond cap * its size is given to the
    others by weight until none is above: with sources in the order of cap * size / weight, a
    source is held at its cap exactly if the level that the others reach without it is higher.
    One row a source goes through the two global windows; documents never do.
    """
    by_name, by_ratio = W.orderBy(F.col("source").isNull(), F.col("source")), W.orderBy(F.col("cap") / F.col("w"), F.col("place"))
    place = (F.row_number().over(by_name) - 1).cast("int")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    every = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    df = (
        sizes.withColumn("place", place)
        .withColumn("w", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("held", F.col("level") * F.col("w") >= F.col("cap"))
    )
    # After the first source that is not held, the levels only fall: the highest is the right one.
    free = F.max(F.when(~F.col("held"), F.col("level"))).over(every)
    return df.select("source", "source_size", "n", F.when(F.col("held"), F.col("cap")).otherwise(F.col("w") * free).alias("target"))


def _ordered(docs: DataFrame, text: str, source: str, key: str, seed: str) -> dict[str, Column]:
    """The columns m_key, m_source, m_size and m_order (for weight 1) of a table of documents."""
    size = word_count(F.col(f"`{text}`"))
    u = uniform(F.col(f"`{key}`"), F.col(f"`{source}`"), size, seed=seed)
    return {"m_key": F.col(f"`{key}`"), "m_source": F.col(f"`{source}`"), "m_size": size, "m_order": -F.log(u)}


def _weights(quality: DataFrame | None, scratch: Scratch) -> DataFrame | None:
    """(q_key, weight), written; several weights of a key: the highest. Marked to be sent to all tasks if it is small enough."""
    if quality is None:
        return None
    q = scratch.save(quality.groupBy(F.col("key").alias("q_key")).agg(F.max("weight").alias("weight")), "weights")
    return F.broadcast(q) if q.count() <= SENT else q


def _weighed(rows: DataFrame, q: DataFrame | None) -> DataFrame:
    """The rows with m_order divided by the weight of their key."""
    if q is None:
        return rows
    weight = F.when(F.col("weight") >= 0, F.col("weight")).otherwise(1.0)
    return rows.join(q, F.col("m_key").eqNullSafe(F.col("q_key")), "left").withColumn("m_order", F.coalesce(F.try_divide(F.col("m_order"), weight), F.lit(float("inf")))).drop("q_key", "weight")


def _bucket(buckets: Column) -> Column:
    # 1 - exp(-order) spreads the keys evenly over (0, 1) for weight 1, and monotonically for any.
    return F.least(F.floor((1 - F.exp(-F.col("m_order"))) * buckets), buckets - 1).cast("long")


def plan(rows: DataFrame, weights: Sequence[int], share: float, cap: float, scratch: Scratch) -> DataFrame:
    """Per source: source, source_size, target, epochs, buckets, edge, cut, some.

    rows: m_key, m_source, m_size, m_order. A row is picked beyond its source's whole epochs if its
    bucket comes before the edge, or is the edge and (m_order, m_key, m_size) <= cut. Where the rest
    ends among equal rows, only `some` of those at the cut are picked; else that is null.
    """
    goal = targets(rows.groupBy(F.col("m_source").alias("source")).agg(F.sum("m_size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.select("source", "source_size", "target", epochs.alias("epochs"), F.ceil(F.col("n") / F.lit(float(BUCKET_ROWS))).cast("long").alias("buckets"))
    goal = scratch.save(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "goal")
    placed = rows.join(goal, F.col("m_source").eqNullSafe(F.col("source"))).withColumn("bucket", _bucket(F.col("buckets")))
    sums = placed.groupBy("source", "rest", "bucket").agg(F.sum("m_size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    edge = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", F.col("upto").alias("u"), "words")).alias("e"))
    edge = scratch.save(edge.select(F.col("source").alias("e_source"), F.col("e.bucket").alias("edge"), (F.col("e.u") - F.col("e.words")).alias("before")), "edge")
    inside = placed.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("edge")))
    # Equal rows (in order, key and size) are one entry with a count, however many they are.
    entries = inside.groupBy("source", "rest", "before", "m_order", "m_key", "m_size").agg(F.count(F.lit(1)).alias("copies"))
    at = F.col("before") + F.coalesce(F.sum(F.col("m_size") * F.col("copies")).over(W.partitionBy("source").orderBy("m_order", "m_key", "m_size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fits = F.when(F.col("m_size") > 0, F.floor((F.col("rest") - at) / F.col("m_size") + 0.5)).when(at <= F.col("rest"), F.col("copies")).otherwise(0)
    taken = entries.withColumn("some", F.least(fits, F.col("copies")).cast("long")).filter("some > 0")
    cut = taken.groupBy(F.col("source").alias("c_source")).agg(F.max(F.struct("m_order", "m_key", "m_size", "some", "copies")).alias("c"))
    cut = cut.select("c_source", F.struct("c.m_order", "c.m_key", "c.m_size").alias("cut"), F.when(F.col("c.some") < F.col("c.copies"), F.col("c.some")).alias("some"))
    out = goal.join(edge, F.col("source").eqNullSafe(F.col("e_source")), "left").join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left")
    return scratch.save(out.select("source", "source_size", "target", "epochs", "buckets", F.coalesce("edge", "buckets").alias("edge"), "cut", "some"), "plan")


_AT = ("m_order", "m_key", "m_size")


def _picked() -> Column:
    """Whether a row comes before the cut, or is at it; of a cut that takes some of its equal rows, none."""
    bucket, at = _bucket(F.col("buckets")), F.struct(*_AT)
    within = F.when(F.col("some").isNull(), at <= F.col("cut")).otherwise(at < F.col("cut"))
    return (bucket < F.col("edge")) | ((bucket == F.col("edge")) & F.coalesce(within, F.lit(False)))


def _divided() -> Column:
    """Whether a row is one of several equal ones of which the plan takes some only."""
    return F.coalesce(F.col("some").isNotNull() & (F.struct(*_AT) == F.col("cut")), F.lit(False))


def _some_of(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Divided rows with picked: of each source's, which are equal, the first `some` as they are written.

    The rows are written with a number that only grows within a task; the counts of the tasks tell
    in which one the pick ends, and only that task's rows are ranked.
    """
    rows = scratch.save(rows.withColumn("nr", F.monotonically_increasing_id()), "divided")
    part = F.shiftright("nr", 33)
    counts = rows.groupBy(F.col("m_source").alias("n_source"), part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max("some").alias("need"))
    upto = F.sum("n").over(W.partitionBy("n_source").orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    ends = counts.withColumn("upto", upto).filter(F.col("upto") >= F.col("need")).groupBy("n_source").agg(F.min(F.struct("part", (F.col("need") - F.col("upto") + F.col("n")).alias("own"))).alias("e"))
    ends = ends.select("n_source", F.col("e.part").alias("e_part"), F.col("e.own").alias("own"))
    last = rows.join(ends, F.col("m_source").eqNullSafe(F.col("n_source")) & (part == F.col("e_part"))).select("n_source", "own", "nr")
    last = last.withColumn("k", F.row_number().over(W.partitionBy("n_source").orderBy("nr"))).filter(F.col("k") == F.col("own")).select("n_source", F.col("nr").alias("last"))
    last = scratch.save(last, "last")
    return rows.join(last, F.col("m_source").eqNullSafe(F.col("n_source"))).withColumn("picked", F.col("nr") <= F.col("last")).drop("nr", "n_source", "last")


def _with_picks(rows: DataFrame, plans: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds picked to rows that have met their source's line of the plan."""
    if not plans.filter("some is not null").limit(1).count():
        return rows.withColumn("picked", _picked())
    return rows.filter(~_divided()).withColumn("picked", _picked()).unionByName(_some_of(rows.filter(_divided()), scratch))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    quality: DataFrame | None = None,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    seed: str = "mix",
) -> DataFrame:
    """Per document: key, source, size, source_size, target, epochs, picked, taken.

    size: words of the text (null: 0). taken = size * epochs, and once more if picked. epochs is
    the whole part of target / source_size; for the rest of the target, documents come in the order
    of the exponential key -ln(u) / weight (u from a hash of key, source and size, weight from
    quality(key, weight), 1 where it has none), and those of which at least half lies within the
    rest are picked. So a source misses its target by half a document at most, and reruns agree.

    A hot source is cut into buckets of its keys' range: sums per bucket say in which one the rest
    ends, and only that bucket of each source, some BUCKET_ROWS rows, is sorted.
    Nulls: a null source is one source, last; a null key is a key. Equal keys of the order are
    told apart by document key. Rows equal in key, source and size are interchangeable, and of them
    as many are picked as fit. A null, absent or negative quality weight is 1; 0 comes last. Very
    long texts are counted whole. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(*(c.alias(k) for k, c in _ordered(docs, text, source, key, seed).items()))
    rows = scratch.save(_weighed(rows, _weights(quality, scratch)), "rows")
    plans = plan(rows, weights, share, cap, scratch)
    both = _with_picks(rows.join(plans, F.col("m_source").eqNullSafe(F.col("source"))), plans, scratch)
    out = both.select(F.col("m_key").alias("key"), F.col("m_source").alias("source"), F.col("m_size").alias("size"), "source_size", "target", "epochs", "picked")
    return out.withColumn("taken", F.col("size") * (F.col("epochs") + F.when(F.col("picked"), 1).otherwise(0)))


def repeat_mixed(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    quality: DataFrame | None = None,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    seed: str = "mix",
) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with its own columns.

    The plan is made from numbers alone; then whether a row is picked follows from the row, its
    weight and its source's line of the plan. So texts only move to meet their weights, where
    these are more than SENT. Nulls, ties, repeated rows and clashing
    columns as in mix().
    """
    scratch = Scratch(docs.sparkSession, "mix")
    found = {k: c.alias(k) for k, c in _ordered(docs, text, source, key, seed).items()}
    q = _weights(quality, scratch)
    plans = plan(scratch.save(_weighed(docs.select(*found.values()), q), "rows"), weights, share, cap, scratch)
    names = docs.columns
    rows = _weighed(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), *found.values()), q)
    rows = _with_picks(rows.join(plans, F.col("m_source").eqNullSafe(F.col("source"))), plans, scratch)
    copies = (F.col("epochs") + F.when(F.col("picked"), 1).otherwise(0)).cast("int")
    return rows.select("__row", F.explode(F.array_repeat(F.lit(True), copies)).alias("__copy")).select(*(F.col(f"__row.`{c}`") for c in names))
