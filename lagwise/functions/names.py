"""Names: normal forms and the resolution of requested names against a catalogue."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Words that don't count, least score and least lead over the next candidate.
IDLE, LEAST_SCORE, LEAST_LEAD = ("of", "the"), 0.70, 0.10


def normal_names(names: pd.Series) -> pd.Series:
    """Normal forms: accents and case don't count, and a run of anything but letters and digits is one space."""
    folded = names.str.normalize("NFKD").str.lower()
    words = folded.str.replace("[^\x00-\x7f]", "", regex=True).str.findall("[0-9a-z]+")
    return words.str.join(" ")


def normal(name: str) -> str:
    return normal_names(pd.Series([name], dtype=object)).iat[0]


@F.pandas_udf(StringType())
def normal_column(names: pd.Series) -> pd.Series:
    return normal_names(names.astype(object)).where(names.notna(), None)


def slug_column(c: Column) -> Column:
    return F.replace(normal_column(c), F.lit(" "), F.lit("_"))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def _grams(c: str, whole: bool) -> Column:
    """All runs of up to three characters; not whole: only the first, which is in whatever holds the name."""
    if not whole:
        return F.array(F.substring(c, 1, 3))
    places = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(F.col(c), i, n)))))


def _meet(asked: DataFrame, known: DataFrame, a: Column, b: Column) -> DataFrame:
    """Pairs whose arrays of keys have one in common."""
    left, right = asked.select("requested", "a", F.explode(a).alias("key")), known.select("candidate", "b", F.explode(b).alias("key"))
    return left.join(right, "key").drop("key").distinct()


def resolve(requested: DataFrame, catalogue: DataFrame, name: str = "name") -> DataFrame:
    """(requested, resolved, how, score, suggestions) for each requested name.

    how: exact (same normal form), substring (one contains the other, and only one does), fuzzy
    (0.7 * Jaccard of the words + 0.3 * sequence ratio, at least LEAST_SCORE and LEAST_LEAD ahead),
    or null, with the five best as suggestions; score is that of the best candidate met.

    Names meet by hash joins: equal forms, then a run of characters that one holds and the other
    begins with, and words in common, without which no score reaches LEAST_SCORE or threatens one
    that does. Only names that stay unresolved meet the whole catalogue, for their suggestions.
    """
    asked = requested.select(F.col(name).alias("requested")).distinct().withColumn("a", normal_column("requested"))
    known = catalogue.select(F.col(name).alias("candidate")).distinct().withColumn("b", normal_column("candidate"))
    idle = F.array(*(F.lit(x) for x in IDLE))
    words = lambda c: F.array_except(F.array_distinct(F.split(c, " ")), idle)
    jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect(words("a"), words("b"))), F.size(F.array_union(words("a"), words("b")))), F.lit(0.0))
    score = 0.7 * jaccard + 0.3 * _ratio("a", "b")
    exact = asked.join(known, F.col("a") == F.col("b")).groupBy("requested").agg(F.min("candidate").alias("e"))
    inside = _meet(asked, known, _grams("a", True), _grams("b", False)).filter(F.contains("a", "b")).unionByName(_meet(asked, known, _grams("a", False), _grams("b", True)).filter(F.contains("b", "a")))
    inside = inside.groupBy("requested").agg(F.countDistinct("candidate").alias("n"), F.min("candidate").alias("s"))
    w = Window.partitionBy("requested").orderBy(F.desc("score"), "candidate")
    near = _meet(asked, known, words("a"), words("b")).withColumn("score", score)
    near = near.withColumns({"rank": F.row_number().over(w), "next": F.coalesce(F.lead("score").over(w), F.lit(0.0))}).filter("rank = 1").select("requested", F.struct("score", "candidate", "next").alias("f"))
    got = asked.join(exact, "requested", "left").join(inside, "requested", "left").join(near, "requested", "left")
    fuzzy = (F.col("f.score") >= LEAST_SCORE) & (F.col("f.score") - F.col("f.next") >= LEAST_LEAD)
    how = F.when(F.col("e").isNotNull(), "exact").when(F.col("n") == 1, "substring").when(fuzzy, "fuzzy")
    resolved = F.when(F.col("how") == "exact", F.col("e")).when(F.col("how") == "substring", F.col("s")).when(F.col("how") == "fuzzy", F.col("f.candidate"))
    got = got.withColumn("how", how).select("requested", "a", resolved.alias("resolved"), "how", F.col("f.score").alias("met"))
    left = got.filter("how is null").select("requested", "a").crossJoin(known).withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter("rank <= 5")
    left = left.groupBy(F.col("requested").alias("r")).agg(F.max("score").alias("best"), F.array_sort(F.collect_list(F.struct("rank", "candidate"))).alias("top"))
    out = got.join(left, F.col("requested") == F.col("r"), "left")
    return out.select("requested", "resolved", "how", F.coalesce("best", "met").alias("score"), F.when(F.col("how").isNull(), F.transform("top", lambda x: x["candidate"])).alias("suggestions"))
