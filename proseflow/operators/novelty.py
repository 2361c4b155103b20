"""Lexical novelty: one minus the TF-IDF cosine of a document and its predecessor in its series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proseflow.functions.stopwords import english
from proseflow.functions.text import terms


def dedup_longest(docs: DataFrame, keys: Sequence[str], order: Sequence[str], text_col: str = "text") -> DataFrame:
    """Of each key the row with the longest text; equal lengths keep the earlier one."""
    w = W.partitionBy(*keys).orderBy(F.desc(F.length(text_col)), *order)
    return docs.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


#: Parts of a vocabulary that are ranked by themselves first.
PARTS = 64


def _vocabulary(stats: DataFrame, series: Sequence[str], size: int) -> DataFrame:
    """Of each series the size terms with the largest counts (ties by term).

    Ranked in parts by a hash of the term first: one task never holds all the distinct terms of a large series.
    """
    best = (F.desc("all"), F.col("term"))
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS))
    few = stats.withColumn("__part", part).withColumn("__rn", F.row_number().over(W.partitionBy(*series, "__part").orderBy(*best))).where(F.col("__rn") <= size).drop("__part", "__rn")
    if not series:
        return few.orderBy(*best).limit(size)
    return few.withColumn("__rn", F.row_number().over(W.partitionBy(*series).orderBy(*best))).where(F.col("__rn") <= size).drop("__rn")


def _counts(docs: DataFrame, keys: Sequence[str], text_col: str, stop_words: Sequence[str] | None) -> DataFrame:
    """``keys, term, tf`` without stop words."""
    stop = list(english() if stop_words is None else stop_words)
    found = docs.select(*keys, F.explode(terms(F.col(text_col))).alias("term"))
    return (found.where(~F.col("term").isin(stop)) if stop else found).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def weights(docs: DataFrame, series: Sequence[str], doc: Sequence[str], text_col: str = "text", max_features: int = 10_000, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``series, doc, term, w``: tf times smoothed idf, each document's vector of norm one.

    The vocabulary of a series is its max_features most frequent terms (ties by term). idf is fitted on the whole
    series: ln((1 + N) / (1 + df)) + 1. Counting reduces before every shuffle; vocabularies are small by construction.
    """
    keys = [*series, *doc]
    tf = _counts(docs, keys, text_col, stop_words)
    stats = tf.groupBy(*series, "term").agg(F.sum("tf").alias("all"), F.count("*").alias("df"))
    vocabulary = _vocabulary(stats, series, max_features).select(*series, "term", "df")
    n = docs.groupBy(*series).agg(F.count("*").alias("n")) if series else docs.agg(F.count("*").alias("n"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    known = vocabulary.join(F.broadcast(n), list(series)) if series else vocabulary.crossJoin(F.broadcast(n))
    raw = tf.join(known.select(*series, "term", idf.alias("idf")), [*series, "term"]).select(*keys, "term", (F.col("tf") * F.col("idf")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(*keys)))
    return raw.select(*keys, "term", (F.col("x") / norm).alias("w"))


def _alike(one: DataFrame, before: DataFrame, series: list[str], date: str, text_col: str, **how) -> DataFrame:
    """``series, date, sim``: cosine with the document before, idf fitted on the whole series."""
    w = weights(one, series, [date], text_col, **how)
    # A term's weights in date order: the one before is the predecessor's if it is of the date before.
    by_term = W.partitionBy(*series, "term").orderBy(date)
    pairs = w.select(*series, date, "w", F.lag(date).over(by_term).alias("d0"), F.lag("w").over(by_term).alias("w0")).where("d0 IS NOT NULL")
    return pairs.join(before, [*series, date]).where("d0 = prev").groupBy(*series, date).agg(F.sum(F.col("w") * F.col("w0")).alias("sim"))


def _alike_so_far(one: DataFrame, before: DataFrame, series: list[str], date: str, text_col: str, stop_words: Sequence[str] | None = None) -> DataFrame:
    """The same with idf fitted, for each date, on the documents up to it, so no score knows of later ones.

    How many documents up to a date hold a term is its rank in the term's own dates. For the predecessor's terms one is
    added if the document at hand is the next to hold them; those are the terms both share.
    """
    by_term = W.partitionBy(*series, "term").orderBy(date)
    past = _counts(one, [*series, date], text_col, stop_words).select(*series, date, "tf", F.row_number().over(by_term).alias("df"), F.lead(date).over(by_term).alias("d1"), F.lead("tf").over(by_term).alias("tf1"))
    n = before.withColumn("n", F.row_number().over(W.partitionBy(*series).orderBy(date)))
    idf = lambda df: F.log((1 + F.col("n")) / (1 + df)) + 1
    square = lambda x: x * x
    now = past.join(n.select(*series, date, "n"), [*series, date]).groupBy(*series, date).agg(F.sum(square(F.col("tf") * idf(F.col("df")))).alias("q"))
    both = F.coalesce(F.col("d1") == F.col("now"), F.lit(False))
    after = n.where("prev IS NOT NULL").select(*series, F.col("prev").alias(date), F.col(date).alias("now"), "n")
    then = past.join(after, [*series, date]).withColumns({"i": idf(F.col("df") + both.cast("int")), "both": both})
    sums = then.groupBy(*series, F.col("now").alias(date)).agg(F.sum(square(F.col("tf") * F.col("i"))).alias("p"), F.sum(F.when(F.col("both"), F.col("tf") * F.col("tf1") * square(F.col("i")))).alias("dot"))
    return sums.join(now, [*series, date]).select(*series, date, (F.col("dot") / F.sqrt(F.col("p") * F.col("q"))).alias("sim"))


def novelty(docs: DataFrame, series: Sequence[str] = ("source_type",), date: str = "date", order: Sequence[str] = ("doc_id",), text_col: str = "text", so_far: bool = False, **how) -> DataFrame:
    """All rows of docs' series, date and order columns with ``novelty``.

    Documents of one series and date share the score of the longest of them. The first date of a series scores 1.0;
    a null date has no place in the series and scores null. so_far fits idf on what came before only (then without a
    limit on the vocabulary).
    """
    series = list(series)
    dated = docs.where(F.col(date).isNotNull())
    one = dedup_longest(dated, [*series, date], order, text_col).select(*series, date, text_col)
    before = one.select(*series, date, F.lag(date).over(W.partitionBy(*series).orderBy(date)).alias("prev"))
    alike = (_alike_so_far if so_far else _alike)(one, before, series, date, text_col, **how)
    scored = before.join(alike, [*series, date], "left").select(
        *series, date, F.when(F.col("prev").isNull(), F.lit(1.0)).otherwise(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("sim", F.lit(0.0))))).alias("novelty"))
    return docs.select(*series, date, *order).join(scored, [*series, date], "left")


def top_terms(docs: DataFrame, doc: Sequence[str], k: int = 20, max_features: int = 1_000, **how) -> DataFrame:
    """``term, score``: the k terms with the largest sums of weights over all documents (ties by term)."""
    w = weights(docs, [], doc, max_features=max_features, **how)
    return w.groupBy("term").agg(F.sum("w").alias("score")).orderBy(F.desc("score"), "term").limit(k)
