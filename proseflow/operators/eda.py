"""Exploration: counts, lengths, words and clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proseflow.functions.names import misplaced, role, without_titles
from proseflow.functions.text import preprocess, word_count, words


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """``column, n``: the k most frequent values, null aside; ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def with_length(df: DataFrame, text_col: str = "text", out: str = "speech_length") -> DataFrame:
    return df.withColumn(out, word_count(F.col(text_col)))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles (linear) of a column, nulls aside."""
    c = F.col(column)
    return df.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
        *(F.percentile(c, F.lit(q)).alias(n) for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))), F.max(c).alias("max"))


def mean_by(df: DataFrame, key: str | Column, column: str, name: str, k: int | None = None) -> DataFrame:
    """Mean of a column by key, nulls aside; the k largest of them (ties by key) if k is given."""
    key = F.col(key) if isinstance(key, str) else key
    means = df.groupBy(key.alias(name)).agg(F.avg(column).alias("mean_length"))
    return means.orderBy(F.desc("mean_length"), name).limit(k) if k else means


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bin, lo, hi, n``: equal widths between the extremes, the last bin closed; empty bins count 0.

    Equal extremes are widened by one half on either side. Rows are counted by value first, and both the extremes and
    the bins come from those counts (one exchange, used twice).
    """
    c = F.col(column).cast("double")
    by_value = df.where(c.isNotNull()).groupBy(c.alias("x")).agg(F.count("*").alias("m"))
    ends = by_value.agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a IS NOT NULL")
    ends = ends.select(F.when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.col("a") - 0.5).alias("a"), F.when(F.col("a") < F.col("b"), F.col("b")).otherwise(F.col("b") + 0.5).alias("b"))
    ends = F.broadcast(ends)  # a single row
    at = F.least(F.floor((F.col("x") - F.col("a")) * bins / (F.col("b") - F.col("a"))).cast("int"), F.lit(bins - 1))
    counts = by_value.join(ends).groupBy(at.alias("bin")).agg(F.sum("m").alias("n"))
    width = (F.col("b") - F.col("a")) / bins
    all_bins = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", "b")
    return all_bins.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def top_words(df: DataFrame, text_col: str = "text", k: int = 20, stop_words: Sequence[str] = ()) -> DataFrame:
    """``word, n``: the k most frequent words as written; those whose lower case is a stop word are left out."""
    found = df.select(F.explode(words(F.col(text_col))).alias("word"))
    kept = found.where(~F.lower("word").isin(list(stop_words))) if stop_words else found
    return kept.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def cleaned_speakers(df: DataFrame, canonical: dict[str, str], speaker: str = "speaker", event: str = "event") -> DataFrame:
    """Swaps misplaced names and events, writes names that hold a key of canonical in one way, adds ``role``, drops titles."""
    wrong = misplaced(F.col(speaker))
    swapped = df.withColumns({speaker: F.when(wrong, F.col(event)).otherwise(F.col(speaker)), event: F.when(wrong, F.col(speaker)).otherwise(F.col(event))})
    for part, name in canonical.items():
        swapped = swapped.withColumn(speaker, F.when(F.coalesce(F.contains(F.col(speaker), F.lit(part)), F.lit(False)), F.lit(name)).otherwise(F.col(speaker)))
    return swapped.withColumn("role", role(F.col(speaker))).withColumn(speaker, without_titles(F.col(speaker)))


def overwritten(df: DataFrame, key: str, texts: dict[int, str], text_col: str) -> DataFrame:
    """Supplied texts for the rows with the keys given."""
    new = F.col(text_col)
    for k, t in texts.items():
        new = F.when(F.col(key) == k, F.lit(t)).otherwise(new)
    return df.withColumn(text_col, new)


def clusters(df: DataFrame, key: str, stop_words: Sequence[str], text_col: str = "text", k: int = 5, features: int = 1_000, seed: int = 42) -> DataFrame:
    """``key, cluster``: K-Means over normed TF-IDF vectors; rows without text are in cluster -1. Keys must be distinct.

    A text without any known term has a zero vector and is clustered like others.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer

    texts = df.where(F.col(text_col).isNotNull()).select(key, F.split(preprocess(F.col(text_col), stop_words), " ").alias("__words"))
    stages = [CountVectorizer(inputCol="__words", outputCol="__tf", vocabSize=features), IDF(inputCol="__tf", outputCol="__idf"), Normalizer(inputCol="__idf", outputCol="features"), KMeans(k=k, seed=seed, predictionCol="cluster")]
    texts = texts.persist()
    try:
        told = Pipeline(stages=stages).fit(texts).transform(texts).select(key, "cluster")
    finally:
        texts.unpersist()
    return df.select(key).join(told, key, "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def first_of_each(df: DataFrame, group: str, order: Sequence[str], k: int = 5) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"))
