"""The feature pipeline: records to tone and novelty for each document, and its Parquet sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from proseflow.operators import novelty as nov
from proseflow.operators import sentiment

KEYS = ["source_type", "doc_id"]


def features(records: DataFrame, series: Sequence[str] = ("source_type",), novelty_how: dict | None = None, **sentiment_how) -> DataFrame:
    """``doc_id, source_type, date``, tone and novelty for records (doc_id, source_type, date, text).

    Novelty is of the text as it is, tone of the normalized text. Documents are told apart by source_type and doc_id.
    """
    tone = sentiment.scored(records, [*KEYS, "date"], **sentiment_how)
    new = nov.novelty(records, series, **(novelty_how or {})).select(*KEYS, "novelty")
    told = tone.join(new, KEYS, "left")
    names = ["hawkish_score", "n_hawkish", "n_dovish", "n_neutral", "n_target_sentences"]
    return told.select("doc_id", "source_type", "date", *names, F.coalesce("novelty", F.lit(float("nan"))).alias("novelty"))


def write(df: DataFrame, path: str, by_source: bool = False) -> bool:
    """Writes Parquet, one folder per source_type if asked; nothing is written without rows."""
    if df.isEmpty():
        return False
    writer = df.write.mode("overwrite")
    (writer.partitionBy("source_type") if by_source else writer).parquet(path)
    return True


def attach_targets(features_df: DataFrame, targets: DataFrame, series: str, date: str = "date") -> DataFrame:
    """Each feature row with the latest value of the series (series, date, value) before its date: an as-of join.

    A series has a value per date at most, so it is bounded by the calendar, not by the features: it is laid out with a
    row for every day up to the last value, and features meet it by equality of days; later dates take the last value.
    Without an earlier value it is null.
    """
    own = targets.where(F.col("series") == series).groupBy("date").agg(F.max("value").cast("double").alias("__value"))
    span = own.select(F.col("date").alias("__from"), F.lead("date").over(W.orderBy("date")).alias("__to"), "__value")
    days = span.where("__to IS NOT NULL").select(F.explode(F.sequence(F.date_add("__from", 1), F.col("__to"))).alias("__day"), "__value")
    last = own.agg(F.max("date").alias("__end"), F.max_by("__value", "date").alias("__last"))
    met = features_df.join(days, F.col(date) == F.col("__day"), "left").crossJoin(F.broadcast(last))  # one row
    value = F.when(F.col(date) > F.col("__end"), F.col("__last")).otherwise(F.col("__value"))
    return met.select(*features_df.columns, value.alias(series))
