"""Catalog tables as frames, and the records of the feature pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if it is read in fewer parts than there are.

    Files of a few row groups would keep most cores idle. Large inputs have more parts than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{path}/{name}.parquet"))


def _records(df: DataFrame, kind: str, doc_id: str, date: str, text: str, limit: int | None) -> DataFrame:
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).alias("doc_id"), F.lit(kind).alias("source_type"), F.col(date).alias("date"), F.col(text).alias("text"))
    return rows.orderBy("date", "doc_id").limit(limit) if limit else rows


def speech_records(speeches: DataFrame, limit: int | None = None) -> DataFrame:
    """``doc_id, source_type, date, text`` of speeches with text; the first by date if limited (0: not)."""
    return _records(speeches, "speech", "id", "speech_date", "speech_text", limit)


def document_records(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """The same of parsed documents."""
    return _records(documents.where("parsed"), "document", "id", "meeting_date", "doc_text", limit)


def attached(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, one after another."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return whole
