"""Work queues over the stage flags, and the writes that advance them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import update_by_key


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    """None and 0 mean no limit."""
    return df.limit(limit) if limit else df


def fetch_queue(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents with a page that isn't fetched, newest first."""
    waiting = documents.where(~F.col("fetched") & F.col("html_url").isNotNull()).select("id", "doc_id", "html_url", "meeting_date")
    return _limited(waiting.orderBy(F.desc("meeting_date"), "id"), limit)


def parse_queue(documents: DataFrame) -> DataFrame:
    """Fetched documents whose page isn't parsed."""
    return documents.where(F.col("fetched") & ~F.col("parsed") & F.col("raw_html").isNotNull()).select("id", "doc_id", "category", "raw_html")


def speech_queue(speeches: DataFrame, limit: int | None = None) -> DataFrame:
    """Speeches without text, oldest first."""
    return _limited(speeches.where(~F.col("processed")).select("id", "link", "speech_date").orderBy("speech_date", "id"), limit)


def apply_fetch(documents: DataFrame, fetched: DataFrame) -> DataFrame:
    """Stores pages (id, raw_html) and sets the flag; pages that failed (null) change nothing and stay queued."""
    return update_by_key(documents, fetched.withColumn("fetched", F.lit(True)), ["id"], ["raw_html", "fetched"], F.col("raw_html").isNotNull())


def apply_parse(documents: DataFrame, parsed: DataFrame) -> DataFrame:
    """Stores texts (id, doc_text) and sets the flag, for texts that aren't empty."""
    return update_by_key(documents, parsed.withColumn("parsed", F.lit(True)), ["id"], ["doc_text", "parsed"], F.coalesce(F.col("doc_text") != "", F.lit(False)))


def apply_speech_text(speeches: DataFrame, texts: DataFrame) -> DataFrame:
    """The same for speeches (id, speech_text)."""
    return update_by_key(speeches, texts.withColumn("processed", F.lit(True)), ["id"], ["speech_text", "processed"], F.coalesce(F.col("speech_text") != "", F.lit(False)))
