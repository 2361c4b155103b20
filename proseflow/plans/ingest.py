"""Ingest: discovery, fetching and parsing of documents and speeches as steps over catalog tables.

Each step takes tables and returns the new table; a caller writes it. Fetchers are given, so all runs offline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseflow.functions.names import date_of_link, event_parts
from proseflow.functions.text import clean_document, clean_speech, old_layout_body, trim_at
from proseflow.operators import merge, queues
from proseflow.operators.frames import checkpointed
from proseflow.sources import feeds, pages


def _with_ids(df: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Ids after the largest there is, in the order of a column; rows are a batch of listings or feeds."""
    from pyspark.sql import Window as W

    top = existing.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("__top"))
    return df.crossJoin(F.broadcast(top)).withColumn("id", F.col("__top") + F.row_number().over(W.orderBy(order))).drop("__top")


def discover_documents(documents: DataFrame, feed_frame: DataFrame, base_url: str, today: Column | None = None, categories=("St", "Mn")) -> DataFrame:
    """The catalog with what feeds name anew; known ids stay as they are."""
    new = feeds.documents(feed_frame, base_url, categories).join(documents.select("doc_id"), "doc_id", "left_anti")
    flags = {"fetched": F.lit(False), "parsed": F.lit(False), "scrape_date": today if today is not None else F.current_date()}
    return documents.unionByName(_with_ids(new, documents, "doc_id").withColumns(flags), allowMissingColumns=True)


def fetch_documents(documents: DataFrame, get: Callable[[str], str | None], limit: int | None = None) -> DataFrame:
    """Pages of waiting documents, in one task so that pauses hold for the site; each is got once, as they are written first."""
    return queues.apply_fetch(documents, checkpointed(pages.fetched(queues.fetch_queue(documents, limit).coalesce(1), get)))


def parse_documents(documents: DataFrame) -> DataFrame:
    """Texts of waiting pages: statements by their largest division, others whole up to the notes."""
    waiting = queues.parse_queue(documents)
    statement = pages.as_column(pages.statement_text)(F.col("raw_html"))
    other = trim_at(pages.as_column(pages.minutes_text)(F.col("raw_html")))
    texts = waiting.where(F.col("category") == "St").select("id", statement.alias("t")).unionByName(waiting.where(F.col("category") != "St").select("id", other.alias("t")))
    return queues.apply_parse(documents, texts.select("id", clean_document(F.col("t")).alias("doc_text")))


def discover_speeches(speeches: DataFrame, listing_pages: DataFrame, base_url: str, today: Column | None = None) -> DataFrame:
    """The catalog with the entries of listing pages (year, html) whose link is new."""
    rows = pages.listings(checkpointed(listing_pages))
    link = F.concat(F.lit(base_url), F.col("href"))
    told = F.coalesce(F.when(F.col("text").isNotNull(), event_parts(F.col("text"))), F.when(F.col("text").isNull(), F.struct("title", "speaker", "event")))
    date, error = date_of_link(link, F.col("year"))
    found = rows.select(link.alias("link"), date.alias("speech_date"), error.alias("date_error"), told.alias("e")).where("e IS NOT NULL AND NOT date_error").select("link", "speech_date", "e.*")
    fresh = merge.first_per_key(found, ["link"], ["speech_date", "title"]).join(speeches.select("link"), "link", "left_anti")
    flags = {"processed": F.lit(False), "scrape_date": today if today is not None else F.current_date()}
    return speeches.unionByName(_with_ids(fresh, speeches, "link").withColumns(flags), allowMissingColumns=True)


def fetch_speeches(speeches: DataFrame, get: Callable[[str], str | None], limit: int | None = None, recent_from: int = 2006) -> DataFrame:
    """Texts of waiting speeches, each page got once and in one task; the layout follows the year."""
    waiting = queues.speech_queue(speeches, limit)
    got = checkpointed(pages.fetched(waiting.coalesce(1), get, "link")).join(waiting.select("id", F.year("speech_date").alias("year")), "id")
    new = trim_at(pages.as_column(pages.speech_text)(F.col("raw_html")))
    old = old_layout_body(pages.as_column(pages.page_text)(F.col("raw_html")))
    texts = got.where(F.col("year") >= recent_from).select("id", new.alias("t")).unionByName(got.where(F.col("year") < recent_from).select("id", old.alias("t")))
    return queues.apply_speech_text(speeches, texts.select("id", clean_speech(F.col("t")).alias("speech_text")))
