"""JSON feeds of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseflow.functions.names import item_id, item_urls
from proseflow.operators.merge import first_per_key
from proseflow.schemas import FEED_ITEM

_FEED = T.StructType([T.StructField("mtgitems", T.ArrayType(FEED_ITEM))])


def read(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``feed, body``: whole feed files, numbered in the order given."""
    parts = [spark.read.text(p, wholetext=True).select(F.lit(i).alias("feed"), F.col("value").alias("body")) for i, p in enumerate(paths)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def items(feeds: DataFrame) -> DataFrame:
    """``feed, ord`` and the fields of each item; a byte-order mark is skipped, a feed that is no JSON has no items."""
    parsed = feeds.select("feed", F.from_json(F.ltrim(F.col("body"), F.lit("\ufeff")), _FEED).alias("j"))
    return parsed.select("feed", F.posexplode("j.mtgitems").alias("ord", "i")).select("feed", "ord", "i.*")


def documents(feeds: DataFrame, base_url: str, categories: Sequence[str] = ("St", "Mn")) -> DataFrame:
    """New catalog rows of the categories; of one id the first in feed order."""
    html, pdf = item_urls(base_url, F.col("files"), F.col("url"))
    rows = items(feeds).where(F.col("type").isin(list(categories))).select(
        "feed", "ord", item_id(F.col("type"), F.col("dt"), F.col("d")).alias("doc_id"), F.col("type").alias("category"), F.try_to_date("d").alias("meeting_date"),
        F.coalesce(F.try_to_date(F.nullif(F.col("dt"), F.lit(""))), F.try_to_date("d")).alias("pub_date"), F.coalesce("mtg", F.lit("")).alias("meeting_label"), html.alias("html_url"), pdf.alias("pdf_url"))
    return first_per_key(rows, ["doc_id"], ["feed", "ord"]).drop("feed", "ord")
