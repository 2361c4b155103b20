"""Chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseflow.functions.text import chunks

from .merge import replace_by_key


def chunked(docs: DataFrame, keys: list[str], text_col: str = "text", **sizes) -> DataFrame:
    """``keys, chunk_index, chunk_text, token_est``: a row per chunk; documents without paragraphs have none."""
    return docs.select(*keys, F.inline(chunks(F.col(text_col), **sizes)))


def upserted(existing: DataFrame, docs: DataFrame, text_col: str = "text", **sizes) -> DataFrame:
    """existing with the chunks of docs (source_id, source_type, doc_id, text) in place of theirs.

    Documents that give no chunk keep what they had.
    """
    new = chunked(docs, ["source_id", "source_type", "doc_id"], text_col, **sizes)
    return replace_by_key(existing, new, ["source_type", "source_id"])
