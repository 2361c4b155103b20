"""Consolidation of two catalogs into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseflow.operators.merge import consolidated
from proseflow.operators.quality import table_counts


def consolidate(speeches_db: dict[str, DataFrame | None], documents_db: dict[str, DataFrame | None], legacy_id_collision: bool = False) -> dict[str, DataFrame | None]:
    """speeches, documents and chunks of both; tables that are missing are tolerated.

    Chunks are told apart by source and place, or, with legacy_id_collision, by their ids, so that colliding ones of
    the second catalog are lost as they once were.
    """
    chunk_keys = ["id"] if legacy_id_collision else ["source_type", "source_id", "chunk_index"]
    parts = [speeches_db.get("chunks"), documents_db.get("chunks")]
    out = {"speeches": speeches_db.get("speeches"), "documents": documents_db.get("documents"), "chunks": consolidated(parts, chunk_keys) if any(p is not None for p in parts) else None}
    return {k: (consolidated([v], ["id"]) if v is not None and k != "chunks" else v) for k, v in out.items()}


def report(before: dict[str, DataFrame | None], after: dict[str, DataFrame | None]) -> DataFrame:
    """Row counts before and after."""
    return table_counts(before).select(F.lit("source").alias("stage"), "table", "n_rows").unionByName(table_counts(after).select(F.lit("target").alias("stage"), "table", "n_rows"))
