"""Command line: features, documents, speeches, check, consolidate.

A catalog is a folder with documents.parquet, speeches.parquet and chunks.parquet in any store that Spark reads.
"""

from __future__ import annotations

import argparse
import datetime
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proseflow import schemas
from proseflow.functions import names
from proseflow.operators import quality
from proseflow.operators.frames import checkpointed
from proseflow.plans import catalog, features, ingest
from proseflow.sources import feeds, pages, tables


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    try:
        return tables.read(spark, folder, name)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _known(spark: SparkSession, folder: str, name: str) -> DataFrame:
    found = _table(spark, folder, name)
    return found if found is not None else schemas.empty(spark, {"documents": schemas.DOCUMENTS, "speeches": schemas.SPEECHES}[name])


def _save(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def run_features(spark, a) -> int:
    parts = []
    if "speeches" in a.source_types:
        parts.append(tables.speech_records(_known(spark, a.catalog, "speeches"), a.limit))
    if "documents" in a.source_types:
        parts.append(tables.document_records(_known(spark, a.catalog, "documents"), a.limit))
    wrote = features.write(features.features(tables.attached(*parts)), a.out, a.by_source)
    print(f"features written to {a.out}" if wrote else "no records found; nothing written")
    return 0


def run_documents(spark, a) -> int:
    """Discovery from feed files, fetching, parsing. Each run reads one folder and writes another."""
    table = _known(spark, a.catalog, "documents")
    every = not (a.discovery_only or a.fetch_only or a.parse_only)
    if every or a.discovery_only:
        table = checkpointed(ingest.discover_documents(table, feeds.read(spark, a.feeds), a.base_url, categories=tuple(a.categories)))
    if every or a.fetch_only:
        table = ingest.fetch_documents(table, pages.polite(a.get, a.delay), a.limit)
    if every or a.parse_only:
        table = ingest.parse_documents(table)
    _save(table, a.out, "documents")
    return 0


def run_speeches(spark, a) -> int:
    """Discovery from the listing pages of some years, fetching of texts."""
    table = _known(spark, a.catalog, "speeches")
    every = not (a.discovery_only or a.fetch_only)
    if every or a.discovery_only:
        last = a.end_year or datetime.date.today().year
        urls = {y: names.listing_address(a.base_url, y) for y in range(a.start_year, last + 1)}
        table = ingest.discover_speeches(table, pages.listing_pages(spark, urls, pages.polite(a.get, a.delay)), a.base_url)
        table = checkpointed(table)  # entries found today are queued and updated below
    if every or a.fetch_only:
        table = ingest.fetch_speeches(table, pages.polite(a.get, a.delay), a.limit)
    _save(table, a.out, "speeches")
    return 0


def run_check(spark, a) -> int:
    issues = {"documents": lambda: quality.check_documents(_known(spark, a.catalog, "documents")), "speeches": lambda: quality.check_speeches(_known(spark, a.catalog, "speeches"))}
    bad = False
    for name in ("documents", "speeches") if a.table == "all" else (a.table,):
        found = issues[name]().persist()
        print(quality.summary(found, name))
        bad = bad or quality.has_errors(found)
        found.unpersist()
    return int(bad)


def run_consolidate(spark, a) -> int:
    first, second = ({n: _table(spark, f, n) for n in ("speeches", "documents", "chunks")} for f in (a.speeches_catalog, a.documents_catalog))
    merged = catalog.consolidate(first, second, a.legacy_id_collision)
    catalog.report({"speeches": first["speeches"], "documents": second["documents"], "chunks": first["chunks"]}, merged).show(truncate=False)
    if not a.dry_run:
        for name, df in merged.items():
            if df is not None:
                _save(df, a.out, name)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="proseflow", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("features")
    f.add_argument("--catalog", required=True)
    f.add_argument("--out", required=True)
    f.add_argument("--source-types", nargs="+", default=["speeches", "documents"], choices=["speeches", "documents"])
    f.add_argument("--limit", type=int, default=None, help="records of each source; 0 means all")
    f.add_argument("--by-source", action="store_true")
    f.set_defaults(run=run_features)
    d = sub.add_parser("documents")
    d.add_argument("--catalog", required=True)
    d.add_argument("--out", required=True)
    d.add_argument("--feeds", nargs="+", default=[])
    d.add_argument("--base-url", default="")
    d.add_argument("--categories", nargs="+", default=["St", "Mn"])
    stage = d.add_mutually_exclusive_group()
    for name in ("--discovery-only", "--fetch-only", "--parse-only"):
        stage.add_argument(name, action="store_true")
    d.add_argument("--limit", type=int, default=None, help="pages to fetch; 0 means all")
    d.add_argument("--delay", type=float, default=1.5)
    d.set_defaults(run=run_documents)
    s = sub.add_parser("speeches")
    s.add_argument("--catalog", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--base-url", default="")
    s.add_argument("--start-year", type=int, default=1996)
    s.add_argument("--end-year", type=int, default=None)
    stage = s.add_mutually_exclusive_group()
    for name in ("--discovery-only", "--fetch-only"):
        stage.add_argument(name, action="store_true")
    s.add_argument("--limit", type=int, default=None, help="speeches to fetch; 0 means all")
    s.add_argument("--delay", type=float, default=2.0)
    s.set_defaults(run=run_speeches)
    c = sub.add_parser("check")
    c.add_argument("--catalog", required=True)
    c.add_argument("--table", choices=["documents", "speeches", "all"], default="all")
    c.set_defaults(run=run_check)
    m = sub.add_parser("consolidate")
    m.add_argument("--speeches-catalog", required=True)
    m.add_argument("--documents-catalog", required=True)
    m.add_argument("--out", required=True)
    m.add_argument("--dry-run", action="store_true")
    m.add_argument("--legacy-id-collision", action="store_true")
    m.set_defaults(run=run_consolidate)
    return p


def main(argv: list[str] | None = None, get: Callable[[str], str | None] = pages.http_get) -> int:
    a = parser().parse_args(argv)
    a.get = get
    return a.run(SparkSession.builder.appName("proseflow").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
