"""Completeness checks: all counts of a table in one pass, one row for each check that found something."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")

#: severity, check, detail, condition; the first three are fixed values.
DOCUMENT_CHECKS = (
    ("error", "missing_meeting_date", "documents have no meeting_date", lambda: F.col("meeting_date").isNull()),
    ("error", "missing_html_and_pdf_url", "documents have neither html_url nor pdf_url", lambda: F.col("html_url").isNull() & F.col("pdf_url").isNull()),
    ("warning", "not_fetched", "documents discovered but not yet fetched", lambda: ~F.col("fetched")),
    ("warning", "fetched_not_parsed", "documents fetched but not parsed", lambda: F.col("fetched") & ~F.col("parsed")),
    ("error", "parsed_empty_text", "parsed documents with empty text", lambda: F.col("parsed") & _blank("doc_text")),
)
SPEECH_CHECKS = (
    ("error", "missing_speech_date", "speeches have no speech_date", lambda: F.col("speech_date").isNull()),
    ("error", "missing_link", "speeches have no link", lambda: F.col("link").isNull() | (F.col("link") == "")),
    ("warning", "no_text_fetched", "speeches with no fetched text", lambda: _blank("speech_text")),
    ("error", "missing_speaker", "speeches missing speaker name", lambda: _blank("speaker")),
)


def _checked(df: DataFrame, table: str, checks) -> DataFrame:
    counts = df.agg(*(F.count_if(cond()).alias(f"c{i}") for i, (*_, cond) in enumerate(checks)))
    issue = lambda i, severity, check, detail: F.struct(F.lit(severity).alias("severity"), F.lit(table).alias("table"), F.lit(check).alias("check"), F.col(f"c{i}").alias("count"), F.lit(detail).alias("detail"))
    return counts.select(F.inline(F.array(*(issue(i, *c[:3]) for i, c in enumerate(checks))))).where("count > 0")


def check_documents(documents: DataFrame) -> DataFrame:
    return _checked(documents, "documents", DOCUMENT_CHECKS)


def check_speeches(speeches: DataFrame) -> DataFrame:
    return _checked(speeches, "speeches", SPEECH_CHECKS)


def check_all(documents: DataFrame, speeches: DataFrame) -> DataFrame:
    return check_documents(documents).unionByName(check_speeches(speeches))


def has_errors(issues: DataFrame) -> bool:
    """Whether a run should end with exit code 1."""
    return bool(issues.agg(F.bool_or(F.col("severity") == "error")).first()[0])


def summary(issues: DataFrame, label: str) -> str:
    """The findings of a catalog, a line each (nine at most), under a line with totals."""
    rows = issues.collect()
    errors = sum(r["severity"] == "error" for r in rows)
    head = f"{label}: {errors} error(s), {len(rows) - errors} warning(s)" if rows else f"{label}: complete"
    return "\n".join([head, *(f"  {r['severity']:7} {r['table']}.{r['check']} {r['count']} ({r['detail']})" for r in rows)])


def null_counts(df: DataFrame) -> DataFrame:
    """``column, nulls`` for every column, in one pass."""
    counts = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns))))


def overview(df: DataFrame) -> DataFrame:
    """``column, dtype, non_null, n_rows`` for every column, in one pass."""
    counts = df.agg(F.count("*").alias("__n"), *(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"`{c}`").alias("non_null"), F.col("__n").alias("n_rows")) for c, t in df.dtypes]
    return counts.select(F.inline(F.array(*rows)))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, n_rows`` for each table; a missing one (None) counts 0."""
    spark = next(t for t in tables.values() if t is not None).sparkSession
    parts = [(t.agg(F.count("*").alias("n_rows")) if t is not None else spark.sql("SELECT 0L AS n_rows")).select(F.lit(name).alias("table"), "n_rows") for name, t in tables.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
