"""Speakers, links, dates and ids as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseflow.functions.text import strip


def role(speaker: Column) -> Column:
    """Rank by the first title that the name holds; null and others read Other."""
    has = lambda t: F.coalesce(F.contains(speaker, F.lit(t)), F.lit(False))
    return F.when(has("Vice Chair"), "Vice Chairman").when(has("Chairman"), "Chairman").when(has("Governor"), "Governor").otherwise("Other")


#: Titles in the order they are taken out, which leaves "man X" of a Vice Chairman X.
TITLES = ("Vice Chair", "Vice Chairman", "Chairman", "Governor")


def without_titles(speaker: Column, titles: Sequence[str] = TITLES) -> Column:
    for t in titles:
        speaker = strip(F.replace(speaker, F.lit(t), F.lit("")))
    return speaker


def misplaced(speaker: Column, prefix: str = "At") -> Column:
    """Whether a place stands where the speaker should; null is no."""
    return F.coalesce(speaker.startswith(prefix), F.lit(False))


def date_of_link(link: Column, year: Column) -> tuple[Column, Column]:
    """(date, date_error): the first eight digits as a date, Jan 1 of the year without them; wrong dates are flagged."""
    digits = F.regexp_extract(link, "[0-9]{8}", 0)
    found = F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")
    return F.when(digits == "", F.make_date(year, F.lit(1), F.lit(1))).otherwise(found), (digits != "") & found.isNull()


def listing_url(base: str, year: Column, last_old: int = 2010) -> Column:
    """Address of a year's listing: its form changed after last_old."""
    stem = F.concat(F.lit(f"{base}/newsevents/speech/"), year.cast("string"))
    return F.when(year <= last_old, F.concat(stem, F.lit("speech.htm"))).otherwise(F.concat(stem, F.lit("-speeches.htm")))


def listing_address(base: str, year: int, last_old: int = 2010) -> str:
    """The same for one year, as a string."""
    return f"{base}/newsevents/speech/{year}" + ("speech.htm" if year <= last_old else "-speeches.htm")


def item_id(kind: Column, dt: Column, d: Column) -> Column:
    """Kind and publication date (meeting date if that is empty) without dashes."""
    return F.concat(kind, F.lit("_"), F.replace(F.coalesce(F.nullif(dt, F.lit("")), d, F.lit("unknown")), F.lit("-"), F.lit("")))


def item_urls(base: str, files: Column, url: Column) -> tuple[Column, Column]:
    """(html, pdf): of files, the first labelled so by name or else link; of a single address, by its ending."""
    label = lambda f: F.coalesce(F.nullif(f["name"], F.lit("")), F.nullif(f["link"], F.lit("")), F.lit(""))
    first = lambda kind: F.get(F.filter(files, lambda f: label(f) == kind), F.lit(0))["url"]
    at = F.concat(F.lit(base), url)
    pdf = url.endswith(".pdf")
    html = F.when(files.isNotNull(), F.concat(F.lit(base), first("HTML"))).when(~pdf, at)
    return html, F.when(files.isNotNull(), F.concat(F.lit(base), first("PDF"))).when(pdf, at)


def event_parts(text: Column, skipped: Sequence[str] = ("Watch Live", "Video")) -> Column:
    """(title, speaker, event) of an entry's lines; event is empty where absent; null where lines don't suffice."""
    parts = F.array_remove(F.transform(F.split(text, "\n", -1), strip), "")

    def told(p):
        at = F.when(F.get(p, F.lit(1)).isin(list(skipped)), 2).otherwise(1)
        found = F.struct(F.get(p, F.lit(0)).alias("title"), F.get(p, at).alias("speaker"), F.coalesce(F.get(p, at + 1), F.lit("")).alias("event"))
        return F.when(F.size(p) > at, found)

    return F.transform(F.array(parts), told)[0]
