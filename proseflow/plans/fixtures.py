"""Small tables written once and given to Spark as rows and to SQL as VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from proseflow.schemas import flat

_SQL = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "double": "DOUBLE"}


class Fixture:
    """Rows and their columns; dates are given as ISO strings."""

    def __init__(self, ddl: str, rows: list[tuple]):
        self.schema, self.rows = flat(ddl), rows

    def frame(self, spark: SparkSession) -> DataFrame:
        loose = T.StructType([T.StructField(f.name, T.StringType() if f.dataType == T.DateType() else f.dataType) for f in self.schema])
        df = spark.createDataFrame(self.rows, loose)
        return df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in self.schema))

    def sql(self) -> str:
        """A subquery with the same rows and types."""
        def lit(v):
            return "NULL" if v is None else str(v) if isinstance(v, (bool, int, float)) else "'" + v.replace("'", "''") + "'"

        names = [f.name for f in self.schema]
        typed = ", ".join(f"v.{f.name}::{_SQL[f.dataType.simpleString()]} AS {f.name}" for f in self.schema)
        return f"(SELECT {typed} FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in self.rows)}) AS v({', '.join(names)}))"


SENTENCES = Fixture("doc_id BIGINT, text STRING", [
    (-1, "Prices rose but hiring slowed."),
    (-2, "However, inflation eased."),
    (-3, "While costs fell, output grew but jobs did not."),
    (-4, "Demand is increasing fast. Tightening went on! Was easing discussed? Abutting lots sold butter."),
    (-5, "GDP up."),
    (-6, ""),
    (-7, "One sentence only, without an end"),
])
FEEDS = Fixture("feed INT, body STRING", [
    (0, '\ufeff{"mtgitems": [{"type": "St", "d": "2024-01-31", "dt": "2024-02-01", "mtg": "January", "files": [{"name": "PDF", "url": "/a.pdf"}, {"name": "HTML", "url": "/a.htm"}]}, {"type": "Mn", "d": "2024-01-31", "dt": "", "files": [{"link": "HTML", "url": "/m.htm"}]}, {"type": "PrC", "d": "2024-01-31", "url": "/p.htm"}]}'),
    (1, '{"mtgitems": [{"type": "St", "d": "2024-01-30", "dt": "2024-02-01", "mtg": "again", "url": "/old.htm"}, {"type": "St", "d": "2010-03-16", "url": "/s.pdf"}, {"type": "Mn", "d": "2010-04-01", "mtg": "neither"}, {"type": "St", "d": "2011-01-02", "dt": "2011-01-03", "url": "/h.htm"}]}'),
    (2, "no JSON at all"),
])
#: The items of FEEDS as a table, for SQL.
FEED_ITEMS = Fixture("feed INT, ord INT, type STRING, d STRING, dt STRING, mtg STRING, html STRING, pdf STRING", [
    (0, 0, "St", "2024-01-31", "2024-02-01", "January", "/a.htm", "/a.pdf"), (0, 1, "Mn", "2024-01-31", "", None, "/m.htm", None), (0, 2, "PrC", "2024-01-31", None, None, "/p.htm", None),
    (1, 0, "St", "2024-01-30", "2024-02-01", "again", "/old.htm", None), (1, 1, "St", "2010-03-16", None, None, None, "/s.pdf"), (1, 2, "Mn", "2010-04-01", None, "neither", None, None), (1, 3, "St", "2011-01-02", "2011-01-03", None, "/h.htm", None),
])
LINKS = Fixture("link STRING, year INT", [("/x/20240131a.htm", 2024), ("/x/none.htm", 2003), ("/x/99999999.htm", 2005), ("/y/19991231and20000101.htm", 1999), ("/z/1234567.htm", 2012), ("/z/123456789012.htm", 2010)])
LISTING = Fixture("entry BIGINT, text STRING", [
    (1, "\n  Title one \n Speaker One\n At a forum \n"), (2, "Title two\nWatch Live\nSpeaker Two\nEvent two\nmore"), (3, "Title three\nSpeaker Three"), (4, "Only a title"), (5, "Title five\nVideo"), (6, ""),
])
SPEAKERS = Fixture("id BIGINT, speaker STRING, event STRING", [
    (1, "Chairman A. Lee", "Forum"), (2, "Vice Chair B. Kim", "Forum"), (3, "Vice Chairman C. Roy", "Dinner"), (4, "Governor D. Poe", None), (5, "At the Annual Forum", "Governor E. Fox"), (6, None, "Nowhere"),
    (7, "The Honorable Chairman Bernanke", "House"), (8, "President G. Hall", "At home"), (9, "At a place", None),
])
