"""Table schemas of the catalog."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_KINDS = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "DATE": T.DateType(), "BOOLEAN": T.BooleanType(), "DOUBLE": T.DoubleType()}


def flat(spec: str) -> T.StructType:
    """A schema of "name KIND" or "name KIND NOT NULL" columns; unlike Spark's own parser it needs no session."""
    columns = [c.split() for c in spec.split(",")]
    return T.StructType([T.StructField(c[0], _KINDS[c[1].upper()], len(c) == 2) for c in columns])


DOCUMENTS = flat("id BIGINT NOT NULL, doc_id STRING, category STRING, meeting_date DATE, pub_date DATE, meeting_label STRING, html_url STRING, pdf_url STRING, doc_text STRING, fetched BOOLEAN, parsed BOOLEAN, scrape_date DATE, raw_html STRING")
SPEECHES = flat("id BIGINT NOT NULL, speech_date DATE, title STRING, speaker STRING, event STRING, link STRING, speech_text STRING, scrape_date DATE, processed BOOLEAN")
CHUNKS = T.StructType([*flat("id BIGINT, source_id BIGINT NOT NULL, source_type STRING NOT NULL, doc_id STRING NOT NULL, chunk_index INT NOT NULL, chunk_text STRING NOT NULL, token_est INT"), T.StructField("embedding", T.ArrayType(T.FloatType()))])
FEATURES = flat("doc_id BIGINT, source_type STRING, date DATE, hawkish_score DOUBLE, n_hawkish BIGINT, n_dovish BIGINT, n_neutral BIGINT, n_target_sentences BIGINT, novelty DOUBLE")
FEED_ITEM = T.StructType([*flat("type STRING, d STRING, dt STRING, mtg STRING, url STRING"), T.StructField("files", T.ArrayType(flat("name STRING, link STRING, url STRING")))])
ISSUE = flat("severity STRING, table STRING, check STRING, count BIGINT, detail STRING")


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Creates the catalog's tables where they don't exist."""
    for name, schema in (("documents", DOCUMENTS), ("speeches", SPEECHES), ("chunks", CHUNKS)):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
