"""Incremental ingest: new files of a folder, inserted once per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from proseflow.operators.merge import first_per_key


def new_files(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the rows of JSON files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def insert_new(stream: DataFrame, table: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> StreamingQuery:
    """Appends to a Parquet folder, in each batch, the first row of each key that the folder lacks; ends when files do.

    A batch that is tried again finds its keys there already, unless it failed midway, when only the missing are added.
    """
    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = first_per_key(batch, keys, order)
        try:
            there = spark.read.schema(batch.schema).parquet(table)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            there = None
        (fresh if there is None else fresh.join(there.select(*keys), list(keys), "left_anti")).write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, window: str, late: str, key: str) -> DataFrame:
    """``window, key, n``: arrivals per window and key, with rows later than late left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
