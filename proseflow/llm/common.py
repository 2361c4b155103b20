"""What several operators of this subpackage share: words, row keys, checkpoints and connected components."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseflow.sources.tables import read

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Everything that is no word character once A-Z count as letters; the words between are split out by it.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return read(spark, sf_dir, name)


def raw_words(text: Column) -> Column:
    """The words of a text, case as written: maximal runs of letters, digits and non-ASCII characters.

    Null and empty texts give an empty array. A split can only leave an empty piece at either end.
    """
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NO_WORD, -1), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also change letters outside ASCII)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def values(column, step: int = 256):
    """An Arrow column's values; only so many of them are Python objects at once, as texts may be long."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df is named so (in either case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def hash_of(text: str) -> int:
    """64 bits of a string, the same in every process."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def own_exchange(key: Column) -> Column:
    """The same 64-bit key, but not known to Catalyst as the column its rows are partitioned by.

    A join on it gets a plain exchange on either side, so that AQE can split the partition of a hot key;
    it cannot where one side is the output of an aggregate that is partitioned by that key already.
    """
    return key.bitwiseXOR(F.lit(0).cast("long"))


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder of ``spark.checkpoint.dir`` and cut off from its lineage.

    Where the session names none, a folder in the warehouse is taken, which a cluster shares; in local mode, as in
    tests, a temporary folder that goes when the process ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            named = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints")
    return df.checkpoint(eager=True)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 30))).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung on the smallest node around it."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    mins = both.groupBy("u").agg(F.min("v").alias("m")).select(own_exchange(F.col("u")).alias("u"), F.least("u", "m").alias("m"))
    return both.join(mins, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are hung on the smallest of them."""
    mins = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    there = mins.select(own_exchange(F.col("hi")).alias("hi"), "m")
    moved = edges.join(there, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(mins.select("hi", F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an edge table: ``node, root``, root being the smallest node it can reach.

    Nodes are longs; nodes that are roots of themselves are not returned. Large-star and small-star rounds
    (logarithmic in the number of nodes) run as joins and aggregates until nothing changes; no edge reaches the
    driver, only a count and a hash sum of each round. Empty input gives an empty table.
    """
    now = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    now = checkpointed(now)
    was = _signature(now)
    while was[0]:
        now = checkpointed(_small_star(_large_star(now)))
        sig = _signature(now)
        if sig == was:
            break
        was = sig
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
