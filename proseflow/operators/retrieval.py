"""Nearest neighbours of query vectors, by brute force, a block of queries at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of query vectors that are broadcast at once, in expectation.
BLOCK_BYTES = 32 << 20


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null where the lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)


def unit(v: Column) -> Column:
    """The vector in double precision, divided by its norm; null where that is 0."""
    norm = F.nullif(F.sqrt(dot(v, v)), F.lit(0.0))
    return F.when(norm.isNotNull(), F.transform(v, lambda x: x.cast("double") / norm))


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, vec_id, rank, score``: of all other vectors the k nearest by cosine to each query (ties by id).

    The corpus isn't shuffled: queries go to it in blocks of a bounded size, told by a hash of their ids, each in a pass of
    its own. Each partition keeps its k nearest for each query before those are brought together (Spark puts a group
    limit before the shuffle). Norms are taken once per vector.
    """
    size = queries.agg(F.count("*").alias("n"), F.max(F.size(vec_col)).alias("width")).first()
    blocks = max(1, -(-size["n"] * max(size["width"] or 0, 1) * 8 // BLOCK_BYTES))
    asked = queries.select(F.col(id_col).alias("query_id"), unit(F.col(vec_col)).alias("__q"))
    there = corpus.select(id_col, unit(F.col(vec_col)).alias("__v"))
    block = lambda i: F.broadcast(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i))
    pairs = [there.join(block(i), F.col(id_col) != F.col("query_id")).select("query_id", id_col, dot(F.col("__q"), F.col("__v")).alias("score")) for i in range(blocks)]
    ranked = reduce(DataFrame.unionAll, pairs).where("score IS NOT NULL").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), id_col)))
    return ranked.where(F.col("rank") <= k).select("query_id", id_col, "rank", "score")
