"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Logs often hold a conversation again each time it grew. A turn's hash is bound to its place, so the XOR of the hashes up
to a turn is a rolling hash of the prefix that ends there (two independent lanes, 128 bits). A conversation whose whole
hash is the hash of a proper prefix of another one is dropped by an anti-join, and of equal ones the smallest id stays.
Only ids, places and hashes are shuffled for that; texts are gathered once, for the conversations that are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, own_exchange



def _turns(turns: DataFrame) -> DataFrame:
    """The rows of conversations with an id; null roles read "unknown", null texts are empty, extra columns go."""
    return turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, collapsed``: conversations that no other one continues; of equal ones the smallest id.

    collapsed is the number of other conversations with exactly the same turns.
    """
    thin = _turns(turns).select("conv_id", "turn", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"))
    order = W.partitionBy("conv_id").orderBy("turn", "a", "b")
    again = F.lag(F.struct("turn", "a", "b")).over(order).eqNullSafe(F.struct("turn", "a", "b"))
    once = thin.withColumn("again", again).where("NOT again")
    placed = once.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(W.partitionBy("conv_id")))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rolled = placed.select("conv_id", "k", "n", F.bit_xor(F.xxhash64("k", "a")).over(upto).alias("pa"), F.bit_xor(F.xxhash64("k", "b")).over(upto).alias("pb"))
    rolled = checkpointed(rolled)
    whole = rolled.where("k = n").groupBy("k", "pa", "pb").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("same"))
    longer = rolled.where("k < n").select("k", "pa", "pb").distinct()
    return whole.join(longer, ["k", "pa", "pb"], "left_anti").select("conv_id", F.col("k").alias("n_turns"), (F.col("same") - 1).alias("collapsed"))


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, collapsed, chat`` per maximal conversation, its turns rendered in order.

    Turns are ordered by turn (null first), then role and text. Rows repeated exactly count once. Rows without a
    conv_id belong to no conversation and are left out. A conversation is one row of the result, so its turns are
    gathered in one task; nothing else is. An empty table gives an empty table.
    """
    kept = maximal(turns)
    chosen = kept.select(own_exchange(F.col("conv_id").cast("long")).alias("conv_id"), "n_turns", "collapsed")
    own = _turns(turns).withColumn("conv_id", F.col("conv_id").cast("long")).join(chosen, "conv_id")
    gathered = own.groupBy("conv_id", "n_turns", "collapsed").agg(F.array_sort(F.collect_set(F.struct("turn", F.xxhash64(F.lit(1), "role", "text").alias("a"), "role", "text"))).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n<|end|>\n")))
    return gathered.select("conv_id", "n_turns", "collapsed", F.array_join(lines, "").alias("chat"))


#: The same rows from lists of whole turns instead of hashes.
ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS l FROM t GROUP BY conv_id),
w AS (SELECT l, min(conv_id) AS conv_id, count(*) - 1 AS collapsed FROM c GROUP BY l),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c))
SELECT conv_id, len(l)::BIGINT AS n_turns, collapsed, array_to_string(list_transform(l, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || chr(10) || '<|end|>' || chr(10)), '') AS chat
FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = w.l)
"""
