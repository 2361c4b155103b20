"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) go, largest first, to the shard with the least bytes so far, by a heap.
Groups of one size are alike to that heap, so it is fed size classes with their counts, which are bounded in number,
instead of groups: sizes up to ``1 << BITS`` are classes of their own, above it a class spans one part in ``1 << BITS``
of its size. What the heap gives each shard of a class is then dealt out by the groups' ranks in the class, and ranks
and slots are prefix sums over hash buckets, so no class, shard or group of copies has to fit into one task.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

#: Bits of a group's size that tell classes apart: 54 << BITS classes at most, 55,296 of about 100 bytes.
BITS = 10
#: Rows of a bucket, on average, in which ranks are counted by one task.
BUCKET_ROWS = 4_000


def size_class(size: Column) -> Column:
    """The size with all but its leading bits cleared."""
    extra = F.greatest(F.lit(0), F.length(F.bin(size)) - F.lit(BITS + 1))
    return F.call_function("shiftleft", F.call_function("shiftright", size, extra), extra)


def schedule(classes: list[tuple[int, int, int]], shards: int) -> dict[int, list[int]]:
    """How many groups of each class (class, groups, bytes) each shard gets; longest first, to the least loaded.

    Ties go to the smaller shard number. Once loads lie within one group's size of each other, every further group
    of that size goes round, so whole rounds are dealt at once.
    """
    heap = [(0.0, s) for s in range(shards)]
    out = {}
    for cls, count, total in sorted(classes, reverse=True):
        size, got = total / count, [0] * shards
        while count and max(heap)[0] - heap[0][0] > size:
            load, s = heap[0]
            room = sorted(heap)[1][0] - load  # it stays the least loaded until it has caught up with the next
            fit = min(count, max(1, int(room // size)))
            heapq.heapreplace(heap, (load + fit * size, s))
            got[s] += fit
            count -= fit
        rounds, rest = divmod(count, shards)
        heap = [(load + rounds * size, s) for load, s in heap]
        heapq.heapify(heap)
        got = [g + rounds for g in got]
        for _ in range(rest):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            got[s] += 1
        out[cls] = got
    return out


def _ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[str], weight: str, name: str) -> DataFrame:
    """Adds, under name, the sum of weight over the rows of the same keys before this one, by bucket and then order."""
    dealt = df.withColumn("__b", bucket)
    per = dealt.groupBy(*keys, "__b").agg(F.sum(weight).alias("__w"))
    base = per.withColumn("__base", F.sum("__w").over(W.partitionBy(*keys).orderBy("__b")) - F.col("__w")).drop("__w")
    inner = W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = dealt.withColumn("__own", F.sum(weight).over(inner) - F.col(weight))
    return own.join(base, [*keys, "__b"]).withColumn(name, F.col("__base") + F.col("__own")).drop("__b", "__base", "__own")


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` per row of docs.

    size is the UTF-8 bytes of the text plus one. Rows with equal texts (null counts as empty here) share a shard;
    slots run without gaps from 0 in each shard. Repeated rows get a slot each, next to one another. Null ids are
    allowed. An empty table gives an empty table. Other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("digest"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = checkpointed(thin.groupBy("doc_id", "digest", "size", "text_crc32").agg(F.count("*").alias("copies")))
    groups = rows.groupBy("digest").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("bytes")).withColumn("cls", size_class(F.col("bytes")))
    groups = checkpointed(groups)
    found = groups.groupBy("cls").agg(F.count("*").alias("count"), F.sum("bytes").alias("total"), F.sum("n").alias("n")).collect()  # 54 << BITS rows at most
    plan = schedule([(r["cls"], r["count"], r["total"]) for r in found], shards)
    total, most = sum(r["n"] for r in found), max((r["count"] for r in found), default=0)

    spans = []
    for cls, got in plan.items():
        upto = 0
        cut = []
        for g in got:
            upto += g
            cut.append(upto)
        spans.append((cls, cut))
    cuts = docs.sparkSession.createDataFrame(spans, "cls long, cuts array<long>")
    in_class = F.pmod(F.xxhash64("digest"), F.lit(1 + most // BUCKET_ROWS))
    one = groups.select("digest", "cls", F.lit(1).cast("long").alias("one"))
    ranked = _ranked(one, ["cls"], in_class, ["digest"], "one", "rank").join(F.broadcast(cuts), "cls")
    placed = ranked.select(F.concat("digest", F.lit("")).alias("digest"), F.size(F.filter("cuts", lambda c: c <= F.col("rank"))).alias("shard"))
    dealt = rows.join(placed, "digest")
    in_shard = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(64 + total // (shards * BUCKET_ROWS)))
    slotted = _ranked(dealt, ["shard"], in_shard, ["doc_id", "digest"], "copies", "first")
    return slotted.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("slot"))
