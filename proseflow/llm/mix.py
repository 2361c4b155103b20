"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source has a rate: its target weight's share of the bytes wanted, over the bytes it has. A document of it is
repeated as often as a Poisson variable with that mean says, drawn by inverting the distribution at a number hashed
from seed and document. So the draw needs no state, is the same on every run and after any retry, and copies are
dealt out by a hash of document, copy and seed: a global shuffle in which no source or document stays together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, spare

#: Means above this are split into parts of at most this size, whose draws add up.
PART = 32
#: Terms of the distribution that are summed: beyond them lies less than 1e-15 of a mean of PART.
TERMS = 96
#: Largest size, in bytes, of the rates that are broadcast; beyond it documents are joined with salted rates.
BROADCAST_BYTES = 8 << 20
SALTS = 64


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(mean: Column, u: Column) -> Column:
    """The smallest k whose cumulative probability exceeds u, for a mean of PART at most."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c"))

    def step(s, k):
        p = s["p"] * mean / k
        return F.when(u < s["c"], s).otherwise(F.struct((s["k"] + 1).alias("k"), p.alias("p"), (s["c"] + p).alias("c")))

    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(TERMS), (F.lit(12) + mean * 3).cast("int"))), start, step, lambda s: s["k"])


def shares(docs: DataFrame, weights: dict[str, float] | None, temperature: float, source_col: str, text_col: str, epochs: float) -> DataFrame:
    """``source, rate``: mean repetitions of a document of each source.

    weights names a share for each source (others get none); without it, a source's share is its bytes to the power
    temperature. A null source is a source of its own, here named by null; a source without bytes has rate 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.octet_length(text).cast("long")).alias("bytes"))
    sized = checkpointed(sized)
    if weights is None:
        want = F.pow(F.col("bytes").cast("double"), F.lit(temperature))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "named string, want double")
        sized = sized.join(given, F.col("source").eqNullSafe(F.col("named")), "left").drop("named")
        want = F.coalesce("want", F.lit(0.0))
    sums = sized.agg(F.sum("bytes").alias("b"), F.sum(want).alias("w")).first()
    total, whole = float(sums["b"] or 0), float(sums["w"] or 0)
    if not total or not whole:
        return sized.select("source", F.lit(0.0).alias("rate"))
    return sized.select("source", F.when(F.col("bytes") > 0, want / F.lit(whole) * F.lit(total * epochs) / F.col("bytes")).otherwise(F.lit(0.0)).alias("rate"))


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, epochs: float = 1.0, seed: int = 17,
               id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """All columns of docs, each row as often as drawn, with ``mix_rate``, ``mix_copy`` (from 0) and ``mix_key``, in shuffled order.

    Rows of one partition are ordered by mix_key, and partitions are dealt by it. Repeated rows (same id and text) get
    the same draw. Null ids are drawn by their text, null texts count as empty (a row of a source that has bytes can
    still be drawn). Very long texts count with all their bytes and are copied whole. Columns of those three names are
    replaced, others of any name stay. An empty table gives an empty table.
    """
    source, salt, of, times = spare(docs, "rate_source", "salt", "salt_of", "times")
    rates = checkpointed(shares(docs, weights, temperature, source_col, text_col, epochs).select(F.col("source").alias(source), F.col("rate").alias("mix_rate")))
    size = rates.agg(F.sum(F.coalesce(F.octet_length(source), F.lit(0)) + 32).alias("b")).first()["b"] or 0
    rows = docs.drop("mix_rate", "mix_copy", "mix_key")
    on = F.col(source_col).eqNullSafe(F.col(source))
    if size <= BROADCAST_BYTES:
        rated = rows.join(F.broadcast(rates), on).drop(source)
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn(of, F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS)).cast("int"))
        rated = dealt.join(salted, on & (F.col(of) == F.col(salt))).drop(source, of, salt)
    own = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / PART)).cast("int")
    draws = F.transform(F.sequence(F.lit(1), pieces), lambda i: poisson(F.col("mix_rate") / pieces, uniform(own, i.cast("string"))))
    count = F.aggregate(draws, F.lit(0), lambda a, x: a + x)
    copies = rated.withColumn(times, count).where(F.col(times) > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col(times) - 1))).drop(times)
    keyed = copies.withColumn("mix_key", F.xxhash64(own, "mix_copy"))
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "mix_key").sortWithinPartitions("mix_key")


def oracle(temperature: float = 0.7, epochs: float = 1.0, seed: int = 17) -> str:
    """The query's rows as DuckDB SQL: same rates, same hashes, and the distribution's cumulative sums."""
    return f"""
WITH s AS (SELECT source, sum(octet_length(encode(text))) AS bytes FROM documents GROUP BY source),
t AS (SELECT sum(bytes)::DOUBLE AS b, sum(pow(bytes::DOUBLE, {temperature})) AS w FROM s),
r AS (SELECT source, CASE WHEN bytes > 0 THEN pow(bytes::DOUBLE, {temperature}) / w * (b * {epochs}) / bytes ELSE 0 END AS rate FROM s, t),
p AS (SELECT source, rate, greatest(1, ceil(rate / {PART}))::INT AS pieces FROM r),
k AS (SELECT source, j, CASE WHEN j = 0 THEN exp(-rate / pieces) ELSE exp(j * ln(greatest(rate, 1e-300) / pieces) - rate / pieces - lgamma(j + 1)) END AS q
      FROM p, range(0, {TERMS + 1}) AS g(j)),
c AS (SELECT source, j, sum(q) OVER (PARTITION BY source ORDER BY j) AS cum FROM k),
d AS (SELECT doc_id, source, rate, i, ('0x' || substr(md5('{seed}:' || doc_id || ':' || i), 1, 13))::BIGINT / {float(1 << 52)!r} AS u
      FROM documents JOIN p USING (source), range(1, 1000) AS g(i) WHERE i <= pieces),
n AS (SELECT doc_id, d.source, rate, i, count(*) FILTER (WHERE cum <= u) AS n FROM d JOIN c ON c.source = d.source GROUP BY ALL),
m AS (SELECT doc_id, source, rate, sum(n) AS n FROM n GROUP BY ALL)
SELECT doc_id, source, round(rate, 6) AS rate, g.copy AS copy FROM m, range(0, 10000) AS g(copy) WHERE g.copy < m.n
"""
