"""The queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embed, licenses, mix, secrets, shard, simhash, tokens, toxicity
from .common import table

#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"


def op1_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix.replicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", F.round("mix_rate", 6).alias("rate"), F.col("mix_copy").cast("long").alias("copy"))


def op2_chat_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations")).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "collapsed", "chat")


def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), "toxic_clauses")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["k"])
    n = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, (name, *_) in enumerate(secrets.BASE)]
    return found.select("doc_id", *n, F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("found")).alias("spans"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op7_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokens.vocabulary(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return tokens.answers(tokens.lengths(table(spark, sf_dir, "documents"), ranks, tokens.PATTERN))


def op8_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard.assign(table(spark, sf_dir, "documents"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_poisson_mixing": op1_poisson_mixing,
    "op2_chat_snapshot_collapse": op2_chat_snapshot_collapse,
    "op3_toxicity_grammar": op3_toxicity_grammar,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_secret_battery": op5_secret_battery,
    "op6_license_scan": op6_license_scan,
    "op7_token_histogram": op7_token_histogram,
    "op8_lpt_sharding": op8_lpt_sharding,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_projection_passes": op10_projection_passes,
}

ORACLES: dict[str, str] = {
    "op1_poisson_mixing": mix.oracle(),
    "op2_chat_snapshot_collapse": chat.ORACLE,
    "op4_benchmark_decontamination": decontaminate.ORACLE,
    "op10_projection_passes": embed.ORACLE,
}
