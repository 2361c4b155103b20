"""A training corpus from documents in five stages; each takes (spark, docs, sf_dir) and all but the last return documents' columns.

For every stage: an empty table gives an empty table; texts are read whole, however long; columns of any name beyond
doc_id, text and source pass through untouched. What else a stage does with odd rows stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proseflow.llm import decontaminate, mix, shard, simhash, toxicity
from proseflow.llm.common import checkpointed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the lexicon is learned from all of documents that is labelled.

    Null and empty texts hold no match and stay. Repeated rows and equal texts share their fate, ids (null ones too) and
    sources play no part. Without usable labels only threats are found.
    """
    return toxicity.cleaned(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8): the smallest id.

    Null, empty and blank texts are copies of one another, and one of them stays. A null id comes after all others; ties
    go to the smaller hash of the text. Repeated rows come back once.
    """
    return simhash.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item.

    Null and empty texts have no words and stay; items without words are ignored. Repeated rows
    and null ids are kept or dropped by their text alone. An empty benchmark drops nothing.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says, in shuffled order; each copy is a row.

    A null source is a source of its own; null and empty texts have no bytes but are drawn with the rate of their source.
    Rows of one id and text, repeated ones too, get the same draw; a null id is drawn by its text.
    """
    return mix.replicated(docs).drop("mix_rate", "mix_copy", "mix_key")


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row: equal texts together, shards near equal in bytes.

    Null texts count as empty ones and share a shard with them. Repeated rows get a slot each; ties in size go to the
    group of the smaller digest. Null ids are kept.
    """
    return shard.assign(docs, shards=8)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Learned scores and hash-bit components are beyond SQL; tests hold run() against a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
