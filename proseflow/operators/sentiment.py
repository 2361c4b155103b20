"""Tone of documents: classified target sentences, counted and scored."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseflow.config import CONTRASTIVES, DOVISH_CUES, ECONOMIC_PHRASES, HAWKISH_CUES
from proseflow.functions.text import holds_any, holds_any_lower, normalize, split_sentences

DOVISH, HAWKISH, NEUTRAL = "LABEL_0", "LABEL_1", "LABEL_2"


def lexicon_label(sentence: Column, hawkish: Sequence[str] = HAWKISH_CUES, dovish: Sequence[str] = DOVISH_CUES) -> Column:
    """The offline classifier: a side if only cues of that side occur."""
    up, down = holds_any(sentence, hawkish), holds_any(sentence, dovish)
    return F.when(up & ~down, HAWKISH).when(down & ~up, DOVISH).otherwise(NEUTRAL)


def model_label(load: Callable[[], Callable[[list[str]], list[dict]]], batch: int = 32, max_length: int = 512) -> Callable[[Column], Column]:
    """A classifier loaded once for each Python worker, called with batches of sentences, as a column function.

    load gives a callable as transformers' pipelines are: (sentences, truncation, max_length, batch_size) to labels.
    """

    @F.pandas_udf("string")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            got = model(s.tolist(), truncation=True, max_length=max_length, batch_size=batch) if len(s) else []
            yield pd.Series([g["label"] for g in got], dtype=object)

    def rows(sentence: Column) -> Column:
        return label(sentence)

    rows.by_rows = True  # no column function of elements of an array
    return rows


def sentences(docs: DataFrame, keys: Sequence[str], text_col: str = "text", contrastives: Sequence[str] = CONTRASTIVES) -> DataFrame:
    """``keys, pos, sentence``, from normalized text."""
    return docs.select(*keys, F.posexplode(split_sentences(normalize(F.col(text_col)), contrastives)).alias("pos", "sentence"))


def targets(text_col: str = "text", phrases: Sequence[str] = ECONOMIC_PHRASES, min_length: int = 10, contrastives: Sequence[str] = CONTRASTIVES) -> Column:
    """The sentences of a text that hold a phrase and are longer than min_length, as an array; null for null."""
    both = F.transform(split_sentences(normalize(F.col(text_col)), contrastives), lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))
    found = F.filter(both, lambda x: (F.length(x["s"]) > min_length) & holds_any_lower(x["low"], phrases))
    return F.transform(found, lambda x: x["s"])


def economic_sentences(docs: DataFrame, keys: Sequence[str], **how) -> DataFrame:
    """``keys, pos, sentence``: sentences that hold a phrase and are longer than a minimum; so few reach a classifier."""
    phrases, min_length = how.pop("phrases", ECONOMIC_PHRASES), how.pop("min_length", 10)
    return sentences(docs, keys, **how).where((F.length("sentence") > min_length) & holds_any(F.col("sentence"), phrases))


def scored(docs: DataFrame, keys: Sequence[str], label: Callable[[Column], Column] = lexicon_label, **how) -> DataFrame:
    """``keys, hawkish_score`` and counts for every document; without target sentences all are zero.

    The score is (hawkish - dovish) / targets. Labels that are column expressions are counted within each row, without a
    shuffle; a model's need a row for each sentence, and then keys must tell documents apart.
    """
    kinds = {"n_hawkish": HAWKISH, "n_dovish": DOVISH, "n_neutral": NEUTRAL}
    names = [*kinds, "n_target_sentences"]
    if getattr(label, "by_rows", False):
        told = economic_sentences(docs, keys, **how).withColumn("label", label(F.col("sentence")))
        counts = told.groupBy(*keys).agg(*(F.count_if(F.col("label") == k).alias(n) for n, k in kinds.items()), F.count("*").alias("n_target_sentences"))
        filled = docs.select(*keys).join(counts, list(keys), "left").select(*keys, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names))
    else:
        labels = docs.select(*keys, F.transform(targets(**how), lambda s: label(s)).alias("__labels"))
        n = lambda k: F.size(F.filter("__labels", lambda x: x == k)).cast("long")
        filled = labels.select(*keys, *(F.coalesce(c, F.lit(0).cast("long")).alias(name) for name, c in [*((n_, n(k)) for n_, k in kinds.items()), ("n_target_sentences", F.nullif(F.size("__labels"), F.lit(-1)).cast("long"))]))
    score = F.when(F.col("n_target_sentences") > 0, (F.col("n_hawkish") - F.col("n_dovish")) / F.col("n_target_sentences")).otherwise(F.lit(0.0))
    return filled.select(*keys, score.alias("hawkish_score"), *names)
