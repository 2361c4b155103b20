"""The default stop words: those of Spark's own list for English, asked for once."""

from __future__ import annotations

from functools import lru_cache


@lru_cache(maxsize=1)
def english() -> tuple[str, ...]:
    """Needs a running session, as Spark keeps the list."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))
