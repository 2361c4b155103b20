"""Token counts from an exact length histogram.

Every document is encoded once, and only how many documents have each encoded length is kept. Suffix sums over that
histogram then answer totals, quantiles and truncated totals for every context limit, without looking at a text again.
"""

from __future__ import annotations

import base64
import re
import sys
from collections import Counter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, values

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The split before merges that the vocabularies in ranks form go with; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that are encoded at once; a longer text is cut where encoding cannot cross.
PIECE = 1 << 16
#: Lengths of a block of the histogram whose suffix sums one task forms.
BLOCK = 1 << 8
_ENCODERS: dict = {}
#: Encoding never joins a letter or digit with white space before it, so a text may be cut before that white space.
_CUT = re.compile(r"(?<=[^\W_])(?= [^\W_])")


def vocabulary(path: str) -> bytes:
    """A vocabulary file, read on the driver; a few megabytes at most, it goes out with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes, pattern: str):
    """The encoder of a vocabulary in ranks form, made once for each Python worker."""
    import tiktoken

    key = hash((ranks, pattern))
    if key not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def pieces(text: str):
    """Cuts of a long text whose encodings, one after another, are the encoding of the text."""
    at = 0
    while len(text) - at > PIECE:
        found = _CUT.search(text, at + PIECE)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def length_of(text: str | None, enc) -> int:
    """Tokens of the whole text; special tokens' strings are ordinary text."""
    return sum(len(enc.encode_ordinary(p)) for p in pieces(text)) if text else 0


def lengths(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text") -> DataFrame:
    """``n_tokens, n_docs``: the histogram, written once, so that no later use encodes again.

    Null and empty texts have no tokens; very long ones are encoded in cuts that change nothing; each repeated row counts.
    An empty table gives an empty histogram. Other columns of docs are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        seen: Counter = Counter()
        enc = encoder(sent.value, pattern)
        for batch in batches:
            seen.update(length_of(t, enc) for t in values(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n_tokens long, n long")
    return checkpointed(counted.groupBy("n_tokens").agg(F.sum("n").alias("n_docs")))


def answers(histogram: DataFrame) -> DataFrame:
    """For each length L in the histogram, taken as a context limit: what suffix sums say.

    ``docs_over``, ``tokens_over``: documents longer than L and their tokens; ``truncated_total``: tokens left if every
    text is cut at L; ``quantile``: share of documents of length L at most. Between two neighbouring lengths, the
    truncated total grows by docs_over for each token, so the rows answer every other limit too. Sums are formed in
    blocks of lengths, and only blocks' sums are ordered as a whole.
    """
    h = histogram.withColumns({"tokens": F.col("n_tokens") * F.col("n_docs"), "block": F.floor(F.col("n_tokens") / BLOCK)})
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, 0)
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("bn"), F.sum("tokens").alias("bt"))
    ends = sums.select("block", (F.sum("bn").over(later) - F.col("bn")).alias("after_n"), (F.sum("bt").over(later) - F.col("bt")).alias("after_t"))
    whole = sums.agg(F.sum("bn").alias("all_n"), F.sum("bt").alias("all_t"))  # one row
    inner = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    own = h.withColumns({"in_n": F.sum("n_docs").over(inner) - F.col("n_docs"), "in_t": F.sum("tokens").over(inner) - F.col("tokens")})
    over = own.join(ends, "block").crossJoin(F.broadcast(whole)).withColumns({"docs_over": F.col("in_n") + F.col("after_n"), "tokens_over": F.col("in_t") + F.col("after_t")})
    return over.select(
        "n_tokens", "n_docs", "docs_over", "tokens_over",
        (F.col("all_t") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
        (1 - F.col("docs_over") / F.col("all_n")).alias("quantile"))
