"""Benchmark decontamination as a prefix-filtered join, in DataFrame operations only.

A window (ten consecutive words of an item) is contained in a text only if every shingle of the window is. Ordered by
rarity over the whole corpus, the prefix that a full containment must share is the window's rarest shingle alone. So
each text's shingles are looked up among those rarest shingles; position and length bound where the window would have
to start and end; and the words there are compared one by one.

Windows are broadcast in blocks of a checked size, one pass over the texts for each block; so the texts' words are
never shuffled, and a passage that many texts share makes rows only where it occurs. The pass that counts shingles notes
which texts hold them, so that only texts with a window's rarest shingle are looked at again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, own_exchange, raw_words, spare

#: Words of a shingle; items with fewer words have shingles of all their words.
SHINGLE = 3
#: Bytes of windows that are broadcast at once, as estimated from their words and item lists.
BLOCK_BYTES = 24 << 20
#: Texts whose keys are broadcast to pick them out for the second look; beyond it all texts are looked at again.
MOST_KEYS = 2_000_000


def windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``win, k, hs, items`` per distinct window: its lower-case words, shingle size, shingle hashes, and ids as strings."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.split(F.array_join(raw_words(ascii_lower(F.col(text_col))), " "), " ").alias("w")).where("w[0] <> ''")
    starts = words.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))).alias("at"))
    wins = starts.select("item", F.slice("w", F.col("at"), size).alias("win"))
    grouped = wins.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))
    k = F.least(F.lit(SHINGLE), F.size("win"))
    hashed = F.transform(F.sequence(F.lit(0), F.size("win") - F.col("k")), lambda i: F.xxhash64(F.lower(F.array_join(F.slice("win", i + 1, F.col("k")), " "))))
    return grouped.withColumn("k", k).withColumn("hs", hashed)


def _shingles(docs: DataFrame, k: int) -> DataFrame:
    """A row per place of a text where k words follow: key, words, place, and the shingle's hash.

    Letters outside ASCII are lowered too here, which can only bring more candidates: the check of the words decides.
    The words ride along in generated code and are copied for joined rows alone.
    """
    placed = docs.select("key", "words", F.posexplode("words").alias("at", "w0"))
    parts = ["w0", *(F.get("words", F.col("at") + i) for i in range(1, k))]
    return placed.where(F.col("at") <= F.size("words") - k).select("key", "words", "at", F.xxhash64(F.lower(F.concat_ws(" ", *parts))).alias("h"))


def _blocks(wins: DataFrame) -> int:
    """How many blocks keep each under BLOCK_BYTES."""
    row = F.length(F.array_join("win", " ")) + F.length(F.array_join("items", ",")) + F.lit(200)
    return 1 + int((wins.agg(F.sum(row)).first()[0] or 0) // BLOCK_BYTES)


def _held(docs: DataFrame, parts: DataFrame, blocks: int, sizes: list[int]) -> DataFrame:
    """``h, k, key, n``: how often a text holds a shingle of any window."""
    lookup = parts.select("h", "k").distinct()
    counted = []
    for k in sizes:
        for block in range(blocks):
            these = lookup.where((F.col("k") == k) & (F.pmod(F.col("h"), F.lit(blocks)) == block)).select("h")
            counted.append(_shingles(docs, k).select("key", "h").join(F.broadcast(these), "h").groupBy("h", "key").agg(F.count("*").alias("n")).withColumn("k", F.lit(k)))
    return reduce(DataFrame.unionByName, counted)


def anchored(parts: DataFrame, held: DataFrame) -> DataFrame:
    """``win, items, k, off, h`` per window: its rarest shingle over all documents, and how many words in it stands.

    Ties go to the shingle that comes first.
    """
    counts = held.groupBy("h", "k").agg(F.sum("n").alias("n"))
    return parts.join(counts, ["h", "k"], "left").groupBy("win").agg(F.min_by(F.struct("items", "k", "off", "h"), F.struct(F.coalesce("n", F.lit(0).cast("long")), F.col("off"))).alias("x")).select("win", "x.*")


def _found(docs: DataFrame, anchors: DataFrame, blocks: int, sizes: list[int]) -> DataFrame:
    """``key, start, n, items`` per verified occurrence of a window."""
    out = []
    for k in sizes:
        for block in range(blocks):
            these = anchors.where((F.col("k") == k) & (F.pmod(F.col("h"), F.lit(blocks)) == block)).drop("k")
            met = _shingles(docs, k).join(F.broadcast(these), "h").withColumn("start", F.col("at") - F.col("off"))
            within = met.where((F.col("start") >= 0) & (F.col("start") + F.size("win") <= F.size("words")))
            same = ascii_lower(F.array_join(F.slice("words", F.col("start") + 1, F.size("win")), " ")) == F.array_join("win", " ")
            out.append(within.where(same).select("key", "start", F.size("win").alias("n"), "items"))
    return reduce(DataFrame.unionByName, out)


def hits(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, n_hit, n_items, items`` per distinct (id, text) that holds a window of an item; none where none is held.

    key is a hash of id and text. Null texts have no words. Items with a null id count as an item named by the empty
    string, items without words are none, and repeated items count once. An empty item table gives an empty result. Very
    long texts are read whole. Of equally rare shingles the first of the window is taken, which changes no result.
    """
    thin = docs.select(F.xxhash64(F.col(id_col), F.xxhash64(text_col)).alias("key"), raw_words(F.col(text_col)).alias("words"))
    wins = checkpointed(windows(items, size, item_id, item_text))
    sizes = sorted(r["k"] for r in wins.select("k").distinct().collect())  # SHINGLE values at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], "key long, n_hit long, n_items long, items array<string>")
    blocks = _blocks(wins)
    parts = wins.select("win", "items", "k", F.posexplode("hs").alias("off", "h"))
    held = checkpointed(_held(thin, parts, blocks, sizes))
    anchors = checkpointed(anchored(parts, held))
    # The same text may stand under several anchors; what is counted is what would be broadcast.
    keys = held.join(anchors.select("h", "k").distinct(), ["h", "k"], "left_semi").select("key").distinct()
    again = thin.join(F.broadcast(keys), "key", "left_semi") if keys.count() <= MOST_KEYS else thin
    found = _found(again, anchors, blocks, sizes)
    # Repeated rows find the same places: the set keeps each once, on either side of the shuffle.
    places = found.groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("at"), F.collect_set("items").alias("sets"))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1))))
    ids = F.array_sort(F.array_distinct(F.flatten("sets")))
    return places.select("key", F.size(covered).cast("long").alias("n_hit"), ids.alias("items")).select("key", "n_hit", F.size("items").cast("long").alias("n_items"), "items")


def report(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` per row of docs, repeated rows included."""
    thin = docs.select(F.col(id_col).alias("doc_id"), F.size(raw_words(F.col(text_col))).cast("long").alias("n_words"), F.xxhash64(F.col(id_col), F.xxhash64(text_col)).alias("key"))
    found = hits(docs, items, size, id_col, text_col, **names).withColumn("key", own_exchange(F.col("key")))
    none = F.lit(0).cast("long")
    return thin.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of docs that hold no window of any item, with all their columns."""
    (key,) = spare(docs, "key")
    found = hits(docs, items, size, id_col, text_col, **names).select(own_exchange(F.col("key")).alias(key))
    return docs.withColumn(key, F.xxhash64(F.col(id_col), F.xxhash64(text_col))).join(found, key, "left_anti").drop(key)


#: The same rows from an equality of joined words at every place, without shingles or rarity.
ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
iw AS (SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, sizes)),
hit AS (SELECT DISTINCT doc_id, item, k, p.n FROM places p JOIN wins USING (win)),
pos AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS i FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
