"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most three of 64 bits have a half of 32 bits that differs in at most one. So each
half is indexed under its 32 one-wildcard variants (the half with one bit taken out), fingerprints that meet under
a variant are compared bit by bit, and verified links are united. Only distinct fingerprints are indexed: copies
meet before. Of a variant's bucket no pairs are emitted, only a spanning forest of its verified links.

Copies by the Jaccard similarity of five-word shingles (0.8 or more) are found the same way: segments, one-wildcard
variants, equality, verification. There the places of a segment hold minima of the shingles' hashes instead of bits, as at
that similarity 64 bits differ in about ten places, and segments with one differing bit would have to be too short to tell
texts apart. Two texts at similarity s agree in each place with probability s; a segment of WIDTH places differs in at
most one with s ** 5 + 5 * s ** 4 * (1 - s), 0.737 at 0.8, and all of SEGMENTS fail to with a probability of 2e-5. Members
of a bucket are compared with its first, exactly and each pair once; what that leaves apart is compared with all others.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, own_exchange, spare, values

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a shingle of copies; segments of their signature and places of a segment; hashes that meet all functions at once.
WORDS, SEGMENTS, WIDTH, STEP = 5, 8, 5, 2048
#: Sets that one task compares with another, and sets that are compared with as many others at once, on average.
PART, MOST = 512, 256

#: Hashes of a text whose bits are counted at once, so that a long text needs no more memory than a short one.
BLOCK = 1 << 14
#: Rows of a bucket that are compared with one another at once.
TILE = 1024


_RND = np.random.default_rng(5)
_TIMES = _RND.integers(0, 1 << 63, SEGMENTS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RND.integers(0, 1 << 63, SEGMENTS * WIDTH, dtype=np.uint64) * np.uint64(2)
_FOLD = _RND.integers(0, 1 << 63, (SEGMENTS, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GAP = _RND.integers(0, 1 << 63, (SEGMENTS, WIDTH), dtype=np.uint64)


def fingerprint_of(text: bytes | None) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as a signed long."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    k = min(3, len(words))
    line, at, starts, ends = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    n = len(words) - k + 1
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, BLOCK):
        j = min(n, i + BLOCK)
        hashes = np.array([digest(line[s:e], 42) for s, e in zip(starts[i:j], ends[i + k - 1 : j + k - 1], strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches):
    for batch in batches:
        fps = [fingerprint_of(t) for t in values(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], names=["doc_id", "fp", "th"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, th`` per row: the fingerprint, and a hash of the text that tells rows of one id apart."""
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("th"))
    return thin.mapInArrow(_fingerprints, "doc_id long, fp long, th long")


def variants(fp):
    """The 64 index keys of a fingerprint: half, place of the wildcard, and the half without that bit."""
    def keys(half, part):
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.lit(half << 37).cast("long").bitwiseOR(F.call_function("shiftleft", i.cast("long"), F.lit(32))).bitwiseOR(
            part.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i)))))

    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    return F.concat(keys(0, low), keys(1, high))


def forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, fewer than members, that span the graph of the fingerprints of a bucket.

    Tile against tile, so memory stays bounded. After the first tile has met all others, two members of the largest
    component found so far need not be compared any more; so a dense bucket, as near copies make it, takes time in
    proportion to its size and not to its square.
    """
    n = len(fps)
    label = np.arange(n)
    a, b = [], []

    def meet(xs: np.ndarray, ys: np.ndarray) -> None:
        for i in range(0, len(xs), TILE):
            for j in range(0, len(ys), TILE):
                x, y = xs[i : i + TILE], ys[j : j + TILE]
                near = np.bitwise_count(fps[x][:, None] ^ fps[y][None, :]) <= bits
                for r in np.flatnonzero(near.any(axis=1)):
                    there = y[near[r]]
                    for other in there[np.unique(label[there], return_index=True)[1]]:
                        own, lab = label[x[r]], label[other]
                        if lab != own:
                            a.append(x[r])
                            b.append(other)
                            label[label == max(own, lab)] = min(own, lab)

    every = np.arange(n)
    meet(every[:TILE], every)
    for i in range(TILE, n, TILE):
        most = np.bincount(label).argmax()
        tile, rest = every[i : i + TILE], every[i:]
        inside, outside = tile[label[tile] == most], rest[label[rest] != most]  # before labels change
        meet(tile[label[tile] != most], rest)
        meet(inside, outside)
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _bucket_links(bits: int):
    def links(batches):
        """Buckets from rows sorted by key; a bucket may run over any number of batches."""
        left_k, left_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(keys, fps):
            if not len(keys):
                return None
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
            sizes = ends - starts
            out = []
            pair = starts[sizes == 2]
            if len(pair):
                x, y = fps[pair], fps[pair + 1]
                ok = np.bitwise_count((x ^ y).view(np.uint64)) <= bits
                out.append((x[ok], y[ok]))
            for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
                own = fps[s:e]
                i, j = forest(own.view(np.uint64), bits)
                if len(i):
                    out.append((own[i], own[j]))
            if not out:
                return None
            xs, ys = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
            both = np.unique(np.stack([np.minimum(xs, ys), np.maximum(xs, ys)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([left_k, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([left_f, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(keys):
                continue
            last = np.searchsorted(keys, keys[-1])  # the last bucket may go on in the next batch
            if (r := found(keys[:last], fps[:last])) is not None:
                yield r
            left_k, left_f = keys[last:], fps[last:]
        if (r := found(left_k, left_f)) is not None:
            yield r

    return links


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """``a, b``: verified links that span every component of the distinct fingerprints in column ``fp``."""
    assert 0 <= bits <= 3, "two halves with one wildcard each find at most three differing bits"
    # The number is given, or AQE would put the few bytes of the fingerprints, and so all their keys, into one task.
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keys = spread.select(F.explode(variants(F.col("fp"))).alias("key"), "fp")
    dealt = keys.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_bucket_links(bits), "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, th, root, component_id`` per row of docs; root tells components apart.

    component_id is the smallest id that links reach. Null and empty texts and texts of white space only have
    fingerprint zero and are linked like any other. Rows whose id is null take part, but only lend their id if
    no other row of the component has one. Repeated rows are returned as often as they come; an empty table
    gives an empty table. Very long texts are hashed whole, in blocks. Other columns of docs are not read.
    """
    thin = checkpointed(fingerprints(docs, id_col, text_col))
    classes = checkpointed(thin.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), bits), "a", "b")
    known = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = checkpointed(known)
    ids = known.groupBy("root").agg(F.min("least").alias("component_id")).select(own_exchange(F.col("root")).alias("root"), "component_id")
    by_fp = known.join(ids, "root").select(own_exchange(F.col("fp")).alias("fp"), "root", "component_id")
    return thin.join(by_fp, "fp").select("doc_id", "fp", "th", "root", "component_id")


def _first_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs, one for each root of found (doc_id, th, root): the smallest id, null last, then text hash.

    Rows are told apart by id and text hash; repeated ones come back once.
    """
    best = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "th")).alias("best"))
    row, own, their = spare(docs, "row", "own", "their")
    kept = best.select(F.col("best.doc_id").alias(own), F.col("best.th").alias(their))
    marked = docs.withColumn(row, F.xxhash64(text_col))
    there = marked.join(kept, (F.col(row) == F.col(their)) & F.col(id_col).cast("long").eqNullSafe(F.col(own)), "left_semi")
    return there.dropDuplicates([id_col, row]).drop(row)


def deduplicated(docs: DataFrame, bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one for each component of fingerprints: the one with the smallest id (null last, then text hash).

    All columns stay. Repeated rows come back once.
    """
    return _first_of_each(docs, near_duplicates(docs, bits, id_col, text_col), id_col, text_col)


# ------------------------------------------------------------------ copies by shingle sets

def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def set_of(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles; a text of fewer words is one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mixed(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : i + n])
    return np.unique(out)


def signature_keys(hashes: np.ndarray) -> np.ndarray:
    """The index keys of a set, one for each segment and place of the wildcard; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(SEGMENTS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), STEP):
        np.minimum(least, (hashes[i : i + STEP, None] * _TIMES + _PLUS).min(axis=0), out=least)
    places = _mixed(least).reshape(SEGMENTS, WIDTH) * _FOLD
    return _mixed(places.sum(axis=1, dtype=np.uint64)[:, None] - places + _GAP).reshape(-1).view(np.int64)


def _signed(batches):
    for batch in batches:
        sets, keys = [], []
        for t in values(batch.column(1)):
            h = set_of(t)
            sets.append(xxhash.xxh64_intdigest(h.tobytes(), 42) - (1 << 63))
            keys.append(signature_keys(h))
        offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "th", "sh", "keys"])


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sets' intersection is percent of their union at least."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _with_first(percent: int):
    def run(batches):
        """Links of each part's first row, which holds the hub, with the others; rows come sorted by hub, part and side."""
        now, hub = None, None
        for batch in batches:
            a, b = [], []
            for at, part, side, sh, text in zip(*(values(c) for c in batch.columns), strict=True):
                if side == 0:
                    now, hub = (at, part), set_of(text)
                elif (at, part) == now and alike(hub, set_of(text), percent):
                    a.append(at)
                    b.append(sh)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def tile_links(ids: list[int], sets: list[np.ndarray], others: list[int], their: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between two lists of sets that span what they join; sets are met by a count over postings of their hashes."""
    size = np.array([len(h) for h in their])
    flat, owner = np.concatenate(their), np.repeat(np.arange(len(their)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    label, out = np.arange(len(their)), []
    for i, h in zip(ids, sets, strict=True):
        lo, hi = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
        many = hi - lo
        places = np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        both = np.bincount(owner[places], minlength=len(their))
        near = np.flatnonzero(100 * both >= percent * (len(h) + size - both))
        first = near[np.unique(label[near], return_index=True)[1]]  # one of each component so far
        out += [(i, others[j]) for j in first if others[j] != i]
        if len(first) > 1:
            label[np.isin(label, label[first])] = label[first[0]]
    return out


def _between_tiles(percent: int):
    def run(batches):
        """Links of the sets on either side of a pair of tiles; rows come sorted by key, pair and side."""
        now, sides = None, None

        def found():
            links = tile_links(*sides[0], *sides[1], percent) if sides[0][0] and sides[1][0] else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, i, j, side, sh, text in zip(*(values(c) for c in batch.columns), strict=True):
                if (key, i, j) != now:
                    if now is not None:
                        yield found()
                    now, sides = (key, i, j), (([], []), ([], []))
                sides[side][0].append(sh)
                sides[side][1].append(set_of(text))
        if now is not None:
            yield found()

    return run


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Of pairs (hub, sh) those that no chain of links joins."""
    of = lambda c: roots.select(F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root"))
    told = pairs.join(of("sh"), F.col("sh") == F.col("sh_node"), "left").join(of("hub"), F.col("hub") == F.col("hub_node"), "left")
    return told.where(F.coalesce("sh_root", "sh") != F.coalesce("hub_root", "hub")).select("hub", "sh")


def _rest_links(met: DataFrame, apart: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links of bucket members that are apart from their hub with all members of their buckets, in tiles.

    Buckets of one hub are one group, so that a member comes once for every hub and tile of those to be compared, not once
    for every bucket.
    """
    wide = met.join(met.join(apart, ["hub", "sh"], "left_semi").select("key").distinct(), "key", "left_semi").select("hub", "sh").distinct()
    every = checkpointed(wide.join(apart.withColumn("todo", F.lit(1)), ["hub", "sh"], "left").select("hub", "sh", F.coalesce("todo", F.lit(0)).alias("todo")))
    sizes = every.groupBy("hub").agg(F.ceil(F.sum("todo") / MOST).cast("int").alias("ti"), F.ceil(F.count("*") / MOST).cast("int").alias("tj")).select(own_exchange(F.col("hub")).alias("hub"), "ti", "tj")
    tile = lambda t: F.pmod(F.xxhash64("sh"), F.col(t)).cast("int")
    all_of = lambda t: F.sequence(F.lit(0), F.col(t) - 1)
    left = F.transform(all_of("tj"), lambda j: F.struct(tile("ti").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    right = F.transform(all_of("ti"), lambda i: F.struct(i.alias("i"), tile("tj").alias("j"), F.lit(1).alias("side")))
    placed = every.join(sizes, "hub").select("hub", "sh", F.explode(F.when(F.col("todo") == 1, F.concat(left, right)).otherwise(right)).alias("x")).select("hub", "x.*", "sh")
    dealt = placed.join(texts, "sh").select("hub", "i", "j", "side", "sh", "text").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "side")
    return dealt.mapInArrow(_between_tiles(percent), "a long, b long")


def near_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, root`` per row of docs: a hash of the text, and the component of links at percent or more.

    Null and empty texts and texts of white space only are one component. Very long texts are hashed whole. Rows with
    equal texts or sets are one class from the start; repeated rows are returned as often as they come. Null ids take
    part. An empty table gives an empty table. Other columns of docs are not read.

    No group has to fit into a task: buckets are told by aggregates, members of a bucket meet its hub (the smallest set
    hash) in parts of about PART, and the few that are not joined to it meet all others in tiles of about MOST.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("th"))
    signed = checkpointed(thin.mapInArrow(_signed, "doc_id long, th long, sh long, keys array<long>"))
    classes = signed.groupBy("sh").agg(F.min(F.struct("th", "doc_id")).alias("row"), F.first("keys").alias("keys"))
    keys = classes.select(F.explode("keys").alias("key"), "sh")
    buckets = keys.groupBy("key").agg(F.min("sh").alias("hub"), F.max("sh").alias("last")).where("hub <> last")
    met = checkpointed(keys.join(buckets.select(own_exchange(F.col("key")).alias("key"), "hub"), "key").select("key", "hub", "sh"))
    pairs = checkpointed(met.where("sh <> hub").select("hub", "sh").distinct())

    rows = classes.select("sh", F.col("row.th").alias("own_th"), F.col("row.doc_id").alias("own_id")).join(pairs.select("sh").unionAll(pairs.select(F.col("hub").alias("sh"))).distinct(), "sh")
    texts = thin.join(rows, (F.col("th") == F.col("own_th")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).dropDuplicates(["sh"]).select("sh", "text")
    texts = checkpointed(texts)
    hubs = pairs.groupBy("hub").agg((F.floor(F.count("*") / PART) + 1).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("sh"), F.col("parts")).cast("int")
    others = pairs.join(hubs.select(own_exchange(F.col("hub")).alias("hub"), "parts"), "hub").select("hub", part.alias("part"), F.lit(1).alias("side"), "sh")
    firsts = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("hub").alias("sh"))
    dealt = firsts.unionAll(others).join(texts, "sh").select("hub", "part", "side", "sh", "text").repartition("hub", "part").sortWithinPartitions("hub", "part", "side")
    links_ = checkpointed(dealt.mapInArrow(_with_first(percent), "a long, b long"))
    roots = components(links_, "a", "b")
    apart = checkpointed(_apart(pairs, roots))
    there = roots.select(own_exchange(F.col("node")).alias("sh"), "root")
    found = signed.join(there, "sh", "left").select("doc_id", "th", F.coalesce("root", "sh").alias("root"))
    if apart.isEmpty():
        return found
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    more = _rest_links(met, apart, texts, percent).distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
    over = components(more.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")), "a", "b")
    return found.join(over.select(own_exchange(F.col("node")).alias("was"), F.col("root").alias("now")), F.col("root") == F.col("was"), "left").select("doc_id", "th", F.coalesce("now", "root").alias("root"))


def without_near_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one for each component of near_copies: the one with the smallest id (null last, then text hash).

    All columns stay. Repeated rows come back once.
    """
    return _first_of_each(docs, near_copies(docs, percent, id_col, text_col), id_col, text_col)
