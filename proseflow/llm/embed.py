"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a key of concatenated random hashes (signs of projections), vectors are ordered by it,
and each is compared with a bounded window of those that follow. Verified pairs are united across passes. Passes come in
rounds, each with twice the window of the one before, until a round joins nothing more that was apart: how many are needed
follows from the vectors, rising with their number and where many lie close together. The window bounds the work of a
pass, not the partners of a vector: once components are known, the vectors of each component are compared with all others
of it, in blocks, which counts the links that no window held too. Equal vectors are one class with a count from the start.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, own_exchange

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors of a component that are compared with as many others at once.
TILE = 512


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of double-precision vectors of one length, each divided by its norm."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # or squares of large or small components would overflow or vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(batch: pa.RecordBatch, vec: int):
    """The batch in parts whose vectors have one length each."""
    size = np.array([len(v) for v in batch.column(vec)], dtype=np.int64)
    for n in np.unique(size):
        yield int(n), batch.filter(pa.array(size == n))


def _keys(passes: range, seed: int):
    planes: dict = {}

    def run(batches):
        """A row per vector and pass: length, pass, key, class, vector."""
        for batch in batches:
            if not batch.num_rows:
                continue
            for dim, part in _by_length(batch, 1):
                x = _unit(part.column(1))
                for p in passes:
                    if (dim, p) not in planes:
                        planes[dim, p] = np.random.default_rng([seed, dim, p]).standard_normal((dim, 63))
                    bits = (x @ planes[dim, p]) > 0
                    key = (bits.astype(np.int64) << np.arange(62, -1, -1, dtype=np.int64)).sum(axis=1)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, p, np.int32)), pa.array(key), part.column(0), part.column(1)], names=["dim", "pass", "key", "cls", "embedding"])

    return run


def _window_links(threshold: float, window: int):
    def run(batches):
        """Links in rows sorted by length, pass and key; each row with the window rows that follow, over batches too."""
        kept = None

        def found(dim, ids, x):
            out_a, out_b = [], []
            for i in range(0, len(ids), window):
                a, b = x[i : i + window], x[i : i + 2 * window]
                near = (a @ b.T) >= threshold
                rows, cols = np.nonzero(near)
                ok = (cols > rows) & (cols - rows <= window)
                rows, cols = rows[ok], cols[ok]
                # Each row is hung on the first that it links with: a chain through the window instead of all its pairs.
                if len(rows):
                    label = np.arange(len(b))
                    while True:
                        was = label.copy()
                        np.minimum.at(label, cols, label[rows])
                        np.minimum.at(label, rows, label[cols])
                        if (label == was).all():
                            break
                    moved = np.flatnonzero(label != np.arange(len(b)))
                    out_a.append(ids[i + label[moved]])
                    out_b.append(ids[i + moved])
            return np.concatenate(out_a or [np.empty(0, np.int64)]), np.concatenate(out_b or [np.empty(0, np.int64)])

        def parts(batches):
            """One array of ids and vectors for each (length, pass), the last window rows of a batch coming again."""
            nonlocal kept
            for batch in batches:
                if not batch.num_rows:
                    continue
                tag = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
                cuts = np.flatnonzero((np.diff(tag, axis=0) != 0).any(axis=1)) + 1
                for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(tag)], strict=True):
                    part = batch.slice(s, e - s)
                    ids, x = part.column(3).to_numpy(), _unit(part.column(4))
                    if kept is not None and kept[0] == tuple(tag[s]):
                        ids, x = np.concatenate([kept[1], ids]), np.concatenate([kept[2], x])
                    kept = (tuple(tag[s]), ids[-window:], x[-window:])
                    yield tag[s][0], ids, x

        for dim, ids, x in parts(batches):
            a, b = found(dim, ids, x)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _tile_counts(threshold: float):
    def run(batches):
        """Links of each class with the others in its pair of tiles, from rows sorted by component and tile pair."""
        left = None

        def counted(ids, ns, side, x):
            a, b = side == 0, side == 1
            near = (x[a] @ x[b].T) >= threshold
            own = ids[a][:, None] == ids[b][None, :]
            to_a = (near & ~own) @ ns[b]
            to_b = (near & ~own).T @ ns[a]
            return ids[a], to_a, ids[b], to_b

        def emitted(rows):
            at = rows["at"]
            cuts = np.flatnonzero((np.diff(at, axis=0) != 0).any(axis=1)) + 1
            ids, n = [], []
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(at)], strict=True):
                same = at[s][1] == at[s][2]
                ia, na, ib, nb = counted(rows["cls"][s:e], rows["n"][s:e], rows["side"][s:e], rows["x"][s:e])
                ids.append(ia)
                n.append(na)
                if not same:
                    ids.append(ib)
                    n.append(nb)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(n).astype(np.int64))], names=["cls", "n"])

        for batch in batches:
            for _, part in _by_length(batch, 6):
                now = {"at": np.stack([part.column(i).to_numpy() for i in range(3)], axis=1), "side": part.column(3).to_numpy(), "cls": part.column(4).to_numpy(), "n": part.column(5).to_numpy(), "x": _unit(part.column(6))}
                if left is not None:
                    if left["x"].shape[1] == now["x"].shape[1]:
                        now = {k: np.concatenate([left[k], now[k]]) for k in now}
                    else:
                        yield emitted(left)
                same = (now["at"] == now["at"][-1]).all(axis=1)
                first = int(np.argmax(same))
                if first:
                    yield emitted({k: v[:first] for k, v in now.items()})
                left = {k: v[first:] for k, v in now.items()}
        if left is not None:
            yield emitted(left)

    return run


def _roots(classes: DataFrame, threshold: float, passes: int, window: int, quiet: float, seed: int) -> DataFrame:
    """``node, root``: components of the links that rounds of passes find; only a count of each round reaches the driver."""
    spark, vector = classes.sparkSession, dict(classes.dtypes)["embedding"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    roots, joined, rounds = None, 0, 0
    while True:
        keyed = classes.select("cls", "embedding").mapInArrow(_keys(range(rounds * passes, (rounds + 1) * passes), seed), f"dim int, pass int, key long, cls long, embedding {vector}")
        dealt = keyed.repartitionByRange(n, "dim", "pass", "key", "cls").sortWithinPartitions("dim", "pass", "key", "cls")
        links = dealt.mapInArrow(_window_links(threshold, window << rounds), "a long, b long")
        roots = components(links if roots is None else roots.unionAll(links).toDF("a", "b"), "a", "b")
        was, joined, rounds = joined, roots.count(), rounds + 1
        if rounds > 1 and joined - was <= quiet * joined:
            return roots


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, passes: int = 8, window: int = 64, quiet: float = 1e-4, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of vectors.

    Vectors link at a cosine, in double precision, of threshold at least; those that are null, empty, zero, or hold
    null or non-finite components link with nothing, nor do vectors of different lengths. n_links counts the other rows
    linked directly, repeated rows among them. component_id is the smallest id that links reach, the row's own where
    there are none; a null id reads as null. kept is whether it is the row's own. An empty table gives an empty
    table. Other columns are not read.

    Passes miss a pair that never falls into one window: with b the bits that tell a window's vectors apart, one pass
    holds a pair at angle t with probability of (1 - t / pi) ** b at least, and partition borders cut windows. What is
    missed is measured: after the first two, rounds of passes go on until one joins no more than the share quiet of all
    classes joined so far. With under 1 / quiet of them that is a round that joins nothing.
    """
    vec = F.col(vec_col).cast("array<double>")
    sound = F.col(vec_col).isNotNull() & (F.size(vec) > 0) & F.coalesce(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(vec, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound, F.col(vec_col)).alias("embedding")).select("vec_id", "embedding", F.xxhash64("embedding").alias("h"))
    rows = checkpointed(rows)
    # Classes of equal vectors, named by the hash of their components.
    classes = checkpointed(rows.where("embedding IS NOT NULL").groupBy("h", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumnRenamed("h", "cls"))
    roots = _roots(classes, threshold, passes, window, quiet, seed)
    own = roots.select(F.col("root").alias("node"), "root").distinct().unionAll(roots)
    members = checkpointed(classes.join(own, classes.cls == own.node).select("root", "cls", "least", "n", "embedding"))

    sizes = members.groupBy("root").agg(F.count("*").alias("size"), F.min("least").alias("component_id"))
    sizes = checkpointed(sizes)
    tiled = members.join(sizes.select(own_exchange(F.col("root")).alias("root"), "size"), "root")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    tile = F.pmod(F.col("cls"), tiles)  # the class is a hash already
    with_all = tiled.withColumns({"tiles": tiles, "tile": tile}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # A tile stands on the first side of its pairs with later tiles, on the second of those with earlier ones; on both with itself.
    sides = F.when(F.col("other") > F.col("tile"), F.array(F.lit(0))).when(F.col("other") < F.col("tile"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    paired = with_all.select("root", F.least("tile", "other").cast("long").alias("t1"), F.greatest("tile", "other").cast("long").alias("t2"), F.explode(sides).alias("side"), "cls", "n", "embedding")
    counted = paired.repartition("root", "t1", "t2").sortWithinPartitions("root", "t1", "t2", "side").mapInArrow(_tile_counts(threshold), "cls long, n long")
    linked = counted.groupBy("cls").agg(F.sum("n").alias("links"))

    named = members.select("root", "cls").join(sizes.select(own_exchange(F.col("root")).alias("root"), "component_id"), "root").select("cls", "component_id")
    known = classes.select("cls", "n", "least").join(named, "cls", "left").join(linked, "cls", "left")
    by_class = known.select(own_exchange(F.col("cls")).alias("h"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    good = rows.where("embedding IS NOT NULL").select("vec_id", "h").join(by_class, "h").select("vec_id", "n_links", "component_id")
    alone = rows.where("embedding IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionAll(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The query's rows from the cosines of all pairs, for tables small enough.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
c(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, m.r AS component_id, e.vec_id = m.r AS kept
FROM embeddings e JOIN (SELECT vec_id, min(r) AS r FROM c GROUP BY vec_id) m USING (vec_id) LEFT JOIN n USING (vec_id)
"""
