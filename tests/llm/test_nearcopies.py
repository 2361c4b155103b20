"""The pipeline's near-copy stage against brute force over all pairs of shingle sets."""

import random

import numpy as np

import corpus_pipeline
from proseflow.llm import simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def plain_kept(rows):
    """Indexes of the rows that stay: the smallest id of each component, ids null last."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = label[a], label[b]
                label = [y if c == x else c for c in label]
    groups = {}
    for i, c in enumerate(label):
        groups.setdefault(c, []).append(i)
    return {min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for g in groups.values()}


def texts(rnd):
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(30):
        w = [rnd.choice(vocab) for _ in range(rnd.choice([8, 60, 150]))]
        out.append(" ".join(w))
        for _ in range(3):  # similarities on both sides of 0.8
            v = list(w)
            for i in rnd.sample(range(len(v)), max(1, len(v) // 40) + rnd.randrange(2)):
                v[i] = rnd.choice(vocab)
            out.append(" ".join(v))
    return out


def test_stage_against_all_pairs(spark):
    rows = list(enumerate(["", None, " \n", "one", "One", "two words", *texts(random.Random(1))]))
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(rows[i][0] for i in plain_kept(rows))


def test_null_ids_and_one_id_of_two_texts_keep_every_component(spark):
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (None, "m n o p q r"), (7, "s t u v w x"), (7, "aa bb cc dd ee ff"), (None, "s t u v w x")]
    got = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows[:5]))
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tiles_and_parts_change_nothing(spark, monkeypatch):
    """With tiles and parts of a few sets, and keys of two minima so that buckets hold texts that are apart."""
    rows = list(enumerate(texts(random.Random(2))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(rows[i][0] for i in plain_kept(rows))
    monkeypatch.setattr(simhash, "PART", 3)
    monkeypatch.setattr(simhash, "MOST", 2)
    assert sorted(r.doc_id for r in simhash.without_near_copies(df).collect()) == want
    common = " ".join(f"c{i}" for i in range(300))
    rows = [(i, f"{common} {' '.join(f'x{i // 3}y{k}' for k in range(55 + 9 * (i % 3)))}") for i in range(60)]  # 0.73 to 0.95 of one another
    kept = sorted(r.doc_id for r in simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted(rows[i][0] for i in plain_kept(rows))


def test_tile_links_span_what_all_pairs_join():
    for seed in range(5):
        rows = [t for t in texts(random.Random(seed))]
        sets = [simhash.set_of(t.encode()) for t in rows]
        links = simhash.tile_links(list(range(len(rows))), sets, list(range(len(rows))), sets, 80)
        label = list(range(len(rows)))
        for a, b in links:
            assert simhash.alike(sets[a], sets[b], 80)
            x, y = label[a], label[b]
            label = [min(x, y) if c in (x, y) else c for c in label]
        assert {label.index(x) for x in set(label)} == plain_kept(list(enumerate(rows)))


def test_keys_meet_as_often_as_the_formula_says():
    """Pairs at 0.8 share a key but for a few in a hundred thousand; pairs at 0.3 hardly ever do."""
    rnd = np.random.default_rng(3)
    meet = {0.8: 0, 0.3: 0}
    for s in meet:
        for _ in range(300):
            n = 450
            both = int(round(2 * n * s / (1 + s)))
            h = rnd.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(h[:n]), np.sort(h[n - both :])
            meet[s] += bool(set(simhash.signature_keys(a).tolist()) & set(simhash.signature_keys(b).tolist()))
    assert meet[0.8] >= 299 and meet[0.3] <= 300 * 8 * 5 * 0.3**4 * 1.5
