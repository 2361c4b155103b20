"""Near-duplicate vectors against brute force."""

import numpy as np

from proseflow.llm import embed

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def plain(rows, threshold=0.95):
    """{row: (links, component)} over all pairs of sound rows."""
    ok = [i for i, (_, v, *_) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, label = {i: 0 for i in range(len(rows))}, {i: i for i in range(len(rows))}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    unit = {}
    for i in ok:
        x = np.array(rows[i][1], np.float32).astype(np.float64)
        x = x / np.abs(x).max()
        unit[i] = x / np.linalg.norm(x)
    for a in ok:
        for b in ok:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                n[a] += 1
                n[b] += 1
                label[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (k, *_) in enumerate(rows):
        r = root(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(least[r], k)
    return sorted((str(k), n[i], str(least[root(i)])) for i, (k, *_) in enumerate(rows))


def run(spark, rows, **how):
    return embed.near_duplicates(spark.createDataFrame(rows, SCHEMA), **how).collect()


def vectors(seed, groups, dim=24, spread=0.12):
    rnd = np.random.default_rng(seed)
    rows, i = [], 0
    for size in groups:
        center = rnd.standard_normal(dim)
        for _ in range(size):
            rows.append((i, [float(x) for x in np.float32(center + spread * rnd.standard_normal(dim))], 0, "c"))
            i += 1
    return rows


def test_groups_and_chains(spark):
    rows = vectors(1, [1] * 200 + [2] * 60 + [40, 90])
    got = run(spark, rows)
    want = plain(rows)
    links = sum(w[1] for w in want)
    assert sum(r.n_links for r in got) >= 0.97 * links
    assert sum(a == b for a, b in zip(sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got), want, strict=True)) >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_a_group_larger_than_window_and_tile_is_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(embed, "TILE", 16)
    rows = vectors(2, [1] * 30 + [130], spread=0.05)
    got = run(spark, rows, window=4)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == plain(rows)


def test_unsound_equal_and_repeated_rows(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(1, v, 0, "c"), (2, v, 0, "c"), (2, v, 0, "c"), (3, [2.0, 4.0, 6.0], 0, "c"), (4, None, 0, "c"), (5, [], 0, "c"), (6, [0.0, 0.0, 0.0], 0, "c"), (7, [1.0, None, 3.0], 0, "c"), (8, [float("nan"), 2.0, 3.0], 0, "c"),
            (9, [float("inf"), 2.0, 3.0], 0, "c"), (10, w, 0, "c"), (11, [1.0, 2.0], 0, "c"), (12, [1.0, 2.0], 0, "c"), (None, w, 0, "c"), (None, None, 0, "c"), (13, [-0.0, 1.0, 0.0], 0, "c"), (14, [0.0, 1.0, 0.0], 0, "c"), (15, [1e30, 2e30, 3e30], 0, "c")]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in run(spark, rows))
    assert got == plain(rows)
    assert run(spark, [(4, None, 0, "c")])[0].kept and run(spark, []) == []


def test_links_in_a_dense_cone_are_found_by_more_rounds(spark):
    rnd = np.random.default_rng(3)
    mean = rnd.standard_normal(32)
    mean /= np.linalg.norm(mean)
    apart = rnd.standard_normal((2400, 32))
    apart /= np.linalg.norm(apart, axis=1, keepdims=True)
    near = rnd.standard_normal((600, 32))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    x = np.vstack([2 * mean + apart, 2 * mean + apart[:600] + 0.5 * near]).astype(np.float32)  # means of 0.8, pairs above 0.95
    rows = [(i, [float(v) for v in e], 0, "c") for i, e in enumerate(x)]
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = np.argwhere(np.triu(unit @ unit.T >= 0.95, 1))
    assert len(links) > 500
    got = {r.vec_id: r for r in run(spark, rows, window=8)}
    assert sum(r.n_links for r in got.values()) == 2 * len(links)
    assert all(got[a].component_id == got[b].component_id for a, b in links)
