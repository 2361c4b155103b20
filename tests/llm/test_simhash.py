"""SimHash near-duplicates against a plain restatement over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from proseflow.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, x in zip(ids, fps, strict=True):
            for j, y in zip(ids, fps, strict=True):
                if (x ^ y).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def texts(seed=7):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" if i % 3 else f"W{i}" for i in range(300)]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([5, 40, 200]))) for _ in range(25)]
    out = [None, "", "  \t\n", "one", "One", "two words", *base, *base[:5]]
    for t in base[:12]:
        for _ in range(3):
            w = t.split(" ")
            w[rnd.randrange(len(w))] = "edit"
            out.append("\n".join(w))
    return out


def test_against_all_pairs(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    want = plain_components([r[0] for r in rows], fps)
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == {i: f for i, f in enumerate(fps)}
    assert {r.doc_id: r.component_id for r in got} == want


def test_long_text_goes_in_blocks():
    words = [f"w{i * 7919 % 5003}" for i in range(simhash.BLOCK + 50)]
    assert simhash.fingerprint_of(" ".join(words).encode()) & (2**64 - 1) == plain_fingerprint(" ".join(words))


def test_links_at_three_bits_everywhere(spark):
    """Every pair at distance 3 or less is found, whichever bits differ; none beyond it is."""
    rnd = random.Random(3)
    fps = set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        fps |= {x, *(x ^ sum(1 << b for b in rnd.sample(range(64), d)) for d in (1, 2, 3, 3, 3, 4, 5))}
    fps = sorted(fps)
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in got)
    index = {f: i for i, f in enumerate(signed)}
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        for r in got:
            a, b = index[r.a], index[r.b]
            label[a] = label[b] = min(label[a], label[b])
    want = plain_components(list(range(len(fps))), fps)
    assert {i: x for i, x in enumerate(label)} == want


@pytest.mark.parametrize(("tile", "space", "n", "bits"), [(1024, 12, 1500, 1), (16, 12, 700, 1), (16, 20, 400, 3), (8, 6, 50, 3), (16, 30, 300, 2)])
def test_bucket_forest_spans_what_all_pairs_span(monkeypatch, tile, space, n, bits):
    monkeypatch.setattr(simhash, "TILE", tile)
    rnd = np.random.default_rng(5)
    fps = np.unique(rnd.integers(0, 1 << space, n).astype(np.uint64))
    rnd.shuffle(fps)
    i, j = simhash.forest(fps, bits)
    assert (np.bitwise_count(fps[i] ^ fps[j]) <= bits).all() and len(i) < len(fps)
    label = {k: k for k in range(len(fps))}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in zip(i, j, strict=True):
        label[max(root(a), root(b))] = min(root(a), root(b))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    assert all(root(a) == root(b) for a, b in zip(*np.nonzero(near), strict=True))


def test_repeated_rows_nulls_and_empty_table(spark):
    schema = "doc_id long, text string, fp string"
    df = spark.createDataFrame([(1, "a b c d", "p"), (1, "a b c d", "p"), (2, "A B c d", "q"), (None, "a b c d", "r"), (None, None, "s")], schema)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 1), (1, 1), (1, 1), (2, 1)]
    kept = simhash.deduplicated(df).collect()
    assert {r.doc_id for r in kept} == {1, None} and len(kept) == 2 and set(df.columns) == kept[0].asDict().keys()
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_deduplicated_keeps_the_smallest_id(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components([r[0] for r in rows], [plain_fingerprint(t) for _, t in rows])
    assert {r.doc_id for r in simhash.deduplicated(df).collect()} == {i for i, c in want.items() if i == c}
