"""Decontamination and sharding against brute force."""

import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

from proseflow.llm import decontaminate, shard

DOCS = "doc_id long, text string, items string, key int"
ITEMS = "item_id long, text string, win string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain_report(docs, items, size=10):
    wins = defaultdict(set)
    for i, t, *_ in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins[tuple(w[k : k + size])].add("" if i is None else str(i))
    out = []
    for d, t, *_ in docs:
        w, hit, its = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    its |= found
        out.append((d, len(w), len(hit), len(its), sorted(its), bool(hit)))
    return sorted(out, key=str)


def tables(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "é", "Ünd", "und", "K", "k", "THE", "the"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(i, text(rnd.choice([10, 12, 25])), "x") for i in range(30)]
    items += [(100, "one", "x"), (101, "Two words", "x"), (102, "three little words", "x"), (103, "", "x"), (104, None, "x"), (None, text(11), "x"), (5, items[5][1], "x"), (105, items[6][1], "x"), (106, "...", "x")]
    docs = [(i, text(rnd.randrange(60)), "clash", 1) for i in range(60)]
    for i in range(60, 110):
        cut = words(rnd.choice(items[:30])[1])
        a = rnd.randrange(len(cut))
        docs.append((i, text(20) + " ".join(cut[a : a + rnd.choice([8, 10, 14])]).upper() + " " + text(5), "clash", 1))
    docs += [(200, None, "c", 1), (201, "", "c", 1), (202, "Has ONE here, and TWO words! three little words", "c", 1), (None, items[0][1], "c", 1), (61, "another text", "c", 1), docs[62], docs[62], (203, (items[1][1] + " ") * 500, "c", 1)]
    return docs, items


def test_report_against_every_place(spark):
    docs, items = tables()
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in decontaminate.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()]
    assert sorted(got, key=str) == plain_report(docs, items)


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = tables(2)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20_000)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in decontaminate.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()]
    assert sorted(got, key=str) == plain_report(docs, items)


def test_only_clean_documents_stay(spark):
    docs, items = tables(3)
    df = spark.createDataFrame(docs, DOCS)
    kept = decontaminate.decontaminated(df, spark.createDataFrame(items, ITEMS))
    assert kept.columns == df.columns
    clean = [r for r, d in zip(sorted(docs, key=lambda d: str(d[:2])), sorted(docs, key=lambda d: str(d[:2])), strict=True) if not plain_report([d], items)[0][-1]]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(d[:2] for d in clean)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", 1)], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS)
    assert decontaminate.report(docs.limit(0), items).count() == 0
    assert decontaminate.report(docs, items.limit(0)).first().n_hit == 0 and decontaminate.decontaminated(docs, items.limit(0)).count() == 1


def test_shards(spark):
    rnd = random.Random(5)
    docs = [(i, rnd.choice([None, "", "é" * rnd.randrange(1, 900), "copy " * 40, "x" * rnd.randrange(1, 4000)]), "clash", i) for i in range(800)]
    docs += [docs[3]] * 40 + [(None, "no id", "c", 1)] * 3 + [(1, "same id", "c", 1)]
    rows = shard.assign(spark.createDataFrame(docs, "doc_id long, text string, shard string, size int"), 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    where, load = {}, Counter()
    for r in rows:
        assert where.setdefault(r.text_crc32, r.shard) == r.shard
        load[r.shard] += r.size
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    groups = Counter()
    for _, t, *_ in docs:
        groups[t or ""] += len((t or "").encode()) + 1
    heap = [(0, s) for s in range(8)]
    for b in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, (heap[0][0] + b, heap[0][1]))
    assert max(load.values()) <= 1.01 * max(heap)[0]


def test_schedule_is_the_heap_for_exact_classes():
    rnd = random.Random(6)
    for shards in (1, 3, 8):
        classes = [(size, n := rnd.choice([1, 2, 7, 30, 500]), size * n) for size in rnd.sample(range(1, 2000), 40)]
        heap = [(0.0, s) for s in range(shards)]
        for size, n, _ in sorted(classes, reverse=True):
            for _ in range(n):
                heapq.heapreplace(heap, (heap[0][0] + size, heap[0][1]))
        load = [0.0] * shards
        for size, got in shard.schedule(classes, shards).items():
            assert sum(got) == next(n for s, n, _ in classes if s == size)
            for s, g in enumerate(got):
                load[s] += g * size
        assert sorted(load) == sorted(x for x, _ in heap)
    assert shard.schedule([], 8) == {}


def test_size_classes_are_bounded(spark):
    df = spark.range(0, 5_000).selectExpr("id AS s").unionAll(spark.createDataFrame([(2**40 + 12345,), (2**62 + 1,)], "s long"))
    got = {r.s: r.c for r in df.select("s", shard.size_class(df.s).alias("c")).collect()}
    assert all(c == s for s, c in got.items() if s < 2048) and all(0 <= s - c <= s / 1024 for s, c in got.items())


def test_empty_table(spark):
    assert shard.assign(spark.createDataFrame([], DOCS)).count() == 0
