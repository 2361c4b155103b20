"""Connected components against union-find; words against a plain scan."""

import random
import re

from pyspark.sql import functions as F

from proseflow.llm import common


def plain(edges):
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        label[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in label if root(x) != x}


def run(spark, edges):
    got = common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    out = {r.node: r.root for r in got}
    assert len(out) == len(got)
    return out


def test_components(spark):
    rnd = random.Random(1)
    path = list(range(300))
    rnd.shuffle(path)
    chain = [(path[i], path[i + 1]) for i in range(299)]
    star = [(1000, x) for x in range(1001, 1200)] + [(999, 1150)]
    loose = [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(180)]
    signed = [(-(2**62), 2**62), (2**62, -5), (7000, 7000), (8000, 8001), (8001, 8000), (8000, 8001)]
    edges = chain + star + loose + signed
    rnd.shuffle(edges)
    assert run(spark, edges) == plain(edges)


def test_no_edges(spark):
    assert run(spark, []) == {} and run(spark, [(3, 3)]) == {}


def test_words(spark):
    rnd = random.Random(2)
    parts = ["a", "Z", "9", "é", "😀", "_", "-", " ", "\x00", "\x7f", "\x80", "'", "\n", "ß"]
    texts = [None, "", " ", *("".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(500))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", common.raw_words(F.col("t")).alias("w"), common.ascii_lower(F.col("t")).alias("l"))
    for r in df.collect():
        t = texts[r.i]
        low = None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        assert r.l == low and [w.lower() if w.isascii() else w for w in r.w] == [w.lower() if w.isascii() else w for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
