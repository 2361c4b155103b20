"""Mixing and chat formatting: edge cases, statistics, and plain restatements."""

import math
import random

from pyspark.sql import functions as F

from proseflow.llm import chat, mix

DOCS = "doc_id long, text string, source string, mix_rate string, rate int"


def plain_poisson(mean, u):
    p = c = math.exp(-mean)
    k = 0
    while u >= c and k < mix.TERMS:
        k += 1
        p *= mean / k
        c += p
    return k


def test_poisson_is_the_inverse(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([0.0, 0.01, 0.4, 1.0, 3.7, 20.0, 32.0]), rnd.random()) for _ in range(500)]
    got = spark.createDataFrame(rows, "mean double, u double").select("mean", "u", mix.poisson(F.col("mean"), F.col("u")).alias("k")).collect()
    assert all(r.k == plain_poisson(r.mean, r.u) for r in got)


def corpus(n=3000):
    """A hot source with a third of the rows, and repeated rows."""
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.randrange(1, 50), "hot" if i % 3 == 0 else f"s{i % 7}", "clash", i) for i in range(n)]
    return [*rows, *rows[:5], (None, "null id", None, "c", 1), (n + 1, None, None, "c", 1), (n + 2, "", "empty", "c", 1)]


def test_rates_hold_and_draws_repeat(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    weights = {"hot": 0.1, "s1": 0.5, "s2": 0.4}
    out = mix.replicated(df, weights, epochs=1.0)
    rows = out.collect()
    assert set(out.columns) == {*df.columns, "mix_copy", "mix_key"} and {r.source for r in rows} <= set(weights)
    by = {s: sum(len(r.text) for r in rows if r.source == s) for s in weights}
    total = sum(len(t or "") for _, t, *_ in corpus())
    assert all(abs(by[s] / total - w) < 0.05 for s, w in weights.items())
    assert sorted((r.doc_id, r.mix_copy) for r in rows) == sorted((r.doc_id, r.mix_copy) for r in mix.replicated(df.repartition(7), weights).collect())
    assert rows != mix.replicated(df, weights, seed=18).collect()


def test_draws_are_those_of_a_plain_loop(spark):
    import hashlib

    df = spark.createDataFrame(corpus(400)[:400], DOCS)
    got = {}
    for r in mix.replicated(df, temperature=0.3, epochs=40.0).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        rate = r.mix_rate
        pieces = max(1, math.ceil(rate / mix.PART))
        draws = [int(hashlib.md5(f"17:{r.doc_id}:{i}".encode()).hexdigest()[:13], 16) / 2**52 for i in range(1, pieces + 1)]
        r_n = sum(plain_poisson(rate / pieces, u) for u in draws)
        assert r.mix_copy < r_n
        got.setdefault(("n", r.doc_id), r_n)
    assert all(got[k] == got["n", k] for k in list(got) if not isinstance(k, tuple))


def test_many_sources_are_joined_by_salt(spark, monkeypatch):
    df = spark.createDataFrame(corpus(500), DOCS)
    want = sorted(map(str, mix.replicated(df).collect()))
    monkeypatch.setattr(mix, "BROADCAST_BYTES", -1)
    assert sorted(map(str, mix.replicated(df).collect())) == want


def test_empty_inputs(spark):
    assert mix.replicated(spark.createDataFrame([], DOCS)).count() == 0
    assert mix.replicated(spark.createDataFrame([(1, "", "a", "", 1), (2, None, None, "", 1)], DOCS)).count() == 0
    assert mix.replicated(spark.createDataFrame(corpus(9), DOCS), {"nowhere": 1.0}).count() == 0


TURNS = "conv_id long, turn long, role string, text string, k string, n string"


def talk(i, *turns):
    return [(i, t, "user" if t % 2 == 0 else "assistant", x, "k", "n") for t, x in enumerate(turns)]


def plain_formatted(rows):
    by = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            by.setdefault(c, set()).add((t is not None, t or 0, role or "unknown", text or ""))
    seq = {c: tuple((r, x) for _, _, r, x in sorted(v)) for c, v in by.items()}
    prefixes = {s[:k] for s in seq.values() for k in range(1, len(s))}
    out = {}
    for c in sorted(seq):
        if seq[c] not in prefixes:
            out.setdefault(seq[c], []).append(c)
    return {cs[0]: (len(s), len(cs) - 1, "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in s)) for s, cs in out.items()}


def test_snapshots_collapse(spark):
    rnd = random.Random(3)
    rows = [*talk(1, "a"), *talk(2, "a", "b"), *talk(3, "a", "b", "c"), *talk(4, "a", "x"), *talk(5, "a", "b", "c"), *talk(6, "b", "a"), *talk(7, "", None), *talk(8, "long" * 50_000, "é😀")]
    rows += [(9, 3, None, "gap", "k", "n"), (9, 1, "user", "first", "k", "n"), (9, 1, "user", "first", "k", "n"), (9, None, "system", "s", "k", "n"), (None, 0, "user", "lost", "k", "n")]
    for i in range(10, 200):
        rows += talk(i, *(rnd.choice("pq") for _ in range(rnd.randrange(1, 7))))
    rnd.shuffle(rows)
    got = {r.conv_id: (r.n_turns, r.collapsed, r.chat) for r in chat.formatted(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == plain_formatted(rows)
    assert got[3][:2] == (3, 1) and 1 not in got and 2 not in got and 5 not in got
    assert chat.formatted(spark.createDataFrame([], TURNS)).count() == 0
