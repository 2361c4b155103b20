"""Tone and novelty: the reference's expectations with sentences of our own, and a plain restatement."""

import math
from collections import Counter

from pyspark.sql import functions as F

from proseflow.operators import novelty, retrieval, sentiment
from proseflow.plans import features

TONE = ["hawkish_score", "n_hawkish", "n_dovish", "n_neutral", "n_target_sentences"]


def tone(spark, texts, label=sentiment.lexicon_label):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [tuple(r[c] for c in TONE) for r in sentiment.scored(df, ["doc_id"], label=label).orderBy("doc_id").collect()]


def test_scores(spark):
    always = lambda v: lambda s: F.lit(v)
    both = ["Inflation stays far above the goal. Employment holds up well."]
    assert tone(spark, both, always("LABEL_1")) == [(1.0, 2, 0, 0, 2)]
    assert tone(spark, both, always("LABEL_0")) == [(-1.0, 0, 2, 0, 2)]
    mixed = ["Tightening of liquidity goes on. Easing of liquidity goes on. Liquidity is as it was."]
    assert tone(spark, mixed) == [(0.0, 1, 1, 1, 3)]


def test_empty_documents_score_zero(spark):
    assert tone(spark, ["", None, "Thank you for having me here today.", "GDP up."]) == [(0.0, 0, 0, 0, 0)] * 4


def test_model_sees_target_sentences_only(spark):
    def load():
        def model(sentences, **how):
            assert all("inflation" in s.lower() for s in sentences) and how["batch_size"] == 32
            return [{"label": "LABEL_1", "score": 0.9} for _ in sentences]

        return model

    got = tone(spark, ["Inflation rose a lot. Good evening to all of you.", "Good morning to everybody."], sentiment.model_label(load))
    assert got == [(1.0, 1, 0, 0, 1), (0.0, 0, 0, 0, 0)]


def plain_novelty(rows, stop=(), top=10_000):
    """{(type, date): score} of (type, date, id, text) rows."""
    import re

    best = {}
    for kind, date, i, t in sorted(rows, key=lambda r: r[2]):
        if (kind, date) not in best or len(t) > len(best[kind, date]):
            best[kind, date] = t
    out = {}
    for kind in {k for k, _ in best}:
        dates = sorted(d for k, d in best if k == kind)
        tf = {d: Counter(w for w in re.findall(r"\w{2,}", best[kind, d].lower()) if w not in stop) for d in dates}
        total = sum(tf.values(), Counter())
        vocabulary = set(sorted(total, key=lambda w: (-total[w], w))[:top])
        df = Counter(w for d in dates for w in tf[d])
        vec = {}
        for d in dates:
            v = {w: n * (math.log((1 + len(dates)) / (1 + df[w])) + 1) for w, n in tf[d].items() if w in vocabulary}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1
            vec[d] = {w: x / norm for w, x in v.items()}
        for prev, d in zip([None, *dates], dates):
            out[kind, d] = 1.0 if prev is None else 1 - min(1, max(0, sum(x * vec[prev].get(w, 0) for w, x in vec[d].items())))
    return out


def test_novelty_against_plain(spark):
    words = "rates prices jobs growth risk bank policy outlook the of".split()
    rows = [("speech" if i % 3 else "document", f"2024-01-{1 + i * 7 % 20:02d}", i, " ".join(words[(i * j) % 10] for j in range(1, 4 + i % 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "source_type string, date string, doc_id int, text string").withColumn("date", F.to_date("date"))
    for top in (10_000, 4):
        want = plain_novelty(rows, ("the", "of"), top)
        got = novelty.novelty(df, stop_words=("the", "of"), max_features=top).collect()
        assert len(got) == 60
        assert all(abs(r.novelty - want[r.source_type, str(r.date)]) < 1e-9 and 0 <= r.novelty <= 1 for r in got)


def test_novelty_so_far_is_that_of_the_series_cut_off(spark):
    """A document's score without later ones is the plain score of the series that ends with it."""
    words = "rates prices jobs growth risk bank policy outlook the of".split()
    rows = [("speech" if i % 3 else "document", f"2024-01-{1 + i * 7 % 20:02d}", i, " ".join(words[(i * j) % 10] for j in range(1, 4 + i % 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "source_type string, date string, doc_id int, text string").withColumn("date", F.to_date("date"))
    got = {(r.source_type, str(r.date)): r.novelty for r in novelty.novelty(df, stop_words=("the", "of"), so_far=True).collect()}
    for kind, date in got:
        want = plain_novelty([r for r in rows if r[0] == kind and r[1] <= date], ("the", "of"))
        assert abs(got[kind, date] - want[kind, date]) < 1e-9


def test_novelty_cases(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "source_type string, date string, doc_id int, text string").withColumn("date", F.to_date("date"))
        return {r.doc_id: r.novelty for r in novelty.novelty(df).collect()}

    assert run([]) == {}
    assert run([("s", "2024-01-01", 1, "Some text here")]) == {1: 1.0}
    same = run([("s", "2024-02-01", 2, "Rates rise again"), ("s", "2024-01-01", 1, "Rates rise again"), ("d", "2024-03-01", 3, "Rates rise again")])
    assert same[1] == same[3] == 1.0 and abs(same[2]) < 1e-6
    apart = run([("s", "2024-01-01", 1, "alpha beta"), ("s", "2024-01-02", 2, "gamma delta"), ("s", None, 3, "lost"), ("s", "2024-01-03", 4, "the of")])
    assert apart[2] > 0.9 and apart[3] is None and apart[4] == 1.0


def test_features_keep_sources_apart_and_write(spark, tmp_path):
    rows = [(1, "speech", "2024-01-01", "Inflation needs tightening now."), (1, "document", "2024-01-01", "Plain words."), (2, "speech", "2024-01-05", "Easing of inflation.")]
    df = spark.createDataFrame(rows, "doc_id long, source_type string, date string, text string").withColumn("date", F.to_date("date"))
    out = features.features(df)
    got = {(r.source_type, r.doc_id): r for r in out.collect()}
    assert len(got) == 3 and got["speech", 1].hawkish_score == 1.0 and got["speech", 2].hawkish_score == -1.0 and got["document", 1].novelty == 1.0
    assert features.write(out, str(tmp_path / "f.parquet"), by_source=True) and spark.read.parquet(str(tmp_path / "f.parquet")).count() == 3
    assert not features.write(out.where("false"), str(tmp_path / "none.parquet")) and not (tmp_path / "none.parquet").exists()


def test_targets_are_those_before(spark):
    f = spark.createDataFrame([(1, "2023-01-01"), (2, "2024-05-02"), (3, "2024-05-03"), (4, "2030-01-01"), (5, None)], "doc_id int, date string").withColumn("date", F.to_date("date"))
    t = spark.createDataFrame([("x", "2023-06-01", 1.0), ("x", "2024-05-02", 2.0), ("y", "2020-01-01", 9.0)], "series string, date string, value double").withColumn("date", F.to_date("date"))
    assert {r.doc_id: r.x for r in features.attach_targets(f, t, "x").collect()} == {1: None, 2: 1.0, 3: 2.0, 4: 2.0, 5: None}


def test_dedup_keeps_the_earlier_of_equal_lengths(spark):
    df = spark.createDataFrame([(2, "d", "abc"), (1, "d", "xyz"), (3, "d", "ab"), (4, "e", "")], "doc_id int, date string, text string")
    assert {r.doc_id for r in novelty.dedup_longest(df, ["date"], ["doc_id"]).collect()} == {1, 4}




def test_nearest_vectors_in_blocks_of_queries(spark, monkeypatch):
    rows = [(i, [math.cos(i / 7), math.sin(i / 7)]) for i in range(40)] + [(40, [0.0, 0.0]), (41, None), (42, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    once = sorted(map(tuple, retrieval.top_k(v, v, k=2).collect()))
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 100)
    assert sorted(map(tuple, retrieval.top_k(v, v, k=2).collect())) == once
    assert {i for q, i, _, _ in once if q == 10} == {9, 11}
    assert {q for q, *_ in once} == set(range(40))
