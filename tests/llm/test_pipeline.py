"""The pipeline against plain restatements of its stages, on the smallest tables and on a planted corpus."""

import os
import random
from collections import Counter

import duckdb
import pytest
from test_decontaminate_shard import plain_report
from test_nearcopies import plain_kept

import corpus_pipeline
from proseflow.llm import mix, shard, toxicity

DIR = "/root/testdata/sf0.001"
NAMES = ["toxicity", "simhash", "decontamination", "mixing", "sharding"]


def run_stages(spark, d, tmp):
    """Each stage's rows, written and read again as the next one's documents."""
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp}/{k}")
        docs = spark.read.parquet(f"{tmp}/{k}")
        out.append((name, docs.columns, docs.collect()))
    return out


def plain_stages(spark, d, columns, rows):
    """The rows that each stage should leave, from the documents' rows."""
    labels, items = spark.read.parquet(f"{d}/labels.parquet"), [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    model = toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), labels)
    kept = [r for r in rows if toxicity.score_text(r["text"], model, {})[0] < 0.3]
    yield kept
    stay = plain_kept([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for i, r in enumerate(kept) if i in stay]
    yield kept
    bad = {x[0] for x in plain_report([(r["doc_id"], r["text"]) for r in kept], items) if x[-1]}
    kept = [r for r in kept if r["doc_id"] not in bad]
    yield kept


def check(spark, d, tmp):
    stages = run_stages(spark, d, tmp)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [s[0] for s in stages] == NAMES and all(s[1] == docs.columns for s in stages[:-1])
    for (_, _, got), want in zip(stages, plain_stages(spark, d, docs.columns, docs.collect()), strict=False):
        assert sorted(got, key=str) == sorted(want, key=str)
    kept, mixed, dealt = (s[2] for s in stages[2:])
    rows = Counter(r["doc_id"] for r in mixed)
    texts = {r["doc_id"]: r for r in kept}
    assert all(r == texts[r["doc_id"]] for r in mixed)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp}/2/*.parquet'")
    assert rows == Counter(r[0] for r in duck.execute(mix.oracle()).fetchall())
    assert Counter(r["doc_id"] for r in dealt) == rows
    size = Counter()
    for r in dealt:
        size[r["shard"]] += r["size"]
    groups = Counter(len((r["text"] or "").encode()) + 1 for r in mixed)
    assert max(size.values()) - min(size.values()) <= max(groups) * max(rows.values()) and shard.BITS == 10
    return stages


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_smallest_tables(spark, tmp_path):
    stages = check(spark, DIR, str(tmp_path))
    assert sorted(map(str, corpus_pipeline.run(spark, DIR).collect())) == sorted(map(str, stages[-1][2]))


def test_planted(spark, tmp_path):
    """Copies, near copies, benchmark passages and toxic documents go; clean ones stay."""
    rnd = random.Random(9)
    vocab = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu") for b in ("ma", "ne", "pi") for c in ("", "sa", "te", "vu")]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        t = text(rnd.randrange(60, 200))
        if i % 5 == 0:
            w = t.split()
            for bad in ("grub", "swine", "grub"):
                w.insert(rnd.randrange(len(w)), bad)
            t = " ".join(w)
        docs.append((i, t, "en", "hot" if i % 3 else "rest", len(t)))
        labels.append((i, 1, int(i % 5 == 0)))
    item = text(30)
    clean = docs[1][1]
    docs += [(1000, clean, "en", "rest", 1), (1001, clean + " end", "en", "rest", 1), (1002, text(80) + " " + item[20:140] + " " + text(50), "en", "rest", 1), (1003, "", "en", "rest", 0), (1004, None, "en", "rest", None)]
    d = str(tmp_path / "in")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    stages = check(spark, d, str(tmp_path / "out"))
    ids = [{r["doc_id"] for r in s[2]} for s in stages[:3]]
    assert ids[0] == {i for i, *_ in docs if i >= 1000 or i % 5} and {1000, 1001} & ids[1] == set() and 1 in ids[1]
    assert 1002 in ids[1] and 1002 not in ids[2] and len(ids[2]) >= 235
