"""Toxicity, license scans and token counts: held-out accuracy, restatements, edge cases."""

import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proseflow.llm import licenses, queries, tokens, toxicity

DOCS = "doc_id long, text string, toxicity string, score int"


def labelled(n=900, seed=1):
    """Invented words; toxic documents hold one of three insults, or words that begin alike, at random places."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice(["ba", "do", "ki", "lu", "me"]) for _ in range(rnd.randrange(1, 5))) for _ in range(400)]
    rows, toxic = [], {}
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(5, 60))]
        toxic[i] = int(i % 5 == 0)
        if toxic[i]:
            for _ in range(rnd.randrange(1, 5)):
                w.insert(rnd.randrange(len(w) + 1), rnd.choice(["Grub", "swine", "toad", "zorgl" + rnd.choice(vocab)]))
        rows.append((i, " ".join(w) + rnd.choice([".", "!", ""]), "clash", 1))
    return rows, toxic


def test_held_out_accuracy(spark):
    rows, toxic = labelled()
    copies = [(1000 + i, rows[0][1], "c", 1) for i in range(60)]  # a group of toxic copies must not make its words insults
    docs = spark.createDataFrame([*rows, *copies], DOCS)
    labels = spark.createDataFrame([*toxic.items(), *((1000 + i, 1) for i in range(60)), (5, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {"grub", "swine", "toad"} <= set(model.words) and "zorgl" in model.starts
    got = {r.doc_id: r for r in toxicity.scored(docs, model).where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got)
    wrong = sum((got[i].toxicity >= 0.3) != bool(toxic[i]) for i in got if i < 1000)
    assert wrong <= 0.02 * len(got)


def test_labels_of_the_held_out_part_teach_nothing(spark):
    rows, toxic = labelled()
    docs = spark.createDataFrame(rows, DOCS)
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in toxic.items()]
    one, two = (toxicity.fit(docs, spark.createDataFrame(list(x), "doc_id long, toxic int")) for x in (toxic.items(), turned))
    assert one == two


def test_edge_rows(spark):
    model = toxicity.Model({"grub": 6.0}, {"zorgl": 5.0})
    long = "word " * 30_000
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, long, "x", 1), (4, long + "You GRUB!", "x", 1), (4, long + "You GRUB!", "x", 1), (None, "zorglish talk", "x", 1), (5, "I will kill you", "x", 1)]
    out = toxicity.scored(spark.createDataFrame(rows, DOCS), model)
    got = [(r.doc_id, r.toxicity) for r in out.collect()]
    assert out.columns == ["doc_id", "text", "score", "toxicity", "toxic_clauses"] and len(got) == 7
    by = dict(got)
    assert by[1] == by[2] == by[3] < 0.2 and by[4] > 0.9 and by[None] > 0.3 and by[5] > 0.3
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.scored(empty, model).count() == 0
    assert toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int")) == toxicity.Model()


R, N, TH, TA, RE = toxicity.REACH, toxicity.NEGATED, toxicity.THREAT, toxicity.TARGET, toxicity.REPORTED


def plain_matches(symbols):
    """Weights by place, from the rules told in words: what stands where before a place decides."""
    before = lambda i, kinds, out=(): next((j for j in range(i - 1, max(-1, i - R - 1), -1) if symbols[j][0] in kinds and j not in out), None)
    got, spent_harm, aimed = {}, set(), set()
    for i, (a, lexical) in enumerate(symbols):
        w = lexical
        told = RE if any(s == "r" for s, _ in symbols[:i]) else 0
        denied = before(i, "n") is not None
        if a == "i":
            w -= (N if denied else 0) + told
        if a == "t":
            last = max((j for j in range(i) if symbols[j][0] == "h"), default=None)
            if last is not None and i - last <= R and last not in spent_harm and not any(symbols[j][0] == "t" for j in range(last + 1, i)):
                spent_harm.add(last)
                w += TH - (N if before(last, "n") is not None else 0) - told
        if a == "t" or (a == "i" and not denied):  # the nearest of the other kind, unless used up or hidden by a later one
            near = max((j for j in range(i) if symbols[j][0] == "t" or (symbols[j][0] == "i" and before(j, "n") is None)), default=None)
            if near is not None and i - near <= R and near not in aimed and (symbols[near][0] == "t") != (a == "t"):
                aimed |= {near, i}
                w += TA
        if w or lexical:
            got[i] = w
    return got


def test_the_composed_machine_is_what_the_rules_say():
    rnd = random.Random(11)
    for _ in range(4000):
        symbols = [(a, 5.0 if a == "i" else 0.0) for a in rnd.choices("oihtnr", [6, 2, 2, 2, 2, 1], k=rnd.randrange(14))]
        assert dict(toxicity.clause_matches(symbols)) == plain_matches(symbols), symbols


def plain_score(text, model):
    """The best passage over all pairs of a first and last match."""
    matches, at = [], 0
    for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", clause)
        matches += [(at + i, w) for i, w in plain_matches([model.read(w) for w in ws]).items()]
        at += len(ws)
    sums = [sum(w for _, w in matches[i : j + 1]) - model.per_word * (matches[j][0] - matches[i][0]) for i in range(len(matches)) for j in range(i, len(matches))]
    return 1 / (1 + math.exp(-(model.bias + model.slope * max([0.0, *sums]))))


def test_scores_against_brute_force():
    rnd = random.Random(12)
    model = toxicity.Model({"grub": 6.0, "dolt": 3.5}, {"zor": 2.0}, per_word=0.4)
    parts = ["you", "grub", "dolt", "zorgl", "not", "said", "kill", "plain", "word", "word", ".", "!\n", "É"]
    for _ in range(1500):
        t = " ".join(rnd.choice(parts) for _ in range(rnd.randrange(25)))
        assert abs(toxicity.score_text(t, model, {})[0] - plain_score(t, model)) < 1e-9, t


def test_every_transducer_decides():
    """Without any one of the four the label of some text turns."""
    model = toxicity.Model({"grub": 6.0, "dolt": 3.5}, bias=-5.0)
    texts = ["not a grub", "mother said grub", "i will kill you", "you dolt", "a grub", "plain"]
    parts = [toxicity.negation(), toxicity.threats(), toxicity.targets(), toxicity.reports()]
    flags = lambda machine: [toxicity.score_text(t, model, {}, machine)[0] >= 0.3 for t in texts]
    whole = flags(toxicity.GRAMMAR)
    assert whole == [False, False, True, True, True, False]
    for i in range(4):
        less = flags(toxicity.composed(parts[:i] + parts[i + 1 :]))
        assert [a != b for a, b in zip(less, whole)] == [k == i for k in (0, 3, 1, 2)] + [False, False]


def test_clean_text_around_changes_nothing(spark):
    rows, toxic = labelled()
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(docs, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    clean = ". ".join(t for i, t, *_ in rows if not toxic[i] and toxicity.evidence(t, model, {})[0] == 0)
    assert len(clean) > 50_000
    for i, t, *_ in rows[:100]:
        alone, inside = toxicity.evidence(t, model, {})[0], toxicity.evidence(f"{clean}. {t}. {clean}", model, {})[0]
        assert abs(alone - inside) < 1e-6


def test_roles_are_learned(spark):
    """Words before an insult that turn the label become negators; a word that is merely frequent does not."""
    rnd = random.Random(3)
    vocab = ["common", *(f"w{i}" for i in range(60))]
    rows, labels = [], []
    for i in range(1200):
        w, kind = [rnd.choice(vocab) for _ in range(30)], i % 6
        at = rnd.randrange(8, 25)
        if kind < 2:
            w[at : at + 1] = ["common", "grub"] if kind else ["nego", "grub"]
        elif kind == 2:
            rows.append((i + 2000, " ".join([*w[:at], "grub", *w[at + 1 :]]), "x", 1))  # grub alone is toxic
            labels.append((i + 2000, 1))
        rows.append((i, " ".join(w), "x", 1))
        labels.append((i, int(kind == 1)))
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "grub" in model.words and model.roles.get("nego") in ("n", "r") and not set(vocab) & (set(model.roles) | set(model.words))
    assert toxicity.score_text("nego grub", model, {})[0] < toxicity.score_text("common grub", model, {})[0]


def plain_places(text, phrase):
    w, p = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), phrase.split()
    return len(w), [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def test_base_places(spark):
    rnd = random.Random(4)
    parts = ["MIT", "License", "licence", "apache", "general", "public", "license", "the", "É", ".", "x1"]
    texts = [None, "", "mit license" * 3, "MIT-License apache_license", "K general public license", *(" ".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(300)), "word " * 50_000 + "Apache License"]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, score int")
    got = {r.doc_id: r for r in licenses.scanned(df).collect()}
    for i, t in enumerate(texts):
        found = {label: plain_places(t, phrase) for phrase, label in licenses.PHRASES}
        places = sorted(p for n, ps in found.values() for p in ps)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (found["mit"][0], len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == sorted(k for k, (_, ps) in found.items() if ps) and set(r.base_labels) <= set(r["labels"]) and 0 <= r.score <= 1
    assert licenses.scanned(df.limit(0)).count() == 0


def test_templates_are_found_where_phrases_are_not(spark):
    filler = [f"plain text number {i} with many words of no license at all" for i in range(200)]
    bsd = "Copyright. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: one"
    changed = "REDISTRIBUTION and use in source and binary forms, with or without changes, are permitted provided that these conditions are met"
    texts = [*filler, bsd, changed, "Licensed under CC BY-NC 4.0.", "Permission to use binary forms of source is hereby granted to any person", "cc by nc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r["labels"], r.score) for r in licenses.scanned(df).collect()}
    assert got[200][0] == ["bsd"] and got[200][1] > 0.99 and got[201][0] == ["bsd"] and got[201][1] < got[200][1]
    assert got[202][0] == ["cc-by-nc"] and got[203] == ([], 0.0) and all(got[i] == ([], 0.0) for i in range(200))


PATH = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not os.path.exists(PATH), reason="needs the vocabulary")
def test_histogram_answers(spark):
    ranks = tokens.vocabulary(PATH)
    enc = tokens.encoder(ranks, tokens.PATTERN)
    rnd = random.Random(7)
    texts = [None, "", "one", "one", *("".join(rnd.choice(["the ", "xyz", "é", " 12", "\n\n", "😀 "]) for _ in range(rnd.randrange(3000))) for _ in range(200))]
    n = [len(enc.encode_ordinary(t or "")) for t in texts]
    df = spark.createDataFrame([(t, 1, "c") for t in texts], "text string, n_tokens int, n string")
    got = tokens.answers(tokens.lengths(df, ranks, tokens.PATTERN)).collect()
    assert {r.n_tokens: r.n_docs for r in got} == Counter(n)
    for r in got:
        over = [x for x in n if x > r.n_tokens]
        assert (r.docs_over, r.tokens_over, r.truncated_total) == (len(over), sum(over), sum(min(x, r.n_tokens) for x in n))
        assert abs(r.quantile - sum(x <= r.n_tokens for x in n) / len(n)) < 1e-12
    assert tokens.answers(tokens.lengths(df.limit(0), ranks, tokens.PATTERN)).count() == 0


@pytest.mark.skipif(not os.path.exists(PATH), reason="needs the vocabulary")
def test_cuts_change_no_encoding(monkeypatch):
    enc = tokens.encoder(tokens.vocabulary(PATH), tokens.PATTERN)
    rnd = random.Random(8)
    monkeypatch.setattr(tokens, "PIECE", 50)
    for _ in range(200):
        text = "".join(rnd.choice(["word", "it's", " ", "  ", "\n", "12", "é", "_", "²", "x", "'ll", "."]) for _ in range(300))
        assert "".join(tokens.pieces(text)) == text
        assert tokens.length_of(text, enc) == len(enc.encode_ordinary(text))


def test_a_notice_that_many_files_carry_keeps_its_label(spark):
    bsd = next(t for label, t, _ in licenses.TEMPLATES if label == "bsd")
    rows = [(i, bsd if i % 3 == 0 else f"plain words of file {i}") for i in range(60)]
    got = {r.doc_id: r.labels for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (["bsd"] if i % 3 == 0 else []) for i in range(60))


def test_every_notice_of_a_file_is_found(spark):
    notices = [t for _, t, _ in licenses.TEMPLATES]
    rows = [(0, " and so on ".join(notices)), (1, ". ".join(t for label, t, _ in licenses.TEMPLATES if label in ("bsd", "mpl", "isc"))), *((i, f"plain words of file {i}") for i in range(2, 60))]
    got = {r.doc_id: r.labels for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == sorted({label for label, _, _ in licenses.TEMPLATES}) and got[1] == ["bsd", "isc", "mpl"] and not any(got[i] for i in range(2, 60))
