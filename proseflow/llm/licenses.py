"""License scans by a positional rare-token index.

Words of the license templates are weighted by inverse document frequency over the whole corpus. A file's occurrences
of them are looked up in the templates' postings (word to template and place); postings that
agree on a relative position are votes for that template starting at that place of the file. The best placed template
wins if enough of its weight stands there and one of its mandatory key phrases does, word by word.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import values

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: The phrases whose places are counted, and their labels; fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, wording, mandatory key phrases; fixed values: short public license notices.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
)


@dataclass
class Index:
    """Postings and weights; bounded by the templates."""

    idf: dict[bytes, float]
    postings: dict[bytes, list[tuple[int, int]]]
    weight: list[float]
    words: list[list[bytes]]


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words of a UTF-8 text; bytes.lower changes A-Z only."""
    return _WORD.findall(text.lower()) if text else []


def _vocabulary() -> set[bytes]:
    return {w for _, t, keys in TEMPLATES for w in words_of(" ".join((t, *keys)).encode())}


def build_index(docs: DataFrame, text_col: str = "text") -> Index:
    """The index with document frequencies of the template words counted over all rows of docs.

    No frequency shuts a word out: a notice that many files carry is a notice all the same.
    """
    vocabulary = _vocabulary()

    def count(batches):
        seen: Counter = Counter()
        n = 0
        for batch in batches:
            for t in values(batch.column(0)):
                n += 1
                seen.update(vocabulary.intersection(words_of(t)))
        seen[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "word binary, n long")
    df = {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # the templates' words
    total = df.get(b"", 0)
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    postings = defaultdict(list)
    words = [words_of(t.encode()) for _, t, _ in TEMPLATES]
    for k, ws in enumerate(words):
        for i, w in enumerate(ws):
            postings[w].append((k, i))
    return Index(idf, dict(postings), [sum(idf[w] for w in ws) for ws in words], words)


def phrase_places(words: list[bytes], at: dict[bytes, list[int]], phrase: bytes) -> list[int]:
    """Where the phrase's words stand one after another."""
    parts = phrase.split(b" ")
    rare = min(range(len(parts)), key=lambda i: len(at.get(parts[i], ())))
    return [p - rare for p in at.get(parts[rare], ()) if p >= rare and words[p - rare : p - rare + len(parts)] == parts]


def scan(text: bytes | None, index: Index, enough: float = 0.6) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, all labels, score) of one text.

    enough is the share of a template's weight that has to stand at the place voted for. Every word of a template
    votes for it, whatever else the file holds; templates none of whose key phrases stands in the text are left out first.
    """
    words = words_of(text)
    there = index.idf.keys() & set(words)
    if not there:
        return len(words), 0, None, None, [], [], 0.0
    at = defaultdict(list)
    for i, w in enumerate(words):
        if w in there:
            at[w].append(i)
    base, labels = [], set()
    for phrase, label in PHRASES:
        if found := phrase_places(words, at, phrase.encode()):
            base += found
            labels.add(label)
    base_labels, best = sorted(labels), 0.0
    keyed = {k for k, (_, _, keys) in enumerate(TEMPLATES) if any(phrase_places(words, at, key.encode()) for key in keys)}
    votes: Counter = Counter()
    for w in there if keyed else ():
        for k, i in index.postings.get(w, ()):
            if k in keyed:
                for p in at[w]:
                    votes[k, p - i] += 1
    got: dict[int, float] = {}
    for (k, start), n in votes.items():
        if n < 2:  # one word alone has no relative position to agree on
            continue
        ws = index.words[k]
        share = sum(index.idf[w] for i, w in enumerate(ws) if 0 <= start + i < len(words) and words[start + i] == w) / index.weight[k]
        got[k] = max(got.get(k, 0.0), share)
    for k, share in got.items():
        if share >= enough:
            labels.add(TEMPLATES[k][0])
            best = max(best, share)
    if base_labels:
        best = max(best, 0.5)
    return len(words), len(base), min(base, default=None), max(base, default=None), base_labels, sorted(labels), min(best, 1.0)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row of docs.

    Null and empty texts have no words, no labels and score 0. Repeated rows each get a row; an empty table gives an
    empty table. Other columns of docs are not read.
    """
    index = build_index(docs, text_col)
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64())]

    def run(batches):
        for batch in batches:
            got = [scan(t, index, **how) for t in values(batch.column(1))]
            new = [pa.array([g[i] for g in got], kind) for i, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=["doc_id", *(n for n, _ in kinds)])

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return thin.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double")
