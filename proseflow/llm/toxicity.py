"""Toxicity as a weighted finite-state grammar over clauses.

A lexicon maps words to classes: insults with weights, verbs of harm, targets, negators and verbs of reported speech.
Four transducers, tables of states, arcs and weights, read a clause's classes one after another: negation rewrites what
it reaches, threats are harm aimed at a target, targets near an insult add to it, reported speech takes from what it
reports. They are composed into one machine, which runs over each clause from its start state. What a clause's path
weighs are log-odds; a text's evidence is its best passage, a run of clauses' matches less what the words between them
cost, so clean text before or after changes nothing, whatever its length.

The insult lexicon is learned from labelled documents: whole words, and beginnings of longer words, whose documents are
toxic more often than chance allows. Copies of a document would lend all their words false support, so a feature's
documents count once for each distinct context (the neighbours of the word). Negators, verbs of reported speech and
targets beyond the fixed ones are words next to matches that make the label less or more likely than those matches alone
do. Last, a logistic curve over the labelled sample turns evidence into a probability.

Learning reads a sample of labelled rows whose expected size is a parameter; scoring covers every text in full.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, hash_of, raw_words, spare, values

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Word classes of the grammar; fixed values, ours.
TARGETS = frozenset("you your yours u ur he she him her they them their this these those du dich dir ihr euch sie tu te toi vous vos usted ustedes ti ellos ils elles".split())
NEGATORS = frozenset("not no never isn't aren't wasn't don't nor without nicht kein keine nie ne pas jamais nunca".split())
REPORTERS = frozenset("said says say wrote writes claimed claims quoted quotes alleged reported sagte schrieb behauptete dit écrit prétend dijo escribió afirmó".split())
HARM = frozenset("kill hurt destroy murder stab shoot beat töten umbringen tuer frapper matar golpear".split())

#: Weights of the arcs, in the log-odds that the lexicon is in: a threat, an aimed insult, and what denial and report take.
THREAT, TARGET, NEGATED, REPORTED = 8.0, 1.0, 3.0, 2.0
#: Words over which a target, negator or harm verb reaches.
REACH = 4
#: Log-odds of a text about which nothing is known, and the bound of a word's.
BIAS, MOST = -2.0, 12.0
#: Lengths of word beginnings; how much likelier a feature must be in a toxic document; least weight.
PREFIXES = (3, 4, 5, 6, 7, 8)
RATIO, LEAST = 4.0, 1.5
#: Words of each role that may be learned; steps of a unit of evidence, and its bound, in the calibration.
MOST_ROLES, STEPS, TOP = 200, 4, 40

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")


#: Classes a word may have (other, insult, harm, target, negator, reporter), and those that transducers write besides:
#: a denied insult, denied harm, a threat, a denied threat.
READ, WRITTEN = "oihtnr", "IHxX"
Arcs = dict[tuple[int, str], tuple[int, str, float]]


def _counting(states, change) -> Arcs:
    """Arcs of states that count down to 0 from either side; change(state, symbol) may name another arc, else None."""
    down = lambda s: s - (s > 0) + (s < 0)
    return {(s, a): change(s, a, down(s)) or (down(s), a, 0.0) for s in states for a in READ + WRITTEN}


def negation() -> Arcs:
    """The state is how many words a negator still reaches; insults and harm there are denied."""
    def change(s, a, d):
        if a == "n":
            return REACH, a, 0.0
        return {"i": (d, "I", -NEGATED), "h": (d, "H", 0.0)}.get(a) if s else None

    return _counting(range(REACH + 1), change)


def threats() -> Arcs:
    """Harm waits for a target for REACH words, denied harm below 0; with it the target is written as a threat."""
    def change(s, a, d):
        if a in "hH":
            return (REACH if a == "h" else -REACH), a, 0.0
        if a == "t" and s:
            return (0, "x", THREAT) if s > 0 else (0, "X", THREAT - NEGATED)
        return None

    return _counting(range(-REACH, REACH + 1), change)


def targets() -> Arcs:
    """A target waits for an insult, or below 0 an insult for a target; together they weigh more, once each."""
    def change(s, a, d):
        if a in "txX":
            return (0, a, TARGET) if s < 0 else (REACH, a, 0.0)
        if a == "i":
            return (0, a, TARGET) if s > 0 else (-REACH, a, 0.0)
        return None

    return _counting(range(-REACH, REACH + 1), change)


def reports() -> Arcs:
    """After a verb of reported speech all that matches to the end of the clause weighs less."""
    told = lambda s, a: (1, a, -REPORTED if s and a in "iIxX" else 0.0) if s or a == "r" else (0, a, 0.0)
    return {(s, a): told(s, a) for s in (0, 1) for a in READ + WRITTEN}


def composed(parts: list[Arcs]) -> list[dict[str, tuple[int, str, float]]]:
    """The transducer that feeds each part with what the one before writes: a table of the states that can be reached.

    Weights of the arcs taken together add up. State 0 is the start.
    """
    number, table = {(0,) * len(parts): 0}, []
    todo = list(number)
    for states in todo:
        row = {}
        for symbol in READ:
            a, weight, after = symbol, 0.0, []
            for s, arcs in zip(states, parts, strict=True):
                s, a, w = arcs[s, a]
                weight += w
                after.append(s)
            if (to := tuple(after)) not in number:
                number[to] = len(number)
                todo.append(to)
            row[symbol] = (number[to], a, weight)
        table.append(row)
    return table


GRAMMAR = composed([negation(), threats(), targets(), reports()])
#: Roles of words that are known without labels.
ROLES = {w: role for role, words in (("t", TARGETS), ("n", NEGATORS), ("r", REPORTERS), ("h", HARM)) for w in words}


@dataclass
class Model:
    """Weights of words and of beginnings of longer words, roles of other words, what a word between matches costs, and
    the log-odds of a text: bias and slope times its evidence."""

    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=lambda: dict(ROLES))
    bias: float = BIAS
    slope: float = 1.0
    per_word: float = 0.0

    def weight(self, word: str) -> float:
        return max((w for _, w in self.matches(word)), default=0.0)

    def matches(self, word: str) -> list[tuple[str, float]]:
        """Features of the word and their weights."""
        found = [("=" + word, self.words[word])] if word in self.words else []
        return found + [("^" + word[:n], self.starts[word[:n]]) for n in PREFIXES if n < len(word) and word[:n] in self.starts]

    def read(self, word: str) -> tuple[str, float]:
        """What the lexicon writes for a word: its class and weight."""
        return ("i", w) if (w := min(self.weight(word), MOST)) > 0 else (self.roles.get(word, "o"), 0.0)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _features(word: Column) -> Column:
    parts = [F.concat(F.lit("="), word)]
    parts += [F.when(F.length(word) > n, F.concat(F.lit("^"), F.substring(word, 1, n))) for n in PREFIXES]
    return F.array_compact(F.array(*parts))


def _pruned(support: dict[str, int]) -> Model:
    """Without beginnings that a longer feature explains: one of at least four fifths of the same contexts."""
    model = Model()
    for f, a in support.items():
        body = f[1:]
        if f[0] == "^" and any(g != f and g[1:].startswith(body) and n >= 0.8 * a for g, n in support.items()):
            continue
        (model.words if f[0] == "=" else model.starts)[body] = 1.0
    return model


def _is_mixture(f: str, features: list[str], n: dict) -> bool:
    """Whether a beginning's toxic matches are mostly those of longer features that are several times purer."""
    impure = n.get((0, f), 0) / max(1, n.get((1, f), 0))
    purer: list[str] = []
    for g in sorted((g for g in features if g != f and g[1:].startswith(f[1:])), key=lambda g: (len(g), g)):
        apart = not any(h[0] == "^" and g[1:].startswith(h[1:]) for h in purer)
        if apart and (n.get((0, g), 0) + 1) / (n.get((1, g), 0) + 1) < impure / 4:
            purer.append(g)
    return sum(n.get((1, g), 0) for g in purer) >= 0.8 * max(1, n.get((1, f), 0))


def _rates(texts: DataFrame, model: Model) -> Model:
    """The model with weights: how much more often a feature occurs, per word, in toxic texts than in others."""
    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for toxic, text in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                words = _WORD.findall((text or "").lower())
                seen[toxic, ""] += len(words)
                for w in words:
                    if got := model.matches(w):
                        seen[toxic, "*"] += 1
                        seen.update((toxic, f) for f, _ in got)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["toxic", "f", "n"])

    counted = texts.select("toxic", "text").mapInArrow(count, "toxic int, f string, n long").groupBy("toxic", "f").agg(F.sum("n").alias("n"))
    n = {(r["toxic"], r["f"]): r["n"] for r in counted.collect()}  # twice the model's features
    all1, all0 = n.get((1, ""), 0) + 1, n.get((0, ""), 0) + 1
    out = Model(per_word=max(0.0, n.get((1, "*"), 0) / all1 - n.get((0, "*"), 0) / all0))
    features = ["=" + w for w in model.words] + ["^" + w for w in model.starts]
    mixed = {f[1:] for f in features if f[0] == "^" and _is_mixture(f, features, n)}
    for sign, own, new in (("=", model.words, out.words), ("^", model.starts, out.starts)):
        for body in own.keys() - (mixed if sign == "^" else set()):
            w = math.log((n.get((1, sign + body), 0) + 0.5) / all1) - math.log((n.get((0, sign + body), 0) + 0.5) / all0)
            if w >= LEAST:
                new[body] = w
    return out


def _clauses(text: str | None) -> list[list[str]]:
    return [w for c in _CLAUSE.split((text or "").lower()) if (w := _WORD.findall(c))]


def _roles(texts: DataFrame, model: Model, share: dict[str, float]) -> dict[str, str]:
    """Roles of words that change how often matches near them are toxic, by more than chance allows.

    share: of a feature's contexts the toxic share, which is what a match is expected to be. Words up to REACH before a
    match that make it rarer are negators, words further before it reporters; words up to REACH on either side that make
    it more frequent are targets. A document counts once, and so do
    documents that hold the word in equal clauses.
    """
    def near(batches):
        for batch in batches:
            rows = set()
            for toxic, text, doc in zip(*(values(c) for c in batch.columns), strict=True):
                for ws in _clauses(text):
                    for i, w in enumerate(ws):
                        if got := model.matches(w):
                            q, key = share.get(max(got, key=lambda g: g[1])[0], 0.5), hash_of(" ".join(ws))
                            rows |= {("n", c, toxic, q, key, doc) for c in ws[max(0, i - REACH) : i]} | {("r", c, toxic, q, key, doc) for c in ws[: max(0, i - REACH)]}
                            rows |= {("t", c, toxic, q, key, doc) for c in ws[max(0, i - REACH) : i] + ws[i + 1 : i + 1 + REACH]}
            kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["role", "word", "toxic", "q", "clause", "doc"])

    placed = texts.select("toxic", "text", F.col("doc_id").cast("long").alias("doc")).mapInArrow(near, "role string, word string, toxic int, q double, clause long, doc long")
    once = placed.groupBy("role", "word", "toxic", "doc").agg(F.min(F.struct("clause", "q")).alias("x"))
    seen = once.groupBy("role", "word", "toxic", "x.clause").agg(F.min("x.q").alias("q"))
    counts = checkpointed(seen.groupBy("role", "word").agg(F.count("*").alias("n"), F.sum("toxic").alias("a"), F.avg("q").alias("q")).where("n >= 3"))
    tried = counts.count()
    p, q = F.col("a") / F.col("n"), F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("q")))
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    kl = F.col("n") * (part(p, q) + part(1 - p, 1 - q))
    rarer, likelier = p / (1 - p + 1e-9) < q / (1 - q) / RATIO, p / (1 - p + 1e-9) > RATIO * q / (1 - q)
    sure = counts.where((kl > math.log(max(tried, 2)) + 2) & F.when(F.col("role") == "t", likelier).otherwise(rarer)).select("role", "word", kl.alias("kl"))
    found = {}
    for role in "trn":  # a word of several roles is a negator first
        found |= {r["word"]: role for r in sure.where(F.col("role") == role).orderBy(F.desc("kl"), "word").limit(MOST_ROLES).collect()}
    return {w: role for w, role in found.items() if not model.matches(w)}


def _calibrated(texts: DataFrame, model: Model, have: dict[int, int]) -> Model:
    """The model with bias and slope of a logistic curve over the sample's evidence, classes weighted as in the table.

    Targets are drawn in by one document of each class, so that separable classes give a finite slope.
    """
    def count(batches):
        cache: dict = {}
        seen: Counter = Counter()
        for batch in batches:
            for toxic, text in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                seen[toxic, int(min(evidence(text, model, cache)[0], TOP) * STEPS)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["toxic", "cell", "n"])

    counted = texts.select("toxic", "text").mapInArrow(count, "toxic int, cell int, n long").groupBy("toxic", "cell").agg(F.sum("n").alias("n"))
    rows = counted.collect()  # two classes by STEPS * TOP + 1 cells
    n = {c: sum(r["n"] for r in rows if r["toxic"] == c) for c in (0, 1)}
    if not n[0] or not n[1]:
        return model
    x = np.array([r["cell"] / STEPS for r in rows])
    w = np.array([r["n"] * have[r["toxic"]] / n[r["toxic"]] for r in rows], float)
    t = np.array([(n[1] + 1) / (n[1] + 2) if r["toxic"] else 1 / (n[0] + 2) for r in rows])
    at, m = np.array([math.log(have[1] / have[0]), 0.0]), np.stack([np.ones_like(x), x], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(m @ at, -30, 30)))
        step = np.linalg.solve((m * (w * p * (1 - p))[:, None]).T @ m + 1e-6 * np.eye(2), m.T @ (w * (t - p)))
        at = at + step * min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    if at[1] > 0:
        model.bias, model.slope = float(at[0]), float(at[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 2_000, most_features: int = 2_000, seed: int = 11) -> Model:
    """Learns the lexicon from labelled rows outside the held-out part.

    rows_per_class bounds the sample in expectation: of either class about so many labelled ids are taken, by a hash
    of the id. most_features bounds the model: features beyond it, those nearest to chance, are not learned; nor are
    features of fewer than three distinct contexts, which no test tells from chance. A document labelled twice is toxic
    if any of its labels says so; null ids and null labels teach nothing. Without usable labels, as from empty tables,
    the lexicon is empty and only threats score.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = checkpointed(known)
    have = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not have.get(1) or not have.get(0):
        return Model()
    share = F.when(F.col("toxic") == 1, F.lit(rows_per_class / have[1])).otherwise(F.lit(rows_per_class / have[0]))
    sample = known.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    texts = checkpointed(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))  # at most about 2 x rows_per_class ids
    placed = texts.select("doc_id", "toxic", raw_words(F.lower("text")).alias("w")).select("doc_id", "toxic", "w", F.posexplode("w").alias("at", "word"))
    near = placed.select("doc_id", "toxic", "word", F.xxhash64(F.when(F.col("at") > 0, F.get("w", F.col("at") - 1)), F.lit(0), F.get("w", F.col("at") + 1)).alias("ctx"))
    once = near.groupBy("doc_id", "toxic", "word").agg(F.min("ctx").alias("ctx"))
    by_doc = once.select("doc_id", "toxic", "ctx", F.explode(_features(F.col("word"))).alias("f")).groupBy("doc_id", "toxic", "f").agg(F.min("ctx").alias("ctx"))
    contexts = by_doc.select("f", "toxic", "ctx").distinct()
    counts = checkpointed(contexts.groupBy("f").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a + b >= 3"))
    tried = counts.count()
    n1, n0 = min(have[1], rows_per_class), min(have[0], rows_per_class)
    q = n1 / (n1 + n0)
    n = F.col("a") + F.col("b")
    kl = F.col("a") * F.log(F.col("a") / n / q) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / n / (1 - q))).otherwise(0.0)
    # Chernoff's bound on chance, times the features tried: few false features are to be expected (the bound is loose by a
    # factor of e squared and more at these counts).
    likelier = F.col("a") / n1 > RATIO * F.col("b") / n0
    sure = counts.where((F.col("a") >= 3) & likelier & (kl > math.log(max(tried, 2)) - 2))
    best = sure.select("f", "a", "b", kl.alias("kl")).orderBy(F.desc("kl"), "f").limit(most_features).collect()
    model = _rates(texts, _pruned({r["f"]: r["a"] for r in best}))
    model.roles |= _roles(texts, model, {r["f"]: (r["a"] + 0.5) / (r["a"] + r["b"] + 1) for r in best})
    return _calibrated(texts, model, have)


def clause_matches(symbols: list[tuple[str, float]], grammar=GRAMMAR) -> list[tuple[int, float]]:
    """Places in a clause where its path weighs anything, and the weights; symbols are its words' classes and weights."""
    state, out = 0, []
    for i, (a, lexical) in enumerate(symbols):
        state, _, w = grammar[state][a]
        if w or lexical:
            out.append((i, w + lexical))
    return out


def evidence(text: str | None, model: Model, cache: dict[str, tuple[str, float]], grammar=GRAMMAR) -> tuple[float, int]:
    """The weight of a text's best passage, 0 at least, and how many clauses matched."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    hot = set()
    for w in set(words):
        if w not in cache:
            if len(cache) > 200_000:
                cache.clear()
            cache[w] = model.read(w)
        if cache[w][0] in "ih":
            hot.add(w)
    best, run, last, at, clauses = 0.0, 0.0, 0, 0, 0
    for clause in _CLAUSE.split(low) if hot else ():
        own = _WORD.findall(clause)
        if not hot.isdisjoint(own):
            found = clause_matches([cache[w] if w in cache else model.read(w) for w in own], grammar)
            for i, weight in found:
                run = max(0.0, max(0.0, run - model.per_word * (at + i - last)) + weight)
                last = at + i
                best = max(best, run)
            clauses += bool(found)
        at += len(own)
    return best, clauses


def score_text(text: str | None, model: Model, cache: dict[str, tuple[str, float]], grammar=GRAMMAR) -> tuple[float, int]:
    """Probability of the toxic label, and how many clauses matched."""
    found, clauses = evidence(text, model, cache, grammar)
    return 1 / (1 + math.exp(-max(-30.0, min(model.bias + model.slope * found, 30.0)))), clauses


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity", matched: str = "toxic_clauses") -> DataFrame:
    """All columns of docs with the score (0 to 1, higher: likelier toxic) and the number of matched clauses.

    Null and empty texts get the score of a text without matches; very long texts are read whole. Columns named as the
    new ones are replaced. Rows stay as they are, repeated ones too; equal texts score alike. An empty table gives an
    empty table.
    """
    rows = docs.drop(out, matched)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType()), T.StructField(matched, T.IntegerType())])
    at = rows.columns.index(text_col)

    def run(batches):
        cache: dict[str, tuple[str, float]] = {}
        for batch in batches:
            got = [score_text(t, model, cache) for t in values(batch.column(at))]
            new = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, out, matched])

    return rows.mapInArrow(run, schema)


def cleaned(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds) -> DataFrame:
    """The rows of docs whose score is below threshold, with all their columns; edge cases are those of scored and fit."""
    score, clauses = spare(docs, "toxicity", "clauses")
    kept = scored(docs, fit(docs, labels, **bounds), out=score, matched=clauses).where(F.col(score) < threshold)
    return kept.drop(score, clauses)
