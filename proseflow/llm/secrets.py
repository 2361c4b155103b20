"""Secret scans by a battery of randomness tests, in DataFrame operations only.

Besides what fixed patterns find, every unbroken run of twenty or more letters, digits and base64 signs is a candidate.
The encoding of each is inferred from its characters, and three kinds of tests ask whether it could be drawn at random
from that encoding's alphabet: chi-squared for uniform use of the alphabet (of its characters, and of vowels, consonants,
digits and signs), runs (about the alphabet's middle, and of cases, digits and signs), and serial correlation (of places
in the alphabet, and of letter pairs that are common in writing). Six times the smallest p-value says how random it looks.

What must not be reported are names and other strings made of words, so the false-discovery control is of the null
hypothesis that a candidate is such a string. How random those look is learned, per class of lengths, from strings made
of every document's own words as programmers make names of them (and of a fixed list of words, for corpora of few texts).
A candidate's p-value is the share of them that look at least as random; Benjamini-Hochberg control over all candidates
of a class of lengths then says which to report, so that of what is reported at most the given share is expected to be
words. Short strings show little, and so need to look more random.

Matches and their places come from one expression per row: what a pattern splits a text into and what it extracts
alternate, so their lengths add up to places. Nothing is shuffled but a histogram of a bounded number of cells.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Kind, pattern, group whose length counts, shortest length of it; fixed values. Base kinds first, in the order of ties.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
#: Characters of a candidate at least.
SHORTEST = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"

#: Encodings in the order they are tried: name, what all characters match, alphabet; fixed values.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("random_hex", "^[0-9a-f]+$", DIGITS + "abcdef"), ("random_hex", "^[0-9A-F]+$", DIGITS + "ABCDEF"), ("random_base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("random_base36", "^[a-z0-9]+$", DIGITS + LOWER), ("random_base36", "^[A-Z0-9]+$", DIGITS + UPPER), ("random_base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("random_base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"), ("random_base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("random_mixed", "^[A-Za-z0-9+/_-]+$", UPPER + LOWER + DIGITS + "+/-_"))
KINDS = ("assign", "access", "hex", "random_hex", "random_base32", "random_base36", "random_base62", "random_base64", "random_base64url", "random_mixed")

#: Letter pairs that are common in English, German, French or Spanish writing; fixed values.
PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ca el ta la ns di fo ho pe ec pr no ct us "
    "ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op wo sa ay ex ke "
    "ei au eu qu ui ue ck sc ru ag cu").split()
#: Words that names are made of besides those of the texts; fixed values.
WORDS = (
    "account action address after amount and array base before block button by cache call change chapter check class client code column config content count create current data date default delete "
    "document element error event field file filter find first for format from get group handler has header id identifier index info input is item key last length level line link list load local long "
    "manager map message method mode model module name new next node not number object of on option order page paragraph parameter parent parse path point process property query read record release "
    "remove report request response result row run section select server service session set show size source start state status string table target task test text this time title to type update url user "
    "value version very view with word write").split()

#: Cells of the histogram: p-values by twentieths of a decade down to 1e-10, lengths by quarters of an octave.
STEPS, DEEPEST = 20, 200
#: Names made of WORDS, over all lengths; code points of a document that names are made of; longest name.
NAMES, SNIPPET, LONGEST = 2_500, 400, 160
SPANS = "array<struct<start:int,k:int,end:int,body:string>>"


def let(value: Column, use) -> Column:
    """use(value), value being computed once."""
    return F.transform(F.array(value), use)[0]


def _sums(lengths: Column) -> Column:
    """The sum of the lengths before each place: by blocks of about the root of their number, in n to the power 1.5."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def blocked(w):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / w).cast("int")), lambda b: total(F.slice(lengths, b * w + 1, w)))
        starts = let(blocks, lambda bs: F.transform(bs, lambda x, b: total(F.slice(bs, F.lit(1), b))))
        return let(starts, lambda ss: F.transform(lengths, lambda x, i: ss[F.floor(i / w).cast("int")] + total(F.slice(lengths, F.floor(i / w).cast("int") * w + 1, i % w))))

    return let(F.ceil(F.sqrt(F.size(lengths))).cast("int"), blocked)


def _spans(text: Column, pattern: str, group: int, shortest: int, kind: int) -> Column:
    """Places of the pattern's matches whose group is long enough, leftmost first; code points, ends exclusive."""
    rx = F.lit(pattern)

    def walk(gaps, hits, bodies):
        lengths = F.transform(hits, lambda h, i: F.length(gaps[i]) + F.length(h))

        def placed(before):
            def one(h, i):
                start = before[i] + F.length(gaps[i])
                return F.struct(start.alias("start"), F.lit(kind).alias("k"), (start + F.length(h)).alias("end"), h.alias("body"), F.length(bodies[i]).alias("n"))

            long = F.filter(F.transform(hits, one), lambda x: x["n"] >= shortest)
            return F.transform(long, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), x["body"].alias("body")))

        return let(let(lengths, _sums), placed)

    found = let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, rx, F.lit(0)), lambda hits: let(F.regexp_extract_all(text, rx, F.lit(group)) if group else hits, lambda bodies: walk(gaps, hits, bodies))))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def _tail(z: Column) -> Column:
    """The normal distribution's upper tail, by the logistic approximation (off by less than 2e-4)."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z))))


def _chi_tail(chi: Column, df: Column) -> Column:
    """The chi-squared distribution's upper tail, by Wilson and Hilferty's cube root; 1 without a degree of freedom."""
    part = 2 / (9 * F.greatest(df, F.lit(1.0)))
    return F.when(df < 1, F.lit(1.0)).otherwise(_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - part)) / F.sqrt(part)))


#: Sets of characters that are counted together: for the second chi-squared test, and for the second runs test.
GROUPS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", DIGITS, "+/-_")
CASES = (LOWER, UPPER, DIGITS, "+/-_")


@lru_cache
def _facts(alphabet: str) -> tuple[list[float], float, float]:
    """Shares of GROUPS, chance that neighbours differ in CASES, chance that they are a common pair."""
    m, common = len(alphabet), set(PAIRS)
    pairs = sum(a.lower() + b.lower() in common for a in alphabet for b in alphabet)
    return [sum(c in g for c in alphabet) / m for g in GROUPS], 1 - sum((sum(c in g for c in alphabet) / m) ** 2 for g in CASES), pairs / m**2


def _p_value(body: Column, e: Column) -> Column:
    """Bonferroni's combination of the six tests' p-values for the encoding of number e."""
    facts = [_facts(a) for _, _, a in ENCODINGS]
    known = F.array(*(F.struct(F.lit(a).alias("alphabet"), F.array(*map(F.lit, shares)).alias("shares"), F.lit(q).alias("q"), F.lit(r).alias("r")) for (_, _, a), (shares, q, r) in zip(ENCODINGS, facts, strict=True)))
    plus = lambda a, x: a + x

    def battery(x, chars, v):
        m, n = F.length(x["alphabet"]).cast("double"), F.size(chars).cast("double")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(F.length(body) - F.length(F.replace(body, c, F.lit(""))), 2))
        uniform = _chi_tail(m / n * squares - n, m - 1)
        have = F.array(*(F.length(F.translate(body, "".join(sorted(set(LOWER + UPPER + DIGITS + "+/-_") - set(g))), "")).cast("double") for g in GROUPS))
        cells = F.filter(F.arrays_zip(have.alias("have"), x["shares"].alias("share")), lambda c: c["share"] > 0)
        grouped = let(cells, lambda cs: _chi_tail(F.aggregate(cs, F.lit(0.0), lambda a, c: a + F.pow(c["have"] - n * c["share"], 2) / (n * c["share"])), F.size(cs).cast("double") - 1))
        steps = F.sequence(F.lit(1), F.size(v) - 1)
        count = lambda hit: F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.when(hit(i), 1.0).otherwise(0.0))
        z = lambda k, p: (k - (n - 1) * p) / F.sqrt((n - 1) * p * (1 - p))

        def middle(high, changes):
            mu = 2 * high * (n - high) / n + 1
            var = (mu - 1) * (mu - 2) / (n - 1)
            return F.when(var <= 0, F.lit(0.0)).otherwise(2 * _tail(F.abs(changes + 1 - mu) / F.sqrt(var)))

        runs = let(F.struct(F.aggregate(v, F.lit(0.0), lambda a, y: a + F.when(y >= m / 2, 1.0).otherwise(0.0)).alias("h"), count(lambda i: (v[i] >= m / 2) != (v[i - 1] >= m / 2)).alias("c")), lambda y: middle(y["h"], y["c"]))
        case = F.split(F.translate(body, LOWER + UPPER + DIGITS + "+/-_", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 4), "")
        changes = let(case, lambda c: F.when(x["q"] > 0, 2 * _tail(F.abs(z(count(lambda i: c[i] != c[i - 1]), x["q"])))).otherwise(F.lit(1.0)))

        def serial(mean):
            own = F.aggregate(v, F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean))
            both = F.aggregate(steps, F.lit(0.0), lambda a, i: a + (v[i] - mean) * (v[i - 1] - mean))
            return F.when(own <= 0, F.lit(0.0)).otherwise(2 * _tail(F.abs(both / own + 1 / n) * F.sqrt(n)))

        low = F.split(F.lower(body), "")
        pairs = let(low, lambda c: F.when(x["r"] > 0, _tail(z(count(lambda i: F.contains(F.lit(" " + " ".join(PAIRS) + " "), F.concat(c[i - 1], c[i]))), x["r"]))).otherwise(F.lit(1.0)))
        return F.least(F.lit(1.0), 6 * F.least(uniform, grouped, runs, changes, let(F.aggregate(v, F.lit(0.0), plus) / n, serial), pairs))

    places = lambda x, chars: F.transform(chars, lambda c: F.instr(x["alphabet"], c).cast("double") - 1)
    return let(known[e], lambda x: let(F.filter(F.split(body, ""), lambda c: c != ""), lambda chars: let(places(x, chars), lambda v: battery(x, chars, v))))


def _encoding(body: Column) -> Column:
    """Number of the first encoding that has all the characters, from 0."""
    out = F.when(F.lit(False), F.lit(0))
    for i, (_, rx, _) in enumerate(ENCODINGS):
        out = out.when(body.rlike(rx), F.lit(i))
    return out


def _judged(body: Column) -> Column:
    """Kind, class of lengths and cell of the p-value of a candidate's text."""
    names = F.array(*(F.lit(KINDS.index(name)) for name, _, _ in ENCODINGS))

    def told(e):
        cell = let(_p_value(body, e), lambda p: F.least(F.lit(DEEPEST), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS).cast("int")))
        return F.struct(names[e].alias("k"), F.floor(F.log2(F.length(body).cast("double")) * 4).cast("int").alias("len"), cell.alias("cell"))

    return let(_encoding(body), told)


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns, by start, then kind, then end."""
    return F.array_sort(F.concat(*(_spans(text, rx, group, shortest, k) for k, (_, rx, group, shortest) in enumerate(BASE))))


def tested(text: Column, base: Column) -> Column:
    """What base spans leave of each candidate, where it is long enough: place, kind, class of lengths, cell."""
    def free(s):
        def cut(over):
            starts = F.concat(F.array(s["start"]), F.transform(over, lambda b, i: F.array_max(F.transform(F.slice(over, F.lit(1), i + 1), lambda o: o["end"]))))
            ends = F.concat(F.transform(over, lambda b: b["start"]), F.array(s["end"]))
            parts = F.arrays_zip(starts.alias("a"), ends.alias("b"))
            long = F.filter(parts, lambda p: p["b"] - p["a"] >= SHORTEST)
            return F.transform(long, lambda p: F.struct(p["a"].alias("start"), p["b"].alias("end"), F.substring(s["body"], p["a"] - s["start"] + 1, p["b"] - p["a"]).alias("body")))

        return let(F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])), cut)

    parts = F.flatten(F.transform(_spans(text, CANDIDATE, 0, SHORTEST, 0), free))
    return F.transform(parts, lambda s: let(_judged(s["body"]), lambda j: F.struct(s["start"].alias("start"), j["k"].alias("k"), s["end"].alias("end"), j["len"].alias("len"), j["cell"].alias("cell"))))


def named(words: Column, seed: Column) -> Column:
    """A string made of words as programmers do: in one case or another, joined in one way or another, with numbers.

    Its length is one of 20 to LONGEST, spread evenly over the classes of lengths; null where the words are too few.
    """
    pick = lambda k, n: F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(n))
    number = lambda i: F.pmod(F.xxhash64(seed, i), F.lit(100))
    numbered = F.transform(words, lambda w, i: F.concat(w, F.when(number(i) < 25, number(i + 1000).cast("string")).otherwise("")))
    style = pick(-1, 5)
    joined = let(numbered, lambda ws: F.when(style == 0, F.array_join(ws, "")).when(style == 1, F.array_join(F.transform(ws, F.initcap), "")).when(style == 2, F.array_join(ws, "_"))
                 .when(style == 3, F.upper(F.array_join(ws, "_"))).otherwise(F.array_join(F.transform(ws, lambda w: F.concat(w, number(F.length(w)).cast("string"))), "-")))
    length = F.floor(SHORTEST * F.pow(F.lit(LONGEST / SHORTEST), pick(-2, 1000) / 1000)).cast("int")
    return let(F.substring(joined, F.lit(1), length), lambda t: F.when(F.length(t) >= SHORTEST, t))


def thresholds(cells: list[tuple[int, int, int]], names: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """Per class of lengths, the cell below which candidates are reported at a false-discovery rate of rate.

    Both lists: (class of lengths, cell, number), of candidates and of made names; a small cell looks random. A class
    without names takes those of the next shorter class that has some, against which random strings show less.
    """
    by, null = defaultdict(dict), defaultdict(dict)
    for table, rows in ((by, cells), (null, names)):
        for length, cell, n in rows:
            table[length][cell] = table[length].get(cell, 0) + n
    out = {}
    for length, own in by.items():
        like = null[max((x for x in null if x <= length), default=min(null, default=0))] if null else {}
        total, made, seen, alike, limit = sum(own.values()), sum(like.values()), 0, 0, 0
        for cell in range(DEEPEST + 1):
            alike += like.get(cell, 0)
            if cell in own:
                seen += own[cell]
                if (1 + alike) / (1 + made) * total <= rate * seen:
                    limit = cell + 1
        out[length] = limit
    return out


def _fixed_names(spark) -> DataFrame:
    """Judged names of WORDS."""
    words = F.array(*map(F.lit, WORDS))
    seeds = spark.range(NAMES).select("id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: words[F.pmod(F.xxhash64("id", i), F.lit(len(WORDS))).cast("int")]).alias("w"))
    return checkpointed(seeds.select(let(named(F.col("w"), F.col("id")), lambda t: F.when(t.isNotNull(), _judged(t))).alias("t"))).where("t IS NOT NULL")


def scanned(docs: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, found`` per row of docs: spans (start, k, end), k a place in KINDS, by start, kind and end.

    base has the fixed patterns' spans, found those and the random candidates. Null and empty texts have none; very long
    texts are read whole. Repeated rows each get a row and count each in the false-discovery control. Candidates of one
    cell tie: all of them are reported or none. An empty table gives an empty table. Other columns of docs are not read.
    """
    slim = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    seed = F.xxhash64("text")
    from_words = F.regexp_extract_all(F.lower(F.substring("text", (F.pmod(seed, F.greatest(F.lit(1), F.length("text") - SNIPPET)) + 1).cast("int"), F.lit(SNIPPET))), F.lit("[a-z]{2,}"), F.lit(0))
    name = let(named(from_words, seed), lambda t: F.when(t.isNotNull(), _judged(t)))
    rows = checkpointed(rows.select("doc_id", slim(F.col("base")).alias("base"), F.when(F.col("text").rlike(CANDIDATE), tested(F.col("text"), F.col("base"))).alias("tests"), name.alias("name")))
    count = lambda df: [(r["len"], r["cell"], r["n"]) for r in df.groupBy("t.len", "t.cell").agg(F.count("*").alias("n")).collect()]
    # At most DEEPEST + 1 cells for each of some 130 classes.
    cells = count(rows.where("size(tests) > 0").select(F.explode("tests").alias("t")))
    limits = {-1: 0}
    if cells:
        limits |= thresholds(cells, count(rows.where("name IS NOT NULL").select(F.col("name").alias("t"))) + count(_fixed_names(docs.sparkSession)), rate)
    known = F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v))))
    good = F.filter(F.coalesce("tests", F.array().cast(dict(rows.dtypes)["tests"])), lambda t: t["cell"] < F.coalesce(F.try_element_at(known, t["len"]), F.lit(0)))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", slim(good))).alias("found"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
