"""The secret scan against plain Python: places of the fixed patterns, and the battery on planted strings."""

import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from proseflow.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
SCHEMA = "doc_id long, text string, base string, found long"


def plain(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in secrets.scanned(df).collect()}


def spans(rows):
    return [(s.start, s.k, s.end) for s in rows]


def test_base_spans_are_those_of_a_plain_scan(spark):
    rnd = random.Random(1)
    parts = ["token", "Secret", "API_KEY", "apikey", "passwd", "=", " = ", ": ", '"', "'", "ab", "abcdef", "é😀", "AKIA", "AKIA" + "X" * 16, "AKIAAKIA" + "7" * 12, "0a" * 12, "F" * 24, " ", "\n", ".", "secret=token: abcdefgh"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(300)]
    got = scan(spark, [None, "", *texts])
    for i, t in enumerate([None, "", *texts]):
        assert spans(got[i].base) == plain(t), t
        assert set(spans(got[i].base)) <= set(spans(got[i].found))


ALPHABETS = {"random_hex": "0123456789ABCDEF", "random_base32": secrets.UPPER + "234567", "random_base36": secrets.LOWER + secrets.DIGITS, "random_base62": secrets.UPPER + secrets.LOWER + secrets.DIGITS, "random_base64": secrets.UPPER + secrets.LOWER + secrets.DIGITS + "+/"}
VERBS, NOUNS = "fetch render resolve merge commit validate schedule upload encrypt cancel".split(), "invoice customer thread bucket schema cluster widget payload ledger sensor region catalog".split()


def harmless(rnd, n):
    """Names as programs hold them, of words that the list in the module mostly lacks; n characters or a few more."""
    out, style = "", rnd.randrange(4)
    while len(out) < n:
        w = rnd.choice([*VERBS, *NOUNS]) + (str(rnd.randrange(100)) if rnd.random() < 0.3 else "")
        out += w if style == 0 else w.capitalize() if style == 1 else ("_" if out else "") + w if style == 2 else ("-" if out else "") + w.upper()
    return out


def test_at_most_the_rate_is_false_and_most_keys_are_found(spark):
    """Per length: keys of all encodings among three times as many harmless names."""
    rnd = random.Random(2)
    for n in (20, 24, 32, 48):
        keys = ["".join(rnd.choice(a) for _ in range(n)) for a in ALPHABETS.values() for _ in range(24)]
        names = [harmless(rnd, n) for _ in range(360)]
        got = scan(spark, [f"x {k} y" for k in (*keys, *names)])
        hit = [any(s.k > 2 for s in got[i].found) for i in range(len(got))]
        found, false = sum(hit[: len(keys)]), sum(hit[len(keys) :])
        assert found >= 0.9 * len(keys) and false <= 0.05 * (found + false), (n, found, false)


def test_words_and_orders_are_no_secrets(spark):
    dull = ["a" * 45, "abcdefghijklmnopqrstuvwxyz0123456789abcdefghijkl", "the_long_name_of_a_function_in_release_20_of_24x", "internationalizationofcommunications", "chapter12section4paragraph7",
            "getUserAccountById2AndName3", "ThisIsAVeryLongIdentifier2024v10", "1234567890123456789012", "usr/local/lib/python3/site-packages"] * 20
    rnd = random.Random(3)
    keys = ["".join(rnd.choice(ALPHABETS["random_base62"]) for _ in range(rnd.randrange(24, 41))) for _ in range(40)]
    got = scan(spark, [f"x {k} y" for k in (*keys, *dull)])
    hit = [any(s.k > 2 for s in got[i].found) for i in range(len(got))]
    assert sum(hit[:40]) >= 36 and not any(hit[40:])
    assert spans(got[0].found) == [(2, secrets.KINDS.index("random_base62"), 2 + len(keys[0]))]


def test_what_a_base_span_leaves_is_tested(spark):
    rnd = random.Random(5)
    keys = ["".join(rnd.choice(ALPHABETS["random_base62"]) for _ in range(40)) for _ in range(60)]
    # The assignment ends at the slash of neither alphabet's start: the run goes on before it.
    got = scan(spark, [f"{k}/token=abcdefgh" for k in keys])
    assert all(spans(got[i].base) == [(41, 0, 55)] for i in got)
    assert sum(any(s.k > 2 and s.start == 0 and s.end == 41 for s in got[i].found) for i in got) >= 54


def plain_encoding(body):
    return next(i for i, (_, rx, _) in enumerate(secrets.ENCODINGS) if re.search(rx, body))


def plain_p(body, e):
    """The six tests as their formulas stand in books."""
    alphabet = secrets.ENCODINGS[e][2]
    n, m = len(body), len(alphabet)
    tail = lambda z: 1 / (1 + math.exp(max(-700, min(700, 1.5976 * z + 0.07056 * z**3))))
    chi_tail = lambda chi, df: tail(((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))) if df >= 1 else 1.0
    v = [alphabet.index(c) for c in body]
    ps = [chi_tail(sum((body.count(c) - n / m) ** 2 / (n / m) for c in alphabet), m - 1)]
    groups = [[sum(c in g for c in body), n * sum(c in g for c in alphabet) / m] for g in secrets.GROUPS]
    groups = [g for g in groups if g[1]]
    ps.append(chi_tail(sum((o - x) ** 2 / x for o, x in groups), len(groups) - 1))
    high = [x >= m / 2 for x in v]
    h, r = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    mu = 2 * h * (n - h) / n + 1
    var = (mu - 1) * (mu - 2) / (n - 1)
    ps.append(0 if var <= 0 else 2 * tail(abs(r - mu) / math.sqrt(var)))
    kind = lambda c: next(i for i, g in enumerate(secrets.CASES) if c in g)
    z = lambda k, p: (k - (n - 1) * p) / math.sqrt((n - 1) * p * (1 - p))
    q = sum(kind(a) != kind(b) for a in alphabet for b in alphabet) / m**2
    ps.append(2 * tail(abs(z(sum(kind(a) != kind(b) for a, b in zip(body, body[1:])), q))) if q else 1.0)
    c = sum(v) / n
    own = sum((x - c) ** 2 for x in v)
    ps.append(0 if not own else 2 * tail(abs(sum((a - c) * (b - c) for a, b in zip(v[1:], v)) / own + 1 / n) * math.sqrt(n)))
    share = sum((a + b).lower() in secrets.PAIRS for a in alphabet for b in alphabet) / m**2
    ps.append(tail(z(sum((a + b).lower() in secrets.PAIRS for a, b in zip(body, body[1:])), share)) if share else 1.0)
    return min(1, 6 * min(ps))


def bodies(rnd):
    out = []
    for _, _, alphabet in secrets.ENCODINGS:
        out += ["".join(rnd.choice(alphabet[: rnd.choice([3, 12, len(alphabet)])]) for _ in range(rnd.randrange(20, 80))) for _ in range(12)]
    return out + [harmless(rnd, n) for n in range(20, 60)]


def test_p_values(spark):
    texts = bodies(random.Random(4))
    df = spark.createDataFrame([(b,) for b in texts], "body string").select("body", secrets._p_value(F.col("body"), secrets._encoding(F.col("body"))).alias("p"))
    for r in df.collect():
        assert abs(r.p - plain_p(r.body, plain_encoding(r.body))) < 1e-9, r.body


def plain_cell(body):
    p = max(1e-300, plain_p(body, plain_encoding(body)))
    return math.floor(math.log2(len(body)) * 4), min(200, math.floor(-math.log10(p) * 20))


def test_the_whole_scan_against_a_plain_one(spark):
    """Spans, cells, made names' shares and the step-up rule in plain Python; only the names' strings come from Spark."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice([*bodies(rnd)[:40], "token = abcdefgh", "plain words", "0a" * 13, harmless(rnd, 25)]) for _ in range(rnd.randrange(4))) for _ in range(80)]
    got = scan(spark, texts)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    seed = F.xxhash64("text")
    cut = F.substring("text", (F.pmod(seed, F.greatest(F.lit(1), F.length("text") - secrets.SNIPPET)) + 1).cast("int"), F.lit(secrets.SNIPPET))
    own = [r.n for r in df.select(secrets.named(F.regexp_extract_all(F.lower(cut), F.lit("[a-z]{2,}"), F.lit(0)), seed).alias("n")).collect() if r.n]
    words = F.array(*map(F.lit, secrets.WORDS))
    picked = spark.range(secrets.NAMES).select("id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: words[F.pmod(F.xxhash64("id", i), F.lit(len(secrets.WORDS))).cast("int")]).alias("w"))
    own += [r.n for r in picked.select(secrets.named(F.col("w"), F.col("id")).alias("n")).collect() if r.n]
    null = {}
    for name in own:
        length, cell = plain_cell(name)
        null.setdefault(length, []).append(cell)
    tests = []
    for i, t in enumerate(texts):
        base = plain(t)
        for m in re.finditer(secrets.CANDIDATE, t):
            at = m.start()
            for a, _, e in [*sorted(x for x in base if x[0] < m.end() and m.start() < x[2]), (m.end(), 0, m.end())]:
                if a - at >= 20:
                    tests.append((i, at, a, *plain_cell(t[at:a]), secrets.KINDS.index(secrets.ENCODINGS[plain_encoding(t[at:a])][0])))
                at = max(at, e)
    limit = {}
    for length in {x[3] for x in tests}:
        cells, like = sorted(x[4] for x in tests if x[3] == length), null[length]
        ps = [(1 + sum(c <= x for c in like)) / (1 + len(like)) for x in cells]
        limit[length] = max((x for k, x in enumerate(cells) if ps[k] * len(cells) <= 0.05 * sum(y <= x for y in cells)), default=-1)
    for i, t in enumerate(texts):
        want = plain(t) + [(s, k, e) for j, s, e, length, cell, k in tests if j == i and cell <= limit[length]]
        assert spans(got[i].found) == sorted(want), t


def test_thresholds_hold_words_against_what_is_reported():
    names = [(17, c, 1) for c in range(100)]
    assert secrets.thresholds([(17, 0, 50), (17, 90, 50)], names, 0.05) == {17: 1}  # 2 of 101 names look so random: 2 of 50 at most
    assert secrets.thresholds([(17, 90, 50)], names, 0.05) == {17: 0} and secrets.thresholds([(17, 3, 1)], names, 0.05) == {17: 4}
    assert secrets.thresholds([(30, 3, 9)], names, 0.05) == {30: 4}  # names of the next shorter class
    assert secrets.thresholds([(17, 0, 5)], [], 0.05) == {17: 0} and secrets.thresholds([], names, 0.05) == {}


def test_many_matches_of_one_text_take_no_square_of_their_number(spark):
    text = "token = abcdefgh " * 30_000
    began = time.perf_counter()
    row = scan(spark, [text])[0]
    assert time.perf_counter() - began < 60 and spans(row.base) == plain(text)


def test_long_text_and_written_form(spark):
    text = ("filler é " * 4000) + ' token = "abcdef0123456789abcdef0123456789" ' + "z " * 100
    row = secrets.scanned(spark.createDataFrame([(1, text, "b", 2)], SCHEMA)).select("*", secrets.written(F.col("base")).alias("w")).first()
    want = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in plain(text))
    assert row.w == want and hashlib.sha256(row.w.encode()).hexdigest()
    assert secrets.scanned(spark.createDataFrame([], SCHEMA)).count() == 0
