"""Column functions against plain restatements."""

import random
import re

from pyspark.sql import functions as F

from proseflow.config import CONTRASTIVES
from proseflow.functions import text


def column(spark, values, f):
    """f of each value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


#: Worked out by hand: text and what is left of it.
NORMAL = [
    ("", ""), ("  a  ", "a"), ("a\n\n\n\nb", "a\n\nb"), ("a \t b", "a b"), ("a\r\nb", "a\nb"), ("a\rb", "a\nb"), ("Case Kept", "Case Kept"), ("a\n \n \nb", "a\n\n\nb"),
    ("a\t\nb", "a\nb"), ("\u3000x\xa0\n\u2003y", "x\ny"), ("a\x0bb", "a\nb"), ("a\u2028b\x85c", "a\nb\nc"), ("a\tb", "a\tb"), ("\x1fa\x1c", "a"), ("a\u200b", "a\u200b"),
]


def test_normalize(spark):
    assert column(spark, [t for t, _ in NORMAL], text.normalize) == [n for _, n in NORMAL]
    rnd = random.Random(1)
    parts = ["a", "Bé", " ", "  ", "\t", "\n", "\r\n", "\r", "\n\n\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\u2028", "\u3000", "\xa0", "\u200b", "."]
    values = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(2000)]
    for before, after in zip(values, column(spark, values, text.normalize), strict=True):
        assert after == after.strip() and all(x == x.strip() for x in after.split("\n")) and "\r" not in after and "  " not in after
        assert "".join(after.split()) == "".join(before.split())  # only white space went


#: Worked out by hand: text and its sentences.
CUT = [
    ("", []), ("One. Two.", ["One.", "Two."]), ("Prices rose but jobs fell.", ["Prices rose", "jobs fell."]), ("However, easing.", [", easing."]), ("No end", ["No end"]),
    ("While costs fell, output grew but jobs did not.", ["While costs fell, output grew", "jobs did not."]), ("a but b but c.", ["a", "b but c."]), ("butter abuts.", ["butter abuts."]),
    ("1.5 is more.  Is it?\nYes! ", ["1.5 is more.", "Is it?", "Yes!"]), ("ALTHOUGH x. BUT", ["x."]), ("a.\u2003b", ["a.", "b"]), ("x while y although z", ["x while y", "z"]),
]


def test_sentences(spark):
    assert column(spark, [t for t, _ in CUT], text.split_sentences) == [c for _, c in CUT]
    rnd = random.Random(2)
    parts = ["But", "but", "however", "ALTHOUGH", "while", "WHILE", "butter", "abut", "x", ".", "!", "? ", " ", "  ", "\n", ",", "é", "1.5", "\u2003", "\x1f"]
    values = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(20))) for _ in range(2000)]
    for before, got in zip(values, column(spark, values, text.split_sentences), strict=True):
        assert all(p and p == p.strip() for p in got) and not any(re.search(r"[.!?]\s+\S", p) for p in got)
        at, left = 0, []  # the parts stand in the text in order; between them is white space and at most one contrastive word
        for p in got:
            found = before.index(p, at)
            left.append(before[at:found])
            at = found + len(p)
        assert all("".join(x.split()).lower() in ("", *CONTRASTIVES) or len("".join(x.split())) <= 2 * max(map(len, CONTRASTIVES)) for x in [*left, before[at:]])


#: Worked out by hand: tokens of paragraphs, and first and last paragraph of each chunk with its tokens.
CHUNKS = [
    ([], []), ([50] * 4, [(0, 3, 200), (2, 3, 100)]), ([900], [(0, 0, 900)]), ([30, 399, 10], [(0, 0, 30), (1, 1, 399), (2, 2, 10)]), ([100, 300, 1], [(0, 1, 400), (1, 2, 301), (2, 2, 1)]),
    ([99, 1, 400], [(0, 1, 100), (2, 2, 400)]), ([400, 400], [(0, 0, 400), (1, 1, 400)]), ([60, 60, 60], [(0, 2, 180), (2, 2, 60)]),
]


def test_chunks(spark):
    sized = lambda sizes: "\n\n".join(f"{i:x<{4 * s}}" for i, s in enumerate(sizes))
    want = [[(k, "\n\n".join(sized(sizes).split("\n\n")[a : b + 1]), n) for k, (a, b, n) in enumerate(chunks)] for sizes, chunks in CHUNKS]
    assert [[tuple(c) for c in g] for g in column(spark, [sized(sizes) for sizes, _ in CHUNKS], text.chunks)] == want
    assert column(spark, [None, " \n\n "], text.chunks) == [[], []]
    rnd = random.Random(3)
    many = [[rnd.choice([1, 20, 60, 99, 100, 101, 300, 400, 500]) for _ in range(rnd.randrange(1, 15))] for _ in range(500)]
    for sizes, got in zip(many, column(spark, [sized(s) for s in many], text.chunks), strict=True):
        spans = [(int(re.match(r"\d+", c.chunk_text)[0]), c.chunk_text.count("\n\n") + 1, c.token_est) for c in got]
        assert [c.chunk_index for c in got] == list(range(len(got))) and spans[0][0] == 0 and sum(spans[-1][:2]) == len(sizes)
        for a, n, tokens in spans:
            assert tokens == sum(sizes[a : a + n]) and (tokens <= 400 or n == 1) and (a + n == len(sizes) or tokens + sizes[a + n] > 400)
        for (a, n, _), (b, *_) in zip(spans, spans[1:]):
            gone = sum(sizes[a:b])
            assert a < b <= a + n and (gone >= 100 or b == a + n) and gone - sizes[b - 1] < 100


def test_trim_and_bodies(spark):
    assert column(spark, ["a Endnotes b Footnotes", "none", "", None, "References"], text.trim_at) == ["a ", "none", "", None, ""]
    s = "Return to top"
    values = ["no", f"a {s} b", f"a {s} b {s}  body \n", f"{s}{s} x References y Footnotes", f"Footnotes {s} {s} z"]
    assert column(spark, values, text.old_layout_body) == [None, None, "body", "x", "z"]
    by_year = lambda c: text.old_layout_body_by_year(c, F.lit("1999"))
    values = ["1999 a 1999 b", "1999 a 1999 b\n\n\nc Footnotes d References", "1999 1999 x References y Footnotes", "1999 1999 q Endnotes 1999 Speeches"]
    assert column(spark, values, by_year) == [None, "b\nc", "x References y", "q Endnotes"]


def test_cleaning(spark):
    assert column(spark, [" Watch live a\n\n\nReturn to text b\n"], text.clean_speech) == ["a\n b"]
    assert column(spark, [" Watch live a\n\n\n\nReturn to text b\n\nc "], text.clean_document) == ["Watch live a\n\n b\n\nc"]


def test_words(spark):
    assert column(spark, [None, "", "  a\tb\n c ", " x"], text.word_count) == [None, 0, 3, 1]
    assert column(spark, ["Can't a1_b É x"], text.terms) == [["can", "a1_b"]]
    assert column(spark, ["The End, of 2 Days: ÉTÉ!"], lambda c: text.preprocess(c, ["the", "of"])) == ["end days été"]
    assert column(spark, ["", "abcd" * 3, "abc"], text.tokens_of) == [1, 3, 1]
