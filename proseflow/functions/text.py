"""Text as column expressions: whitespace, sentences, clauses, bodies of pages, words."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseflow.config import CONTRASTIVES, DOCUMENT_NOISE, END_KEYWORDS, SENTINEL, SPEECH_NOISE

#: White space as Python strips it: Unicode's, and the four information separators; for sets of characters and for patterns.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def normalize(text: Column) -> Column:
    """Line ends to LF, three LF or more to two, blanks to one, every line and the whole stripped; in that order.

    Lines are stripped after blank lines are collapsed, so lines of blanks can leave three LF in a row.
    """
    steps = ((r"\r\n?", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"[\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", "\n"))
    lines = F.split(reduce(lambda t, s: F.regexp_replace(t, *s), steps, text), "\n", -1)
    return strip(F.array_join(F.transform(lines, strip), "\n"))


def _stripped(parts: Column) -> Column:
    return F.array_remove(F.transform(parts, strip), "")


def split_sentences(text: Column, contrastives: Sequence[str] = CONTRASTIVES) -> Column:
    """Sentences, each cut once at the first listed contrastive word it holds; the word goes, empty parts go."""
    sentences = _stripped(F.split(text, rf"(?<=[.!?])[{_SPACE}]+", -1))

    def clauses(s):
        out = F.when(F.lit(False), F.array(s))
        for word in contrastives:
            at = rf"(?iU)\b{word}\b"
            # Most sentences are told by a plain search; where letters outside ASCII may fold to the word's, the pattern says.
            perhaps = F.contains(F.lower(s), F.lit(word.lower())) | (F.octet_length(s) != F.length(s))
            out = out.when(perhaps & s.rlike(at), F.split(s, at, 2))
        return out.otherwise(F.array(s))

    return _stripped(F.flatten(F.transform(sentences, clauses)))


def holds_any(text: Column, phrases: Sequence[str]) -> Column:
    """Whether the lower-case text holds a phrase, as a substring."""
    return holds_any_lower(F.lower(text), phrases)


def holds_any_lower(low: Column, phrases: Sequence[str]) -> Column:
    """The same for a text in lower case already."""
    return reduce(lambda a, p: a | F.contains(low, F.lit(p)), phrases, F.lit(False))


def _without(text: Column, phrases: Sequence[str]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p), F.lit("")), phrases, text)


def clean_speech(text: Column, noise: Sequence[str] = SPEECH_NOISE) -> Column:
    """Noise phrases go, runs of LF become one, ends are stripped."""
    return strip(F.regexp_replace(_without(text, noise), r"\n{2,}", "\n"))


def clean_document(text: Column, noise: Sequence[str] = DOCUMENT_NOISE) -> Column:
    """Noise phrases go, runs of three LF or more become two, ends are stripped."""
    return strip(F.regexp_replace(_without(text, noise), r"\n{3,}", "\n\n"))


def _found(phrase: str | Column, text: Column, start: Column | int = 1) -> Column:
    """Place of the phrase from start on, counted from 1; null where it isn't there."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.nullif(F.call_function("locate", phrase, text, F.lit(start) if isinstance(start, int) else start), F.lit(0))


def trim_at(text: Column, keywords: Sequence[str] = END_KEYWORDS) -> Column:
    """The text before the earliest keyword."""
    ends = [F.coalesce(_found(k, text), F.length(text) + 1) for k in keywords]
    return F.substring(text, F.lit(1), F.least(*ends) - 1)


def _after_second(text: Column, sentinel: Column | str) -> Column:
    width = F.length(F.lit(sentinel) if isinstance(sentinel, str) else sentinel)
    return _found(sentinel, text, _found(sentinel, text) + width) + width


def old_layout_body(text: Column, sentinel: str = SENTINEL, keywords: Sequence[str] = END_KEYWORDS) -> Column:
    """Stripped text from the second sentinel to the earliest keyword after it; null without a second sentinel."""
    start = _after_second(text, sentinel)
    end = F.least(*(F.coalesce(_found(k, text, start), F.length(text) + 1) for k in keywords))
    return strip(F.substring(text, start, end - start))


def old_layout_body_by_year(text: Column, year: Column, keywords: Sequence[str] = END_KEYWORDS) -> Column:
    """The same with the year as sentinel and the first listed keyword that occurs as the end; null without either.

    Ends in "<year> Speeches" come first; runs of LF become one, then noise phrases go.
    """
    start = _after_second(text, year)
    end = F.coalesce(*(_found(k, text, start) for k in (F.concat(year, F.lit(" Speeches")), *keywords)))
    return _without(F.regexp_replace(strip(F.substring(text, start, end - start)), r"\n+", "\n"), SPEECH_NOISE)


def words(text: Column) -> Column:
    """Pieces between white space; null stays null."""
    return F.array_remove(F.split(text, rf"[{_SPACE}]+", -1), "")


def word_count(text: Column) -> Column:
    return F.when(text.isNotNull(), F.size(words(text)))


def terms(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def preprocess(text: Column, stop_words: Sequence[str]) -> Column:
    """Lower case, letters and white space only, stop words out, single spaces."""
    kept = words(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\s]", ""))
    return F.array_join(F.filter(kept, lambda w: ~w.isin(list(stop_words))), " ")


def tokens_of(text: Column, chars_per_token: int = 4) -> Column:
    """Estimated tokens: a quarter of the code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / chars_per_token).cast("int"))


def chunks(text: Column, max_tokens: int = 400, advance: int = 100, chars_per_token: int = 4, separator: str = "\n\n") -> Column:
    """Overlapping chunks of whole paragraphs: array of (chunk_index, chunk_text, token_est); empty without paragraphs.

    A chunk takes paragraphs while they fit into max_tokens, the first always. The next starts where advance tokens are
    passed, or where this one ended if that comes first. One fold finds the starts; each chunk is then cut by itself.
    """
    paragraphs = _stripped(F.split(text, separator, -1))

    def let(value, use):
        return F.transform(F.array(value), use)[0]

    def cut(ps, sizes):
        def step(acc, j):
            here = (j == 0) | (acc["acc"] >= advance) | (acc["acc"] + sizes[j] > max_tokens)
            return F.struct(
                F.when(here, F.concat(acc["starts"], F.array(j))).otherwise(acc["starts"]).alias("starts"),
                F.when(here, sizes[j]).otherwise(acc["acc"] + sizes[j]).alias("acc"))

        def one(s, k):
            def grow(acc, p):
                more = ~acc["full"] & ((acc["n"] == 0) | (acc["t"] + p <= max_tokens))
                return F.struct((acc["n"] + more.cast("int")).alias("n"), F.when(more, acc["t"] + p).otherwise(acc["t"]).alias("t"), (~more).alias("full"))

            none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("t"), F.lit(False).alias("full"))
            # A paragraph has a token at least, so no more than max_tokens of them fit.
            got = F.aggregate(F.slice(sizes, s + 1, max_tokens + 1), none, grow)
            return let(got, lambda g: F.struct(k.alias("chunk_index"), F.array_join(F.slice(ps, s + 1, g["n"]), separator).alias("chunk_text"), g["t"].alias("token_est")))

        begin = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("acc"))
        starts = F.aggregate(F.sequence(F.lit(0), F.size(ps) - 1), begin, step, lambda acc: acc["starts"])
        return let(starts, lambda ss: F.transform(ss, one))

    none = F.array().cast("array<struct<chunk_index:int,chunk_text:string,token_est:int>>")
    return F.coalesce(let(paragraphs, lambda ps: F.when(F.size(ps) > 0, let(F.transform(ps, lambda p: tokens_of(p, chars_per_token)), lambda sizes: cut(ps, sizes)))), none)
