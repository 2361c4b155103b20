"""Every operator as a query over the driver's tables, next to the SQL it is held against.

The tables have neither dates nor speakers nor the site's markup; each query says how it adapts them. Documents get
their language as source type and a weekly date from their id, eight documents to a week: series, equal dates and
predecessors occur, and dates grow in number with the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseflow.config import CONTRASTIVES, DOVISH_CUES, ECONOMIC_PHRASES, HAWKISH_CUES
from proseflow.functions import names, text
from proseflow.operators import chunks, eda, merge, novelty, quality, queues, retrieval, sentiment
from proseflow.plans import catalog, features, fixtures
from proseflow.sources import feeds, pages, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Words of the invented languages that stand for phrases, conjunctions, cues and stop words.
PHRASES = ("rewh", "thatin", "ononst", "inoran")
SPLITTERS = ("with", "from")
UP, DOWN = ("rewh", "ononst"), ("thatin",)
STOP = ("the", "of", "and", "to", "in", "la", "de", "le", "und", "die", "der", "el")
BASE_URL = "https://www.example.org"
CANONICAL = {"Chairman Bernanke": "Chairman Ben S. Bernanke"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ------------------------------------------------------------------ adapters

def _date():
    return F.date_add(F.lit("2000-01-01").cast("date"), F.expr("CAST(doc_id DIV 8 * 7 AS INT)"))


_DATE = "(DATE '2000-01-01' + (doc_id // 8 * 7)::INTEGER)"


def records(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "documents").select("doc_id", F.col("lang").alias("source_type"), _date().alias("date"), "text")


RECORDS = f"(SELECT doc_id, lang AS source_type, {_DATE} AS date, text FROM documents)"


def speeches(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return tables.read(spark, d, "documents").select(
        i.alias("id"), F.when(i % 17 != 0, _date()).alias("speech_date"), F.substring("text", 1, 20).alias("title"), F.when(i % 13 == 0, F.lit("  ")).otherwise(F.col("source")).alias("speaker"), F.col("lang").alias("event"),
        F.when(i % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("/s/"), i.cast("string"))).alias("link"), F.when(i % 7 == 1, F.lit("   ")).when(i % 7 != 0, F.col("text")).alias("speech_text"), (i % 3 == 0).alias("processed"))


SPEECHES = f"""(SELECT doc_id AS id, CASE WHEN doc_id % 17 <> 0 THEN {_DATE} END AS speech_date, substr(text, 1, 20) AS title, CASE WHEN doc_id % 13 = 0 THEN '  ' ELSE source END AS speaker, lang AS event,
 CASE WHEN doc_id % 11 = 0 THEN '' ELSE '/s/' || doc_id END AS link, CASE WHEN doc_id % 7 = 1 THEN '   ' WHEN doc_id % 7 <> 0 THEN text END AS speech_text, doc_id % 3 = 0 AS processed FROM documents)"""


def page_catalog(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    return tables.read(spark, d, "pages").select(
        i.alias("id"), F.concat(F.lit("St_"), i.cast("string")).alias("doc_id"), F.when(i % 3 == 0, "St").when(i % 3 == 1, "Mn").otherwise("PrC").alias("category"),
        F.when(i % 19 != 0, F.date_add(F.lit("2010-01-01").cast("date"), (i % 1000).cast("int"))).alias("meeting_date"), F.when(i % 5 != 0, F.col("url")).alias("html_url"), F.when(i % 10 != 0, F.concat("url", F.lit(".pdf"))).alias("pdf_url"),
        F.when(i % 6 == 1, F.lit(" ")).when(i % 6 != 0, F.col("html")).alias("doc_text"), (i % 3 != 0).alias("fetched"), (i % 3 == 2).alias("parsed"), F.when(i % 4 != 0, F.col("html")).alias("raw_html"))


PAGES = """(SELECT page_id AS id, 'St_' || page_id AS doc_id, CASE page_id % 3 WHEN 0 THEN 'St' WHEN 1 THEN 'Mn' ELSE 'PrC' END AS category,
 CASE WHEN page_id % 19 <> 0 THEN DATE '2010-01-01' + (page_id % 1000)::INTEGER END AS meeting_date, CASE WHEN page_id % 5 <> 0 THEN url END AS html_url, CASE WHEN page_id % 10 <> 0 THEN url || '.pdf' END AS pdf_url,
 CASE WHEN page_id % 6 = 1 THEN ' ' WHEN page_id % 6 <> 0 THEN html END AS doc_text, page_id % 3 <> 0 AS fetched, page_id % 3 = 2 AS parsed, CASE WHEN page_id % 4 <> 0 THEN html END AS raw_html FROM pages)"""


# ------------------------------------------------------------------ SQL for text

def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_normalize(x: str) -> str:
    for rx, by in ((r"\r\n?", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (r"[ \t]{2,}", "' '"), (r"[ \t]*\n[ \t]*", "chr(10)")):
        x = f"regexp_replace({x}, '{rx}', {by}, 'g')"
    return sql_strip(x)


def sql_sentences(x: str, splitters) -> str:
    """A list of sentences, cut at the first listed conjunction."""
    raw = rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {sql_strip('s')}), lambda s: s <> '')"
    case = " ".join(rf"WHEN regexp_matches(s, '(?i)\b{w}\b') THEN string_split(regexp_replace(s, '(?i)\b{w}\b', chr(2)), chr(2))" for w in splitters)
    return f"list_filter(list_transform(flatten(list_transform({raw}, lambda s: CASE {case} ELSE [s] END)), lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{p}')" for p in phrases) + ")"


NOISY = "replace(replace(text, chr(10), ' ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10)), ' ', '  ')"


def noisy(c):
    return F.replace(F.replace(c, F.lit("\n"), F.lit(" \r\n\r\n\r\n")), F.lit(" "), F.lit("  "))


# ------------------------------------------------------------------ scans and set operations

@query(f"SELECT id AS doc_id, 'speech' AS source_type, speech_date AS date, speech_text AS text FROM {SPEECHES} WHERE speech_text IS NOT NULL AND speech_text <> ''")
def load_speeches(spark, d):
    return tables.speech_records(speeches(spark, d))


@query(f"SELECT id AS doc_id, 'document' AS source_type, meeting_date AS date, doc_text AS text FROM {PAGES} WHERE parsed AND doc_text IS NOT NULL AND doc_text <> ''")
def load_documents(spark, d):
    return tables.document_records(page_catalog(spark, d))


@query(f"""SELECT id AS doc_id, 'speech' AS source_type, speech_date AS date, speech_text AS text FROM {SPEECHES} WHERE speech_text IS NOT NULL AND speech_text <> ''
UNION ALL SELECT id, 'document', meeting_date, doc_text FROM {PAGES} WHERE parsed AND doc_text IS NOT NULL AND doc_text <> ''""")
def union_sources(spark, d):
    return tables.attached(tables.speech_records(speeches(spark, d)), tables.document_records(page_catalog(spark, d)))


@query(f"SELECT id AS doc_id, speech_date AS date, speech_text AS text FROM {SPEECHES} WHERE speech_text IS NOT NULL AND speech_text <> '' ORDER BY speech_date NULLS FIRST, id LIMIT 100")
def load_first_speeches(spark, d):
    return tables.speech_records(speeches(spark, d), limit=100).select("doc_id", "date", "text")


# ------------------------------------------------------------------ text

@query(f"SELECT doc_id, {sql_normalize(NOISY)} AS text FROM documents")
def normalize_text(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", text.normalize(noisy(F.col("text"))).alias("text"))


def _sentence_sql(tail: str = "", more: str = "") -> str:
    s = f"SELECT doc_id, {sql_sentences(sql_normalize('text'), SPLITTERS)} AS l FROM documents UNION ALL SELECT doc_id, {sql_sentences(sql_normalize('text'), CONTRASTIVES)} FROM {fixtures.SENTENCES.sql()}"
    return f"SELECT * FROM (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS sentence FROM ({s})){tail}{more}"


def _with_fixture(spark, d, f: Callable[..., DataFrame], ours: dict, default: dict) -> DataFrame:
    return f(tables.read(spark, d, "documents"), **ours).unionByName(f(fixtures.SENTENCES.frame(spark), **default))


@query(_sentence_sql())
def split_sentences(spark, d):
    return _with_fixture(spark, d, lambda df, **how: sentiment.sentences(df, ["doc_id"], **how), {"contrastives": SPLITTERS}, {})


_TARGETS = _sentence_sql(f" WHERE length(sentence) > 10 AND (doc_id >= 0 AND {sql_any('sentence', PHRASES)} OR doc_id < 0 AND {sql_any('sentence', ECONOMIC_PHRASES)})")


@query(_TARGETS)
def economic_sentences(spark, d):
    return _with_fixture(spark, d, lambda df, **how: sentiment.economic_sentences(df, ["doc_id"], **how), {"contrastives": SPLITTERS, "phrases": PHRASES}, {})


def _label_sql() -> str:
    up = f"CASE WHEN doc_id >= 0 THEN {sql_any('sentence', UP)} ELSE {sql_any('sentence', HAWKISH_CUES)} END"
    down = f"CASE WHEN doc_id >= 0 THEN {sql_any('sentence', DOWN)} ELSE {sql_any('sentence', DOVISH_CUES)} END"
    return f"SELECT doc_id, CASE WHEN up AND NOT down THEN 1 WHEN down AND NOT up THEN -1 ELSE 0 END AS l FROM (SELECT doc_id, {up} AS up, {down} AS down FROM ({_TARGETS}))"


def _tone_sql(docs: str) -> str:
    return f"""SELECT d.*, CASE WHEN count(l) > 0 THEN sum(l)::DOUBLE / count(l) ELSE 0.0::DOUBLE END AS hawkish_score, count(*) FILTER (WHERE l = 1) AS n_hawkish, count(*) FILTER (WHERE l = -1) AS n_dovish,
 count(*) FILTER (WHERE l = 0) AS n_neutral, count(l) AS n_target_sentences FROM ({docs}) d LEFT JOIN ({_label_sql()}) USING (doc_id) GROUP BY ALL"""


def _our_label(s):
    return sentiment.lexicon_label(s, UP, DOWN)


OURS = {"contrastives": SPLITTERS, "phrases": PHRASES, "label": _our_label}


@query(_tone_sql(f"SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM {fixtures.SENTENCES.sql()}"))
def sentiment_features(spark, d):
    return _with_fixture(spark, d, lambda df, **how: sentiment.scored(df, ["doc_id"], **how), OURS, {})


@query("""SELECT doc_id, chunk_index::INTEGER AS chunk_index, chunk_text, token_est::INTEGER AS token_est FROM (
WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents),
t AS (SELECT doc_id, ps, list_transform(ps, lambda x: greatest(1, length(x) // 4)) AS ts FROM p WHERE len(ps) > 0),
c(doc_id, k, s, e, nxt) AS (
 SELECT doc_id, 0, 1, coalesce(list_min(list_filter(range(2, len(ts) + 1), lambda i: list_sum(ts[1:i]) > 400)), len(ts) + 1), coalesce(list_min(list_filter(range(2, len(ts) + 1), lambda i: list_sum(ts[1:i - 1]) >= 100)), len(ts) + 1) FROM t
 UNION ALL
 SELECT c.doc_id, k + 1, n.s, coalesce(list_min(list_filter(range(n.s + 1, len(ts) + 1), lambda i: list_sum(ts[n.s:i]) > 400)), len(ts) + 1), coalesce(list_min(list_filter(range(n.s + 1, len(ts) + 1), lambda i: list_sum(ts[n.s:i - 1]) >= 100)), len(ts) + 1)
 FROM c JOIN t USING (doc_id), LATERAL (SELECT least(c.e, c.nxt) AS s) n WHERE n.s <= len(ts))
SELECT c.doc_id, k AS chunk_index, array_to_string(ps[s:e - 1], chr(10) || chr(10)) AS chunk_text, list_sum(ts[s:e - 1]) AS token_est FROM c JOIN t USING (doc_id))""")
def chunk_documents(spark, d):
    docs = tables.read(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunks.chunked(docs, ["doc_id"])


@query("""SELECT source_id, source_type, doc_id, chunk_index, chunk_text, token_est FROM (
SELECT doc_id AS source_id, 'document' AS source_type, doc_id::VARCHAR AS doc_id, i::INTEGER AS chunk_index, 'old ' || i AS chunk_text, 1 AS token_est FROM documents, range(0, 3) r(i) WHERE doc_id % 2 <> 0
UNION ALL SELECT doc_id, 'document', doc_id::VARCHAR, 0, regexp_replace(text, '^\\s+|\\s+$', '', 'g'), greatest(1, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) // 4)::INTEGER FROM documents WHERE doc_id % 2 = 0)""")
def chunk_upsert(spark, d):
    docs = tables.read(spark, d, "documents")
    same = [F.col("doc_id").alias("source_id"), F.lit("document").alias("source_type"), F.col("doc_id").cast("string").alias("doc_id")]
    old = docs.select(*same, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("chunk_index"))
    old = old.select("source_id", "source_type", "doc_id", "chunk_index", F.concat(F.lit("old "), F.col("chunk_index").cast("string")).alias("chunk_text"), F.lit(1).alias("token_est"))
    new = docs.select(*same, F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("text"))
    return chunks.upserted(old, new)


# ------------------------------------------------------------------ novelty and the flagship

_LONGEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_type, date ORDER BY length(text) DESC, doc_id) AS rn FROM {RECORDS}) WHERE rn = 1)"


@query(f"SELECT doc_id, source_type, date, length(text)::INTEGER AS n FROM {_LONGEST}")
def dedup_longest(spark, d):
    return novelty.dedup_longest(records(spark, d), ["source_type", "date"], ["doc_id"]).select("doc_id", "source_type", "date", F.length("text").alias("n"))


def _weights_sql(docs: str, series: str, doc: str, top: int) -> str:
    return f"""tok AS (SELECT {series} AS series, {doc} AS doc, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {docs}),
tf AS (SELECT series, doc, term, count(*) AS tf FROM tok WHERE term NOT IN ({quoted(STOP)}) GROUP BY ALL),
voc AS (SELECT * FROM (SELECT series, term, count(*) AS df, row_number() OVER (PARTITION BY series ORDER BY sum(tf) DESC, term) AS rn FROM tf GROUP BY series, term) WHERE rn <= {top}),
n AS (SELECT {series} AS series, count(*) AS n FROM {docs} GROUP BY ALL),
x AS (SELECT series, doc, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN voc USING (series, term) JOIN n USING (series)),
w AS (SELECT series, doc, term, x / sqrt(sum(x * x) OVER (PARTITION BY series, doc)) AS w FROM x)"""


def _novelty_sql(top: int) -> str:
    return f"""WITH one AS {_LONGEST}, {_weights_sql('one', 'source_type', 'date', top)},
b AS (SELECT source_type, date, lag(date) OVER (PARTITION BY source_type ORDER BY date) AS prev FROM one),
s AS (SELECT b.source_type, b.date, sum(w1.w * w0.w) AS sim FROM b JOIN w w1 ON w1.series = b.source_type AND w1.doc = b.date JOIN w w0 ON w0.series = b.source_type AND w0.doc = b.prev AND w0.term = w1.term GROUP BY ALL),
v AS (SELECT b.source_type, b.date, CASE WHEN prev IS NULL THEN 1.0 ELSE 1 - least(1, greatest(0, coalesce(sim, 0))) END AS novelty FROM b LEFT JOIN s USING (source_type, date))
SELECT r.source_type, r.date, r.doc_id, round(v.novelty, 6) AS novelty FROM {RECORDS} r JOIN v USING (source_type, date)"""


@query(_novelty_sql(10_000))
def novelty_by_type(spark, d):
    return novelty.novelty(records(spark, d), stop_words=STOP).withColumn("novelty", F.round("novelty", 6))


@query(f"""WITH one AS {_LONGEST},
tok AS (SELECT source_type, date, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM one),
tf AS (SELECT source_type, date, term, count(*) AS tf FROM tok WHERE term NOT IN ({quoted(STOP)}) GROUP BY ALL),
b AS (SELECT source_type, date, lag(date) OVER s AS prev, row_number() OVER s AS n FROM one WINDOW s AS (PARTITION BY source_type ORDER BY date)),
x AS (SELECT b.source_type, b.date AS d, b.n, tf.term, sum(tf) FILTER (WHERE tf.date = b.date) AS now, sum(tf) FILTER (WHERE tf.date = b.prev) AS old FROM b JOIN tf ON tf.source_type = b.source_type AND tf.date IN (b.date, b.prev) WHERE b.prev IS NOT NULL GROUP BY ALL),
i AS (SELECT x.source_type, x.d, x.term, now, old, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM x JOIN tf f ON f.source_type = x.source_type AND f.term = x.term AND f.date <= x.d GROUP BY x.source_type, x.d, x.n, x.term, now, old),
s AS (SELECT source_type, d AS date, sum(coalesce(now, 0) * coalesce(old, 0) * idf * idf) / sqrt(sum(coalesce(now, 0) ** 2 * idf * idf) * sum(coalesce(old, 0) ** 2 * idf * idf)) AS sim FROM i GROUP BY ALL)
SELECT r.source_type, r.date, r.doc_id, round(CASE WHEN b.prev IS NULL THEN 1.0 ELSE 1 - least(1, greatest(0, coalesce(sim, 0))) END, 6) AS novelty FROM {RECORDS} r JOIN b USING (source_type, date) LEFT JOIN s USING (source_type, date)""")
def novelty_so_far(spark, d):
    return novelty.novelty(records(spark, d), stop_words=STOP, so_far=True).withColumn("novelty", F.round("novelty", 6))


@query(f"WITH {_weights_sql('documents', '1', 'doc_id', 1000)} SELECT term, round(sum(w), 6) AS score FROM w GROUP BY term ORDER BY sum(w) DESC, term LIMIT 20")
def tfidf_top_terms(spark, d):
    return novelty.top_terms(tables.read(spark, d, "documents"), ["doc_id"], stop_words=STOP).withColumn("score", F.round("score", 6))


@query(f"SELECT t.doc_id, t.source_type, t.date, hawkish_score, n_hawkish, n_dovish, n_neutral, n_target_sentences, novelty FROM ({_tone_sql(f'SELECT doc_id, source_type, date FROM {RECORDS}')}) t JOIN ({_novelty_sql(10_000)}) v USING (doc_id)")
def doc_features(spark, d):
    found = features.features(records(spark, d), novelty_how={"stop_words": STOP}, **OURS)
    return found.withColumn("novelty", F.round("novelty", 6))


@query(f"""WITH f AS (SELECT doc_id, date FROM {RECORDS}), t AS (SELECT o_orderdate::DATE AS date, max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT f.doc_id, f.date, t.value AS rate FROM f ASOF LEFT JOIN t ON f.date > t.date""")
def features_with_targets(spark, d):
    targets = tables.read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.lit("rate").alias("series"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("value"))
    return features.attach_targets(records(spark, d).select("doc_id", "date"), targets, "rate").select("doc_id", "date", "rate")


# ------------------------------------------------------------------ feeds, listings, queues and writes

_FEED = f"SELECT feed, ord, type || '_' || replace(coalesce(nullif(dt, ''), d, 'unknown'), '-', '') AS doc_id, type AS category, d::DATE AS meeting_date, coalesce(nullif(dt, ''), d)::DATE AS pub_date, coalesce(mtg, '') AS meeting_label, '{BASE_URL}' || html AS html_url, '{BASE_URL}' || pdf AS pdf_url FROM {fixtures.FEED_ITEMS.sql()} WHERE type IN ('St', 'Mn')"
_FEED = f"SELECT * EXCLUDE (feed, ord, rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY feed, ord) AS rn FROM ({_FEED})) WHERE rn = 1"


@query(_FEED)
def feed_discovery(spark, d):
    return feeds.documents(fixtures.FEEDS.frame(spark), BASE_URL)


@query(f"SELECT category, count(*) AS n FROM ({_FEED}) WHERE category IN ('St', 'Mn') GROUP BY category")
def category_count(spark, d):
    return eda.sizes(feeds.documents(fixtures.FEEDS.frame(spark), BASE_URL).where(F.col("category").isin("St", "Mn")), "category")


@query("""WITH old AS (SELECT doc_id, 'old' AS source FROM documents WHERE doc_id % 3 = 0), new AS (SELECT doc_id // 2 AS doc_id, min_by(source, doc_id) AS source FROM documents GROUP BY 1)
SELECT * FROM old UNION ALL SELECT doc_id, source FROM new WHERE doc_id NOT IN (SELECT doc_id FROM old)""")
def insert_or_ignore_documents(spark, d):
    docs = tables.read(spark, d, "documents")
    old = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("old").alias("source"))
    new = docs.select(F.expr("doc_id DIV 2").alias("doc_id"), "source", F.col("doc_id").alias("arrival"))
    return merge.insert_or_ignore(old, new, ["doc_id"], ["arrival"])


@query(f"""WITH old AS (SELECT id, link FROM {SPEECHES} WHERE processed AND link <> ''), new AS (SELECT min(id) AS id, link FROM {SPEECHES} GROUP BY link)
SELECT id, link FROM old UNION ALL SELECT id, link FROM new WHERE link NOT IN (SELECT link FROM old)""")
def insert_or_ignore_speeches(spark, d):
    s = speeches(spark, d).select("id", "link", "processed")
    return merge.insert_or_ignore(s.where("processed AND link <> ''").select("id", "link"), s.select("id", "link"), ["link"], ["id"])


@query(f"SELECT id, doc_id, html_url, meeting_date FROM {PAGES} WHERE NOT fetched AND html_url IS NOT NULL")
def fetch_queue(spark, d):
    return queues.fetch_queue(page_catalog(spark, d))


@query(f"SELECT id, doc_id, category, raw_html FROM {PAGES} WHERE fetched AND NOT parsed AND raw_html IS NOT NULL")
def parse_queue(spark, d):
    return queues.parse_queue(page_catalog(spark, d))


@query(f"SELECT id, link, speech_date FROM {SPEECHES} WHERE NOT processed")
def speech_queue(spark, d):
    return queues.speech_queue(speeches(spark, d))


@query(f"SELECT id, CASE WHEN NOT fetched AND html_url IS NOT NULL AND id % 2 = 0 THEN 'page ' || id ELSE raw_html END AS raw_html, fetched OR (html_url IS NOT NULL AND id % 2 = 0) AS fetched FROM {PAGES}")
def apply_fetch_updates(spark, d):
    cat = page_catalog(spark, d)
    got = queues.fetch_queue(cat).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("page "), F.col("id").cast("string"))).alias("raw_html"))
    return queues.apply_fetch(cat, got).select("id", "raw_html", "fetched")


@query(f"SELECT id, CASE WHEN q THEN 'text ' || id ELSE doc_text END AS doc_text, parsed OR q AS parsed FROM (SELECT *, fetched AND NOT parsed AND raw_html IS NOT NULL AND id % 5 <> 1 AS q FROM {PAGES})")
def apply_parse_updates(spark, d):
    cat = page_catalog(spark, d)
    got = queues.parse_queue(cat).select("id", F.when(F.col("id") % 5 != 1, F.concat(F.lit("text "), F.col("id").cast("string"))).otherwise("").alias("doc_text"))
    return queues.apply_parse(cat, got).select("id", "doc_text", "parsed")


def _sql_article() -> str:
    """Text of the article by patterns, which the pages at hand allow: no article in another, entities of a few kinds."""
    x = r"regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)"
    for rx in ("(?s)<(script|style)[^>]*>.*?</(script|style)>", "(?s)<!--.*?-->", "<[^>]*>"):
        x = f"regexp_replace({x}, '{rx}', '', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


@query(f"SELECT page_id, {_sql_article()} AS text FROM pages")
def html_article_text(spark, d):
    return tables.read(spark, d, "pages").select("page_id", pages.as_column(pages.article_text)(F.col("html")).alias("text"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>'))::INTEGER AS paragraphs FROM pages")
def html_titles(spark, d):
    return tables.read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"))


@query(f"""SELECT entry, p[1] AS title, p[s] AS speaker, coalesce(p[s + 1], '') AS event FROM (SELECT entry, p, CASE WHEN p[2] IN ('Watch Live', 'Video') THEN 3 ELSE 2 END AS s FROM
(SELECT entry, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM {fixtures.LISTING.sql()})) WHERE len(p) >= s""")
def listing_events(spark, d):
    return fixtures.LISTING.frame(spark).select("entry", names.event_parts(F.col("text")).alias("e")).where("e IS NOT NULL").select("entry", "e.*")


@query(f"SELECT y::INTEGER AS year, '{BASE_URL}/newsevents/speech/' || y || CASE WHEN y <= 2010 THEN 'speech.htm' ELSE '-speeches.htm' END AS url FROM range(1996, 2026) r(y)")
def listing_url(spark, d):
    return spark.range(1996, 2026).select(F.col("id").cast("int").alias("year")).select("year", names.listing_url(BASE_URL, F.col("year")).alias("url"))


@query(f"""SELECT link, CASE WHEN x = '' THEN make_date(year, 1, 1) ELSE try_strptime(x, '%Y%m%d')::DATE END AS date, x <> '' AND try_strptime(x, '%Y%m%d') IS NULL AS date_error
FROM (SELECT link, year, regexp_extract(link, '[0-9]{{8}}') AS x FROM {fixtures.LINKS.sql()})""")
def date_from_url(spark, d):
    date, error = names.date_of_link(F.col("link"), F.col("year"))
    return fixtures.LINKS.frame(spark).select("link", date.alias("date"), error.alias("date_error"))


# ------------------------------------------------------------------ bodies of pages

_SENTINEL = "Return to top"


def _body(spark, d):
    """Texts with sentinels and end keywords put in, more or fewer of them by id."""
    i, t = F.col("doc_id"), F.col("text")
    lead = F.when(i % 3 == 0, F.lit("")).when(i % 3 == 1, F.lit("x Return to top y ")).otherwise(F.lit("x Return to top y 1999 Return to top 1999 \n\n\n"))
    end = F.when(i % 4 == 0, F.lit("")).when(i % 4 == 1, F.lit(" References a Footnotes b")).when(i % 4 == 2, F.lit(" 1999 Speeches Watch live\n\n\n\nEndnotes")).otherwise(F.lit("\n\nReturn to text Endnotes References"))
    return tables.read(spark, d, "documents").select("doc_id", F.concat(lead, t, end).alias("text"))


_BODY = """(SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'x Return to top y ' ELSE 'x Return to top y 1999 Return to top 1999 ' || chr(10) || chr(10) || chr(10) END || text ||
 CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' References a Footnotes b' WHEN 2 THEN ' 1999 Speeches Watch live' || chr(10) || chr(10) || chr(10) || chr(10) || 'Endnotes' ELSE chr(10) || chr(10) || 'Return to text Endnotes References' END AS text FROM documents)"""


def _at(word: str, start: str = "1") -> str:
    return f"(CASE WHEN strpos(substr(text, {start}), '{word}') > 0 THEN strpos(substr(text, {start}), '{word}') + {start} - 1 END)"


@query(f"SELECT doc_id, substr(text, 1, least({', '.join(f'coalesce({_at(k)}, length(text) + 1)' for k in text.END_KEYWORDS)}) - 1) AS text FROM {_BODY}")
def trim_footnotes(spark, d):
    return _body(spark, d).select("doc_id", text.trim_at(F.col("text")).alias("text"))


def _after(word: str) -> str:
    return f"(SELECT doc_id, text, CASE WHEN strpos(substr(text, a), '{word}') > 0 THEN strpos(substr(text, a), '{word}') + a - 1 + {len(word)} END AS s FROM (SELECT doc_id, text, CASE WHEN strpos(text, '{word}') > 0 THEN strpos(text, '{word}') + {len(word)} END AS a FROM {_BODY}))"


@query(f"SELECT doc_id, {sql_strip('substr(text, s, e - s)')} AS text FROM (SELECT doc_id, text, s, least({', '.join(f'coalesce({_at(k, chr(115))}, length(text) + 1)' for k in text.END_KEYWORDS)}) AS e FROM {_after(_SENTINEL)})")
def old_layout_body(spark, d):
    return _body(spark, d).select("doc_id", text.old_layout_body(F.col("text")).alias("text"))


def _sql_without(x: str, phrases) -> str:
    for p in phrases:
        x = f"replace({x}, '{p}', '')"
    return x


@query(f"""SELECT doc_id, {_sql_without("regexp_replace(" + sql_strip('substr(text, s, e - s)') + r", '\n+', chr(10), 'g')", text.SPEECH_NOISE)} AS text FROM
(SELECT doc_id, text, s, coalesce({', '.join(_at(k, 's') for k in ('1999 Speeches', *text.END_KEYWORDS))}) AS e FROM {_after('1999')})""")
def old_layout_body_nb(spark, d):
    return _body(spark, d).select("doc_id", text.old_layout_body_by_year(F.col("text"), F.lit("1999")).alias("text"))


@query(f"SELECT doc_id, {sql_strip('regexp_replace(' + _sql_without('text', text.SPEECH_NOISE) + r', ' + chr(39) + r'\n{2,}' + chr(39) + ', chr(10), ' + chr(39) + 'g' + chr(39) + ')')} AS text FROM {_BODY}")
def clean_speech(spark, d):
    return _body(spark, d).select("doc_id", text.clean_speech(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {sql_strip('regexp_replace(' + _sql_without('text', text.DOCUMENT_NOISE) + r', ' + chr(39) + r'\n{3,}' + chr(39) + ', chr(10) || chr(10), ' + chr(39) + 'g' + chr(39) + ')')} AS text FROM {_BODY}")
def clean_document(spark, d):
    return _body(spark, d).select("doc_id", text.clean_document(F.col("text")).alias("text"))


# ------------------------------------------------------------------ quality and consolidation

def _checks_sql(table: str, frm: str, checks) -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS severity, '{table}' AS \"table\", '{c}' AS \"check\", count(*) AS count, '{t}' AS detail FROM {frm} WHERE {w} HAVING count(*) > 0" for (s, c, t, _), w in checks)


@query(_checks_sql("documents", PAGES, zip(quality.DOCUMENT_CHECKS, ("meeting_date IS NULL", "html_url IS NULL AND pdf_url IS NULL", "NOT fetched", "fetched AND NOT parsed", "parsed AND (doc_text IS NULL OR trim(doc_text) = '')"), strict=True)))
def completeness_documents(spark, d):
    return quality.check_documents(page_catalog(spark, d))


@query(_checks_sql("speeches", SPEECHES, zip(quality.SPEECH_CHECKS, ("speech_date IS NULL", "link IS NULL OR link = ''", "speech_text IS NULL OR trim(speech_text) = ''", "speaker IS NULL OR trim(speaker) = ''"), strict=True)))
def completeness_speeches(spark, d):
    return quality.check_speeches(speeches(spark, d))


@query("SELECT 'documents' AS \"table\", count(*) AS n_rows FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'chunks', 0")
def table_counts(spark, d):
    return quality.table_counts({"documents": tables.read(spark, d, "documents"), "pages": tables.read(spark, d, "pages"), "chunks": None})


def _two_catalogs(spark, d):
    """Chunks of every document in both catalogs: the second's as documents' own, and late ones of speeches that the first has."""
    docs = tables.read(spark, d, "documents")
    i = F.col("doc_id")
    part = lambda kind, at, t: docs.select(at.alias("id"), F.lit(kind).alias("source_type"), i.alias("source_id"), F.lit(0).alias("chunk_index"), t.alias("chunk_text"))
    second = part("document", 2 * i, F.col("text")).unionByName(part("speech", -i - 1, F.lit("late")))
    return {"speeches": docs.select(i.alias("id"), "source"), "documents": None, "chunks": part("speech", i, F.col("text"))}, {"speeches": None, "documents": docs.select(i.alias("id"), "lang"), "chunks": second}


@query("SELECT doc_id AS id, 'speech' AS source_type, doc_id AS source_id, 0 AS chunk_index, text AS chunk_text FROM documents UNION ALL SELECT 2 * doc_id, 'document', doc_id, 0, text FROM documents")
def consolidate(spark, d):
    return catalog.consolidate(*_two_catalogs(spark, d))["chunks"]


@query("""SELECT doc_id AS id, 'speech' AS source_type FROM documents UNION ALL SELECT 2 * doc_id, 'document' FROM documents WHERE 2 * doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT -doc_id - 1, 'speech' FROM documents""")
def consolidate_legacy_ids(spark, d):
    return catalog.consolidate(*_two_catalogs(spark, d), legacy_id_collision=True)["chunks"].select("id", "source_type")


def _labelled(spark, d):
    docs = tables.read(spark, d, "documents")
    return docs.join(tables.read(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", "source", "quality", "toxic")


_LABELLED = "(SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM {_LABELLED}" for c in ("doc_id", "lang", "source", "quality", "toxic")))
def missing_counts(spark, d):
    return quality.null_counts(_labelled(spark, d))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, count(*) AS n_rows FROM {_LABELLED}" for c, t in (("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("quality", "bigint"), ("toxic", "bigint"))))
def dataset_overview(spark, d):
    return quality.overview(_labelled(spark, d).withColumns({c: F.col(c).cast("long") for c in ("quality", "toxic")}))


@query("SELECT doc_id, lang, source FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def selected_rows(spark, d):
    return tables.read(spark, d, "documents").where(F.col("source").isin("src1", "src2") & (F.col("lang") == "en")).drop("text", "n_chars")


# ------------------------------------------------------------------ exploration

_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_speakers(spark, d):
    return eda.top_values(tables.read(spark, d, "documents"), "source")


def _lengths(spark, d):
    return eda.with_length(tables.read(spark, d, "documents")).select("doc_id", "source", _date().alias("date"), "speech_length")


_LENGTHS = f"(SELECT doc_id, source, {_DATE} AS date, len({_WORDS}) AS n FROM documents)"


@query(f"SELECT year(date)::INTEGER AS year, round(avg(n), 6) AS mean_length FROM {_LENGTHS} GROUP BY 1")
def avg_length_by_year(spark, d):
    return eda.mean_by(_lengths(spark, d), F.year("date"), "speech_length", "year").withColumn("mean_length", F.round("mean_length", 6))


@query(f"SELECT source, round(avg(n), 6) AS mean_length FROM {_LENGTHS} GROUP BY 1 ORDER BY avg(n) DESC, source LIMIT 10")
def avg_length_by_speaker(spark, d):
    return eda.mean_by(_lengths(spark, d), "source", "speech_length", "source", 10).withColumn("mean_length", F.round("mean_length", 6))


@query(f"SELECT count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n)::INTEGER AS min, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, max(n)::INTEGER AS max FROM {_LENGTHS}")
def length_describe(spark, d):
    return eda.describe(_lengths(spark, d), "speech_length").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(f"""WITH e AS (SELECT min(n)::DOUBLE AS a, max(n)::DOUBLE AS b FROM {_LENGTHS}), c AS (SELECT least(floor((n - a) * 30 / (b - a)), 29)::INTEGER AS bin, count(*) AS n FROM {_LENGTHS}, e GROUP BY 1)
SELECT r.bin::INTEGER AS bin, round(a + r.bin * ((b - a) / 30), 6) AS lo, round(a + (r.bin + 1) * ((b - a) / 30), 6) AS hi, coalesce(c.n, 0) AS n FROM range(0, 30) r(bin) CROSS JOIN e LEFT JOIN c ON c.bin = r.bin""")
def length_histogram(spark, d):
    return eda.histogram(_lengths(spark, d), "speech_length").withColumns({c: F.round(c, 6) for c in ("lo", "hi")})


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 20")
def word_count_top20(spark, d):
    return eda.top_words(tables.read(spark, d, "documents"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM documents) WHERE lower(word) NOT IN ({quoted(STOP)}) GROUP BY word ORDER BY n DESC, word LIMIT 20")
def word_count_nostop_top20(spark, d):
    return eda.top_words(tables.read(spark, d, "documents"), stop_words=STOP)


@query(rf"SELECT doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\s]', '', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN ({quoted(STOP)})), ' ') AS processed_text FROM documents")
def preprocess_text(spark, d):
    return tables.read(spark, d, "documents").select("doc_id", text.preprocess(F.col("text"), STOP).alias("processed_text"))


_SWAPPED = f"SELECT id, CASE WHEN starts_with(coalesce(speaker, ''), 'At') THEN event ELSE speaker END AS s, CASE WHEN starts_with(coalesce(speaker, ''), 'At') THEN speaker ELSE event END AS event FROM {fixtures.SPEAKERS.sql()}"
_SWAPPED = f"SELECT id, CASE WHEN contains(s, 'Chairman Bernanke') THEN 'Chairman Ben S. Bernanke' ELSE s END AS s, event FROM ({_SWAPPED})"


@query(f"""SELECT id, trim(replace(trim(replace(trim(replace(trim(replace(s, 'Vice Chair', '')), 'Vice Chairman', '')), 'Chairman', '')), 'Governor', '')) AS speaker, event,
CASE WHEN contains(s, 'Vice Chair') THEN 'Vice Chairman' WHEN contains(s, 'Chairman') THEN 'Chairman' WHEN contains(s, 'Governor') THEN 'Governor' ELSE 'Other' END AS role FROM ({_SWAPPED})""")
def speaker_cleanup(spark, d):
    return eda.cleaned_speakers(fixtures.SPEAKERS.frame(spark), CANONICAL)


def _clusters(spark, d):
    return eda.clusters(tables.read(spark, d, "documents"), "doc_id", STOP)


@query()
def kmeans_clusters(spark, d):
    return _clusters(spark, d)


@query()
def cluster_sizes(spark, d):
    return eda.sizes(_clusters(spark, d), "cluster")


@query()
def cluster_samples(spark, d):
    return eda.first_of_each(_clusters(spark, d), "cluster", ["doc_id"])


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
FROM (SELECT query_id, vec_id, list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) AS score FROM q JOIN embeddings ON vec_id <> query_id)) WHERE rank <= 5""")
def embedding_topk(spark, d):
    v = tables.read(spark, d, "embeddings")
    return retrieval.top_k(v.where("vec_id % 100 = 0"), v).withColumn("score", F.round("score", 6))
