"""Catalog steps from feeds and listings to texts, with pages from a dictionary instead of a network."""

import datetime

from pyspark.sql import functions as F

from proseflow import cli, schemas
from proseflow.operators import eda, merge, quality
from proseflow.plans import catalog, fixtures, ingest
from proseflow.sources import pages
from proseflow.streaming import ingest as streaming

STATEMENT = '<html><body><div id="article"><div>head</div><div> </div><div>The longest <p>part of it<p>is text.</div></div></body></html>'
MINUTES = "<div id=article>Minutes<br>say this.\n\n\n\nReturn to text<h3>Footnotes</h3>1. no</div>"
BASE = "https://www.example.org"


def test_tree():
    root = pages.parse('<p class="a b">x<b>y<i>z</b>w<br/>v<script>t<p></script></p>&amp;é<unclosed')
    p = root.by_class("b")[0]
    assert p.text() == "xyzwv" and root.text().startswith("xyzwv&é") and root.by_class("c") == []
    deep = pages.parse("<div>" * 5000 + "x")
    assert deep.text() == "x" and sum(1 for _ in deep.walk()) == 5000


def test_bodies():
    assert pages.statement_text(STATEMENT) == "The longest part of itis text."
    assert pages.statement_text('<div id="article">a<div>b</div></div>') == "ab"
    assert pages.statement_text("<p>none</p>") is None and pages.minutes_text(None) is None
    assert pages.speech_text('<div id="article"><h1>t</h1><p>s</p><div>body</div></div>') == "body"
    assert pages.speech_text('<div id="article"><h1>t</h1><p>s</p><p>body</p></div>') is None
    assert pages.article_text("<article>x<b>y</article>z") == "xy"


def test_documents_from_feed_to_text(spark):
    today = F.lit("2024-03-01").cast("date")
    table = ingest.discover_documents(schemas.empty(spark, schemas.DOCUMENTS), fixtures.FEEDS.frame(spark), BASE, today)
    again = ingest.discover_documents(table, fixtures.FEEDS.frame(spark), BASE, today)
    assert table.count() == again.count() == 5 and again.agg(F.countDistinct("id")).first()[0] == 5
    web = {f"{BASE}/a.htm": STATEMENT, f"{BASE}/m.htm": MINUTES}
    fetched = ingest.fetch_documents(table, web.get)
    done = {r.doc_id: r for r in ingest.parse_documents(fetched).collect()}
    assert done["St_20240201"].doc_text == "The longest part of itis text." and done["St_20240201"].parsed
    assert done["Mn_20240131"].doc_text == "Minutessay this." and done["Mn_20240131"].raw_html == MINUTES
    assert not done["St_20110103"].fetched and done["St_20110103"].doc_text is None
    assert {r.check: r["count"] for r in quality.check_documents(fetched).collect()} == {"missing_html_and_pdf_url": 1, "not_fetched": 3, "fetched_not_parsed": 2}


def test_speeches_from_listing_to_text(spark):
    new = '<div class="eventlist__event"><a href="/s/20240131a.htm">T</a>\n\nGovernor P\n\nAt a forum\n</div><div class="eventlist__event">no link\nx</div><div class="eventlist__event"><a href="/s/99999999.htm">Bad date</a>\nX\nY</div>'
    old = '<div class="title"><a href="/s/1999.htm"> Old talk </a></div><div class=speaker>Chairman Q</div><div class=location>Town</div><div class="title"><a href="/s/extra.htm">no speaker</a></div>'
    listing = spark.createDataFrame([(2024, new), (1999, old), (2001, None)], "year int, html string")
    table = ingest.discover_speeches(schemas.empty(spark, schemas.SPEECHES), listing, BASE, F.lit("2024-03-01").cast("date"))
    got = {r.link: r for r in table.collect()}
    assert got[f"{BASE}/s/20240131a.htm"].speaker == "Governor P" and got[f"{BASE}/s/20240131a.htm"].event == "At a forum"
    assert got[f"{BASE}/s/1999.htm"].speech_date == datetime.date(1999, 1, 1) and got[f"{BASE}/s/1999.htm"].title == "Old talk" and len(got) == 2
    web = {f"{BASE}/s/20240131a.htm": '<div id="article"><p>1</p><p>2</p><div>Words.\n\n\nMore.Footnotes x</div></div>', f"{BASE}/s/1999.htm": "<p>Return to top<p>menu Return to top Old words. Endnotes"}
    done = {r.link: r.speech_text for r in ingest.fetch_speeches(table, web.get).collect()}
    assert done == {f"{BASE}/s/20240131a.htm": "Words.\nMore.", f"{BASE}/s/1999.htm": "Old words."}
    assert ingest.fetch_speeches(table, web.get, limit=1).where("processed").count() == 1


def test_insert_or_ignore_and_updates(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "b", 0), (2, "d", 2), (2, "c", 1)], "id int, v string, arrival int")
    assert sorted(tuple(r) for r in merge.insert_or_ignore(old, new, ["id"], ["arrival"]).collect()) == [(1, "a"), (2, "c")]
    nulls = spark.createDataFrame([(None, "x", 0), (None, "x", 0)], "id int, v string, arrival int")
    assert merge.insert_or_ignore(old, nulls, ["id"], ["arrival"]).count() == 3
    up = spark.createDataFrame([(1, None), (3, "x")], "id int, v string")
    assert [tuple(r) for r in merge.update_by_key(old, up, ["id"], ["v"]).collect()] == [(1, None)]
    assert [tuple(r) for r in merge.update_by_key(old, up, ["id"], ["v"], F.col("v").isNotNull()).collect()] == [(1, "a")]
    assert sorted(tuple(r) for r in merge.replace_by_key(old, up.where("id = 3"), ["id"]).collect()) == [(1, "a"), (3, "x")]


def test_tables_are_created_once(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS catalog_test LOCATION '{tmp_path}'")
    for _ in range(2):
        schemas.create_tables(spark, "catalog_test")
    assert {f.name for f in spark.table("catalog_test.chunks").schema} == {f.name for f in schemas.CHUNKS}
    spark.sql("DROP DATABASE catalog_test CASCADE")


def test_consolidation(spark):
    chunk = "id long, source_type string, source_id long, chunk_index int"
    a = spark.createDataFrame([(1, "speech", 1, 0), (2, "speech", 1, 1)], chunk)
    b = spark.createDataFrame([(1, "document", 1, 0), (3, "speech", 1, 1)], chunk)
    assert catalog.consolidate({"chunks": a}, {"chunks": b})["chunks"].count() == 3
    assert catalog.consolidate({"chunks": a}, {"chunks": b}, legacy_id_collision=True)["chunks"].count() == 3
    assert {(r.id, r.source_type) for r in catalog.consolidate({"chunks": a}, {"chunks": b}, True)["chunks"].collect()} == {(1, "speech"), (2, "speech"), (3, "speech")}
    assert catalog.consolidate({}, {})["chunks"] is None


def test_reports(spark):
    good = spark.createDataFrame([(1, datetime.date(2024, 1, 1), "t", "s", "e", "l", "x", None, True)], schemas.SPEECHES)
    assert quality.summary(quality.check_speeches(good), "speeches") == "speeches: complete" and not quality.has_errors(quality.check_speeches(good))
    bad = spark.createDataFrame([(1, None, "t", "  ", "e", "", None, None, False)], schemas.SPEECHES)
    issues = quality.check_speeches(bad)
    assert quality.has_errors(issues) and "3 error(s), 1 warning(s)" in quality.summary(issues, "speeches")


def test_exploration_cases(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "id int, x double")
    bins = eda.histogram(df, "x", 4).orderBy("bin").collect()
    assert [r.n for r in bins] == [0, 0, 2, 0] and eda.histogram(df.where("x > 9"), "x").count() == 0
    spoken = {r.id: (r.speaker, r.event, r.role) for r in eda.cleaned_speakers(fixtures.SPEAKERS.frame(spark), {"Chairman Bernanke": "Chairman Ben S. Bernanke"}).collect()}
    assert spoken[3] == ("man C. Roy", "Dinner", "Vice Chairman") and spoken[5] == ("E. Fox", "At the Annual Forum", "Governor") and spoken[6] == (None, "Nowhere", "Other") and spoken[7][0] == "Ben S. Bernanke"
    assert [r.text for r in eda.overwritten(spark.createDataFrame([(1, "a"), (2, None)], "id int, text string"), "id", {2: "new"}, "text").orderBy("id").collect()] == ["a", "new"]


def test_stream_inserts_each_key_once(spark, tmp_path):
    folder, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    (tmp_path / "in").mkdir()
    schema = "doc_id string, n int"
    for k, lines in enumerate(('{"doc_id": "a", "n": 1}\n{"doc_id": "a", "n": 0}', '{"doc_id": "a", "n": 5}\n{"doc_id": "b", "n": 2}')):
        (tmp_path / "in" / f"{k}.json").write_text(lines)
        streaming.insert_new(streaming.new_files(spark, folder, schemas.flat(schema)), table, check, ["doc_id"], ["n"]).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(table).collect()) == [("a", 0), ("b", 2)]


def test_command_line_stages(spark, tmp_path):
    home = str(tmp_path)
    (tmp_path / "feed.json").write_text(fixtures.FEEDS.rows[0][1], encoding="utf-8")
    web = {f"{BASE}/a.htm": STATEMENT, f"{BASE}/m.htm": MINUTES, f"{BASE}/newsevents/speech/2024-speeches.htm": '<div class="eventlist__event"><a href="/s/20240131a.htm">T</a>\n\nGovernor P\n</div>', f"{BASE}/s/20240131a.htm": '<div id="article"><p>1</p><p>2</p><div>Words.</div></div>'}
    site = ["--base-url", BASE, "--delay", "0"]
    assert cli.main(["documents", "--catalog", home, "--out", f"{home}/a", "--feeds", f"{home}/feed.json", "--discovery-only", *site], web.get) == 0
    assert spark.read.parquet(f"{home}/a/documents.parquet").where("fetched").count() == 0
    assert cli.main(["documents", "--catalog", f"{home}/a", "--out", f"{home}/b", "--fetch-only", "--limit", "0", *site], web.get) == 0
    assert cli.main(["documents", "--catalog", f"{home}/b", "--out", f"{home}/c", "--parse-only"], web.get) == 0
    assert spark.read.parquet(f"{home}/c/documents.parquet").where("parsed").count() == 2
    assert cli.main(["speeches", "--catalog", home, "--out", f"{home}/a", "--start-year", "2010", "--end-year", "2024", *site], web.get) == 0
    assert [r.speech_text for r in spark.read.parquet(f"{home}/a/speeches.parquet").collect()] == ["Words."]
    # Every page is got once in a run of all stages; calls are noted in a file, as they are made by workers.
    log = tmp_path / "calls"

    def noted(url, log=str(log), web=dict(web)):
        with open(log, "a", encoding="utf-8") as f:
            f.write(url + "\n")
        return web.get(url)

    assert cli.main(["speeches", "--catalog", home, "--out", f"{home}/s", "--start-year", "2023", "--end-year", "2024", *site], noted) == 0
    assert cli.main(["documents", "--catalog", home, "--out", f"{home}/d", "--feeds", f"{home}/feed.json", *site], noted) == 0
    calls = log.read_text(encoding="utf-8").split()
    assert len(calls) == len(set(calls)) >= 5 and f"{BASE}/s/20240131a.htm" in calls
    assert pages.http_get("http://127.0.0.1:9/none") is None and pages.http_get("no address") is None


def test_stream_counts_by_window(spark, tmp_path):
    import datetime as dt

    spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), k) for m, k in ((1, "a"), (2, "a"), (7, "b"))], "ts timestamp, kind string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))
    q = streaming.windowed_counts(stream, "ts", "5 minutes", "10 minutes", "kind").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.kind, r.n) for r in spark.sql("SELECT * FROM counts").collect()) == [("a", 2), ("b", 1)]


def test_command_line(spark, tmp_path, capsys):
    home = str(tmp_path)
    spark.createDataFrame([(1, datetime.date(2024, 1, 1), "t", "s", "e", "l", "Inflation needs tightening.", None, True), (2, None, "t", "s", "e", "", None, None, False)], schemas.SPEECHES).write.parquet(f"{home}/speeches.parquet")
    assert cli.main(["features", "--catalog", home, "--out", f"{home}/features", "--limit", "0"]) == 0
    assert spark.read.parquet(f"{home}/features").first().hawkish_score == 1.0
    assert cli.main(["check", "--catalog", home]) == 1 and "speeches.missing_link 1 (" in capsys.readouterr().out
    assert cli.main(["consolidate", "--speeches-catalog", home, "--documents-catalog", home, "--out", f"{home}/out"]) == 0
    assert spark.read.parquet(f"{home}/out/speeches.parquet").count() == 2
