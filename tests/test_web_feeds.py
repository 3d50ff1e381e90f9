"""Feeds in XML: both formats, faults, a retry, and the way into ingestion."""

import threading
from collections import Counter
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from newsloom.sources.tables import feed_lines, ingested
from newsloom.sources.web_feeds import feed_documents, feed_rows, fetch_drop, fetched
from newsloom.streaming.feeds import dead_sources, ingest, source_states

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<!-- made by hand --><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>T</title><link>http://c</link>
<item><title>A &amp; b</title><link> http://x/1 </link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><guid isPermaLink="false">1</guid>
<description><![CDATA[<p>Body <img src="q.png"></p>]]></description><media:content url="m.png" type="image/png"/><media:content url="n.png"/></item>
<item><title>Only</title><enclosure url="e.png" type="image/png" length="3"/></item><item><description>nothing</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title>
<entry><title type="text">E1</title><link rel="self" href="http://self"/><link href="http://x/2"/><updated>2024-01-02T03:04:05Z</updated><content type="html">&lt;b&gt;hi&lt;/b&gt;</content></entry>
<entry><title>E2</title><link rel="self" href="http://self"/><published>2024-01-03T03:04:05Z</published><updated>2025-01-01T00:00:00Z</updated><summary>short</summary></entry></feed>"""
FAULTS = {
    "cut": ("<rss><channel><item><title>x</title></channel>", "not well-formed XML"), "page": ("<html><body>x</body></html>", "neither RSS nor Atom"),
    "null": (None, "no document"), "empty": ("", "not well-formed XML"), "attribute": ("<rss version><channel/></rss>", "not well-formed XML"),
}


def test_formats_and_faults(spark):
    docs = [("rss", RSS), ("atom", ATOM), ("none", '<rss version="2.0"><channel><title>t</title></channel></rss>'), *((k, d) for k, (d, _) in FAULTS.items())]
    rows = feed_rows(spark.createDataFrame(docs, "drop string, document string")).cache()
    assert {r.drop: r.fault for r in rows.where("error IS NOT NULL").collect()} == {k: f"fetch failed: {e}" for k, (_, e) in FAULTS.items()}
    assert [(r.drop, r.item_pos) for r in rows.where("fault = 'neither title nor link'").collect()] == [("rss", 2)]
    items = ingested(rows.where("fault IS NULL")).collect()
    got = {(r.source_url, r.source_title, r.body, r.published_at, r.image_url, r.item_pos) for r in items}
    assert got == {
        ("http://x/1", "A & b", '<p>Body <img src="q.png"></p>', datetime(2024, 1, 2, 3, 4, 5), "m.png", 0), ("", "Only", "Only", None, "e.png", 1),
        ("http://x/2", "E1", "<b>hi</b>", datetime(2024, 1, 2, 3, 4, 5), None, 0), ("http://self", "E2", "short", datetime(2024, 1, 3, 3, 4, 5), None, 1),
    }
    assert feed_rows(spark.createDataFrame([], "drop string, document string")).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(FAULTS["cut"][0])
    assert sorted((r.drop[-5:], r.fault is None) for r in feed_rows(feed_documents(spark, str(tmp_path))).collect()) == [("a.xml", False), ("a.xml", True), ("a.xml", True), ("b.xml", False)]


@pytest.fixture
def server():
    asked = Counter()

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            first = asked[self.path] == 1
            code = 404 if self.path == "/gone" else 503 if self.path == "/busy" and first else 200
            body = RSS.encode()
            if self.path == "/half" and first:
                body = body[:200]
            if self.path == "/latin":
                body = '<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><item><title>caf\u00e9</title><link>http://x/9</link></item></channel></rss>'.encode("latin-1")
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_fetching_with_one_retry(spark, server, tmp_path):
    at, asked = server
    sources = [(n, "Daily", "en", f"{at}/{n}") for n in ("good", "busy", "half", "gone", "latin")] + [("nowhere", "Daily", "en", None)]
    df = spark.createDataFrame(sources, "source_id string, source_name string, source_language string, url string")
    found = {r.source_id: (r.document is not None, r.error) for r in fetched(df, wait=0.01).collect()}
    assert found == {"good": (True, None), "busy": (True, None), "half": (True, None), "latin": (True, None), "gone": (False, "Status code 404"), "nowhere": (False, "no address")}
    assert asked == {"/good": 1, "/busy": 2, "/half": 2, "/gone": 2, "/latin": 1}
    drops, out = str(tmp_path / "drops"), str(tmp_path / "out")
    fetch_drop(df, drops, wait=0.01)
    assert {r.title for r in feed_lines(spark, drops).where("source_id = 'latin'").collect()} == {"caf\u00e9"}
    ingest(spark, drops, out, str(tmp_path / "at"), as_of=datetime(2024, 1, 4), look_back_days=None)
    assert {r.source_title for r in spark.read.parquet(out).collect()} == {"A & b", "Only", "caf\u00e9"}
    assert [r.source_id for r in dead_sources(spark, out).collect()] == ["gone"]
    assert {r.source_id for r in source_states(spark, out).where("last_fetched_at IS NOT NULL").collect()} == {"good", "busy", "half", "latin"}
