"""Entities in the plain text of pages."""

import hashlib
import html
import re

from pyspark.sql import functions as F

from shelfmark.llm import queries, warc

FOLDER = "/root/testdata/sf0.01"
BLOCKS = "address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul"


def text_of(page):
    for pattern in (r"<script\b.*?</script\s*>", r"<style\b.*?</style\s*>", r"<!--.*?-->"):
        page = re.sub(pattern, " ", page, flags=re.I | re.S | re.A)
    page = re.sub(r"\s+", " ", page, flags=re.A)
    page = re.sub(r"</?(%s)(\s[^<>]*)?/?>" % BLOCKS.replace(" ", "|"), "\n", page, flags=re.I | re.A)
    page = re.sub(r"<[a-zA-Z/!?][^<>]*>", "", page)
    page = html.unescape(re.sub(r"&nbsp;?|&#0*160;|&#[xX]0*[aA]0;", " ", page))
    lines = [re.sub(r"[ \t]+", " ", line) for line in page.split("\n")]
    return "\n".join(x for x in (line.strip(" ") if k else line.rstrip(" ") for k, line in enumerate(lines)) if x).strip(" \n")


def test_whole_query_against_brute_force(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = queries.op2_warc_derivatives(spark, FOLDER).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        page = pages[r["page_id"]]["html"] or ""
        block = r["block"].encode()
        assert r["target_uri"] == pages[r["page_id"]]["url"] and r["content_length"] == len(block)
        assert r["block_digest"] == "sha256:" + hashlib.sha256(block).hexdigest() and r["payload_digest"] == "sha256:" + hashlib.sha256(page.encode()).hexdigest()
        if r["record_type"] == "conversion":
            assert r["block"] == text_of(page)
        else:
            title = re.search(r"<title[^>]*>(.*?)</title", page, re.I | re.S)
            assert f"title: {re.sub(r'\s+', ' ', title[1], flags=re.A).strip(' ') if title else ''}\r\n" in r["block"]
            assert "http-header: Content-Type: text/html; charset=utf-8\r\n" in r["block"]
    assert len({r["record_id"] for r in rows}) == len(rows)


def test_all_headers_of_the_source_are_kept(spark):
    header = "HTTP/1.1 200 OK\r\nServer: x/1\r\nLast-Modified: Mon, 01 Jan 2024\r\n 10:00:00 GMT\r\ncontent-type: text/html\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\n"
    rows = [("<urn:1>", "http://x", "2026-01-01T00:00:00Z", header, "<p>t"), ("<urn:2>", "http://y", "2026-01-01T00:00:00Z", None, "t")]
    given = spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, http_header string, payload string")
    blocks = {r["refers_to"]: r["block"] for r in warc.derive(given).where("record_type = 'metadata'").collect()}
    kept = [line for line in blocks["<urn:1>"].split("\r\n") if line.startswith("http-header: ")]
    assert kept == [f"http-header: {h}" for h in ("Server: x/1", "Last-Modified: Mon, 01 Jan 2024 10:00:00 GMT", "content-type: text/html", "Set-Cookie: a", "Set-Cookie: b")]
    assert "http-header" not in blocks["<urn:2>"]


def test_regexes_of_a_page_stand_in_the_plan_once(spark):
    plan = queries.op2_warc_derivatives(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<script") == 1


def test_all_entities_are_resolved(spark):
    given = ["&copy; 2026 &middot; x", "&#8217;&#x27;&#X2019;&hellip;", "&amp;lt; &amp;copy; &lt;b&gt;", "a&nbsp;&#160;&#xA0;b", "AT&T & &unknown; &copy", "none", "&eacute;&Eacute;&CounterClockwiseContourIntegral;", "&#1600;"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", warc.plain_text(F.col("t")).alias("t")).collect()
    got = [r["t"] for r in sorted(rows)]
    want = [html.unescape(t) for t in given]
    want[3] = "a b"
    assert got == want
