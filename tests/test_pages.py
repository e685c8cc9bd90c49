"""Main text of pages, and what isn't fetched."""

from pyspark.sql import functions as F

from graphloom.functions import pages

LONG = "A sentence of the text that goes on for more than forty characters. "


def test_main_text(spark):
    html = (
        f"<html><head><title> A &amp;\n B </title></head><body><!-- <p>{LONG}</p> --><NAV><ul><li>{LONG}</li></ul></NAV><header>{LONG}</header>"
        f"<div><a href='/a'>{LONG}</a><a href='/b'>{LONG}</a></div><h1>Short</h1><p>{LONG}{LONG}{LONG} &lt;x&gt; with <a href='y'>a link</a></p><p>{LONG}</p><div>x</div><div>y</div><div>z</div><p>{LONG}</p><footer>{LONG}</footer></body>"
    )
    table = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "no tags at all, but rather long to be a block of text in a page that has nothing else in it")], "page_id int, html string").withColumn("title", F.lit(7))
    got = {r.page_id: (r.title, r.blocks) for r in pages.main_text(table).collect()}
    assert got[1] == ("A & B", ["Short", f"{LONG}{LONG}{LONG}<x> with a link", LONG.strip()])
    assert got[2] == got[3] == ("", []) and got[4] == ("", ["no tags at all, but rather long to be a block of text in a page that has nothing else in it"])


def test_long_and_broken_pages(spark):
    many = "".join(f"<p>{LONG}{k}" for k in range(20_000))
    broken = "<p>" + "<" * 50_000 + LONG
    table = spark.createDataFrame([(1, many), (2, broken), (3, "<script>" + LONG * 1000)], "page_id int, html string")
    got = {r.page_id: len(r.blocks) for r in pages.main_text(table).collect()}
    assert got[1] == 20_000 and got[2] == 1


def test_fetched(spark):
    rows = [
        (1, "https://user@Example.org:80/x", f"<html><p>{LONG}{LONG}</p></html>", "Text/HTML; charset=utf-8"), (2, "http://localhost/x", "<p>x", "text/html"), (3, "ftp://a.b/", "x", "text/plain"), (4, "https://a.b/", "{}", "application/json"),
        (5, "https://10.0.0.1/", "x", "text/plain"), (6, "https://10.example.org/", "x", "text/plain"), (7, "https://a.b", "bytes", "application/pdf"), (8, "https://a.b", "<p>short", "text/html"), (9, None, None, None), (10, "https://8.8.8.8/", "x", "text/plain"),
        (11, "http://[::1]/", "x", "text/plain"), (12, "http://2130706433/", "x", "text/plain"),
    ]
    table = spark.createDataFrame(rows, "id int, url string, html string, kind string")
    got = {r.id: (r.host, r.content, r.binary, r.error) for r in pages.fetched(table, media_type="kind").collect()}
    blocked = "URL blocked by security policy"
    assert got[1] == ("example.org", (LONG + LONG).strip(), False, None) and got[4][1:] == ("{}", False, None) and got[6][3] is None and got[10][3] is None
    assert all(got[k][3] == blocked and got[k][1] == "" for k in (2, 3, 5, 9, 11, 12))
    assert got[7][1:] == ("", True, None) and got[8][3] == "Could not extract content"
    kept = {r.id: r.error for r in pages.fetched(table, media_type="kind", allowed=("text/html",)).collect()}
    assert kept[1] is None and kept[4] == "content type not allowed" and kept[5] == blocked
