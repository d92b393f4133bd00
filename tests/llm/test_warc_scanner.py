"""The page scanner: attributes, declarations, bases, odd pages in linear time."""

import time

import pytest

from ledgerlint.llm import warc


@pytest.mark.parametrize("page,text", [
    ('<p title="x>y">z', "z"), ("<p title='a > b' class=c>z</p>", "z"), ("<p don't>z</p>it's", "z\nit's"), ('a<b title="x>y', "ay"),
    ("<!DOCTYPE html><?xml version='1.0'?>a</ >b", "ab"), ("1 < 2 &amp;lt; 3", "1 < 2 &lt; 3"), ("a<DIV>b</Div>c<br/>d", "a\nb\nc\nd"),
    ("x<title>open", "x open"), ("<p a = \"1>2\" b='3>4'>z", "z"), ("", ""), ("<", "<"), ("<a", "")])
def test_text(page, text):
    assert warc.plain_text(page) == text


@pytest.mark.parametrize("page,fields", [
    ("<base href='/b/'><a href=x>1</a>", ["outlink: http://h/b/x"]), ("<a href=x>1</a><base href=//o/><base href=//p/>", ["outlink: http://o/x"]),
    ("<a data-href=n href='y z'>", ["outlink: http://h/y z"]), ("<a title='href=n'>", []), ("<a href>", ["outlink: http://h/p"]),
    ("<!-- <a href=n> --><script>'<a href=n>'</script><a HREF=x>", ["outlink: http://h/x"]),
    ("<svg><title>n</title></svg><title> T\n &amp; u</title><title>n</title>", ["title: T & u"]),
    ("<html class='lang=n' lang=\"pt-BR\">", ["language: pt-BR"]), ("<html xml:lang=de>", ["language: de"]), ("<a href='http://[bad'>", ["outlink: http://[bad"])])
def test_fields(page, fields):
    assert warc.metadata_block(page, "http://h/p").decode().split("\r\n")[:-1] == fields


@pytest.mark.parametrize("piece", ["<a ", "<p ", '<a href="', "<a href='\" ", "<!--", "<title>", "</", "<a href=x><", "= ", "<a =", "<svg/>",
                                   "<script ", "</svg    ", "<a\n\n\n", "<noscript>", "&amp", "<a href = ", "\"'=<p "])
def test_a_megabyte_takes_a_moment(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.process_time()
    warc.plain_text(page), warc.metadata_block(page, "http://h/p")
    assert time.process_time() - start < 8


def test_record_ids_follow_the_payload(spark):
    rows = [(1, "u", "a"), (1, "u", "b"), (None, None, "a"), (None, None, "b"), (None, None, None), (1, "u", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    responses = warc.responses_from_pages(pages)
    got = responses.collect()
    assert len({r.record_id for r in got}) == 5
    payload = {r.record_id: warc.digest(bytes(r.payload)) for r in got}
    out = warc.derivatives(responses).collect()
    assert len(out) == 12 and all(payload[r.refers_to] == r.payload_digest for r in out)
    assert warc.warc_digest(pages.limit(0)).count() == 0


def test_payload_that_is_no_utf8(spark):
    page = spark.createDataFrame([(1, "r", "http://h/", None, None, bytearray(b"<p>\xff\xfe ok"))],
                                 "id long, record_id string, target_uri string, date string, http_headers string, payload binary")
    text = {r.warc_type: bytes(r.block).decode() for r in warc.derivatives(page).collect()}
    assert text == {"metadata": "", "conversion": "�� ok"}
