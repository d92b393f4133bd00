"""Pages that leave out end tags, as HTML allows, keep their text and links."""

import pytest

from ledgerlint.llm import warc

BODY = "<body><p>All the text</p><a href=/x>link</a>"


@pytest.mark.parametrize("page", [
    f"<html><head><title>t</title>{BODY}", f"<head><meta charset=utf-8><title>t</title><script>no()</script>{BODY}",
    "<head><title>t</title><p>All the text</p><a href=/x>link</a>", f"<head><title>t</title></head>{BODY}",
    "<p><svg width=1 />All the text</p><a href=/x>link</a>", "<p>All the text</p><svg/><svg><path/></svg><a href=/x>link</a>",
    "<p>All the text</p><svg><a href=/x>link</a>", "<p>All the text</p><svg-icon><a href=/x>link</a>"])
def test_open_and_self_closed(page):
    assert warc.plain_text(page).split() == ["All", "the", "text", "link"]
    assert b"outlink: http://h/x\r\n" in warc.metadata_block(page, "http://h/p")


@pytest.mark.parametrize("page", ["a<!-- no", "a<script>no", "a<style>no", "a<script>no</script >", "a<svg><title>no</title></svg>",
                                  "a<!-- <svg> -->", "<head><style>no</style><title>no</title></head>a", "<title>no</title>a<script"])
def test_what_is_not_shown(page):
    assert warc.plain_text(page) == "a"


def test_many_open_tags_take_one_pass():
    assert warc.plain_text("<svg>x" * 100_000) == " ".join("x" * 100_000)
