"""WARC derivatives: metadata and plain-text conversion records.

Every response yields two records that refer to it: a metadata record (warc
fields: title, language, links) and a conversion record (its text). Both
keep the response's target, date, payload digest and HTTP headers, and name
each other, so that a derivative file stands on its own. Records can be
serialised as members of a WARC file and read back exactly.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import json
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlint.llm.common import col

#: A tag with its attributes (a quoted value may hold ``>``), a comment's start, or another declaration. No part of it
#: gives back what it took, and a quote without an end is the last of its kind, so a page is read in linear time.
TOKEN = re.compile(r"""<(?:(?P<comment>!--)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"""
                   r"""(?P<attributes>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)|[!/?][^>]*+(?:>|\Z))""")
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
#: Elements that are not shown, and those of them that swallow the rest of a page if they have no end.
HIDDEN = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "svg", "title")}
TO_THE_END = ("script", "style")
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li "
                   "main nav ol p pre section table tbody td th tr ul".split())
BLANKS = re.compile(r"[ \t\r\f\v ]+")
UNKNOWN_DATE = "1970-01-01T00:00:00Z"


def attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name; of a name that repeats, the first."""
    out = {}
    for name, *values in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), next((v for v in values if v), ""))
    return out


class Page:
    """One pass over a page: ``text``, ``title``, ``language``, ``links`` and
    ``base`` (None where there is none).

    Comments and hidden elements give a blank, blocks a line break, other
    tags nothing; ``head`` ends where the body begins, with or without its
    end tag, as apart from hidden elements it holds tags alone. A hidden
    element without an end loses only its start tag, but for ``TO_THE_END``;
    a self-closed ``svg`` is closed. A title without an end is text, and a
    quote without an end does not keep ``>`` from ending its tag.
    """

    def __init__(self, page: str):
        self.title = self.language = self.base = None
        self.links, out, at, endless = [], [], 0, set()
        while m := TOKEN.search(page, at):
            out.append(page[at:m.start()])
            at = m.end()
            if m["comment"]:
                out.append(" ")
                end = page.find("-->", at)
                at = len(page) if end < 0 else end + 3
                continue
            name = m["name"].lower() if m["name"] else ""
            if name in BREAKS:
                out.append("\n")
            elif m["end"]:
                continue
            elif name in HIDDEN:
                out.append(" ")
                at = self.after_hidden(page, name, at, m["attributes"], endless)
            elif name == "a":
                link = attributes(m["attributes"]).get("href")
                if link is not None:
                    self.links.append(one_line(link))
            elif name == "html" and self.language is None:
                have = attributes(m["attributes"])
                lang = re.match(r"\s*([\w-]+)", have.get("lang") or have.get("xml:lang") or "")
                self.language = lang[1] if lang else None
            elif name == "base" and self.base is None:
                self.base = attributes(m["attributes"]).get("href")
        self.text = "".join(out) + page[at:]

    def after_hidden(self, page: str, name: str, at: int, rest: str, endless: set) -> int:
        """Where the page goes on behind a hidden element."""
        if name in endless or name == "svg" and rest.endswith("/"):
            return at
        end = HIDDEN[name].search(page, at)
        if end:
            if name == "title" and self.title is None:
                self.title = one_line(page[at:end.start()])
            return end.end()
        endless.add(name)
        return len(page) if name in TO_THE_END else at

    def plain_text(self) -> str:
        lines = (BLANKS.sub(" ", x).strip() for x in entities.unescape(self.text).split("\n"))
        return "\n".join(x for x in lines if x)

    def fields(self, uri: str) -> bytes:
        out = [f"title: {self.title}"] if self.title is not None else []
        out += [f"language: {self.language}"] if self.language else []
        base = joined(uri, one_line(self.base)) if self.base else uri
        out += [f"outlink: {joined(base, x)}" for x in self.links]
        return "".join(x + "\r\n" for x in out).encode("utf-8", "replace")


def joined(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def plain_text(page: str) -> str:
    """Visible text: blocks on lines of their own, entities resolved."""
    return Page(page).plain_text()


def metadata_block(page: str, uri: str) -> bytes:
    """Title, language and links (resolved by ``base``) as warc fields."""
    return Page(page).fields(uri)


def one_line(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same urn for the same parts, on every run."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=4)}>"


def responses_from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                         date_col: str | None = None) -> DataFrame:
    """Pages as response records: id, target, date, HTTP headers, payload.

    The record id follows from page id, url and payload: rows that share an
    id and a url but not the page are different responses, rows repeated whole
    the same one. Null html gives an empty payload, a null url an empty target.
    """
    def rows(batches):
        for batch in batches:
            ids, urls, dates, payloads = (batch.column(c).to_pylist() for c in ("id", "url", "date", "payload"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"),
                 pa.array([record_id("response", str(i), u or "", digest(p)) for i, u, p in zip(ids, urls, payloads)], pa.string()),
                 pa.array([u or "" for u in urls], pa.string()), pa.array([d or UNKNOWN_DATE for d in dates], pa.string()),
                 pa.array(["HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"] * batch.num_rows, pa.string()),
                 batch.column("payload")],
                names=["id", "record_id", "target_uri", "date", "http_headers", "payload"])

    kind = pages.schema[id_col].dataType.simpleString()
    date = col(date_col).cast("string") if date_col else F.lit(None).cast("string")
    return pages.select(col(id_col).alias("id"), col(url_col).alias("url"), date.alias("date"),
                        F.coalesce(col(html_col), F.lit("")).cast("binary").alias("payload")) \
        .mapInArrow(rows, f"id {kind}, record_id string, target_uri string, date string, http_headers string, payload binary")


RECORD_DDL = ("warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, "
              "date string, content_type string, source_headers string, payload_digest string, block_digest string, "
              "content_length long, block binary")


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records for each response: metadata and conversion.

    ``responses`` has the columns of ``responses_from_pages``; others are
    ignored. ``refers_to`` is the response's record id, ``concurrent_to`` the
    other derivative's, ``source_headers`` the response's HTTP headers and
    ``payload_digest`` the digest of its payload; ``block_digest`` is the
    derivative's own. A null record id refers to nothing (empty). Null
    payload: an empty one, both records are still written. Payloads that are
    not UTF-8 are read with replacement characters. Repeated rows repeat
    their records. Empty table: empty.
    """
    def rows(batches):
        for batch in batches:
            out = []
            names = ("record_id", "target_uri", "date", "http_headers", "payload")
            for rid, uri, date, headers, payload in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                rid, uri, payload = rid or "", uri or "", payload or b""
                page, mark = Page(payload.decode("utf-8", "replace")), digest(payload)
                own = {k: record_id(k, rid, uri, mark) for k in ("metadata", "conversion")}
                for kind, other, content, block in (
                        ("metadata", "conversion", "application/warc-fields", page.fields(uri)),
                        ("conversion", "metadata", "text/plain; charset=utf-8", page.plain_text().encode("utf-8", "replace"))):
                    out.append((kind, own[kind], rid, own[other], uri, date or UNKNOWN_DATE, content, headers or "",
                                mark, digest(block), len(block), block))
            ids = batch.column("id").take(pa.array([i for i in range(batch.num_rows) for _ in range(2)], pa.int64()))
            kinds = [pa.string()] * 10 + [pa.int64(), pa.binary()]
            names = [x.split()[0] for x in RECORD_DDL.split(", ")]
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(columns, kinds))], names=["id", *names])

    kind = responses.schema["id"].dataType.simpleString()
    return responses.select("id", "record_id", "target_uri", "date", "http_headers", "payload") \
        .mapInArrow(rows, f"id {kind}, {RECORD_DDL}")


HEADERS = (("warc_type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("refers_to", "WARC-Refers-To"),
           ("concurrent_to", "WARC-Concurrent-To"), ("target_uri", "WARC-Target-URI"), ("date", "WARC-Date"),
           ("payload_digest", "WARC-Refers-To-Payload-Digest"), ("block_digest", "WARC-Block-Digest"),
           ("content_type", "Content-Type"), ("content_length", "Content-Length"))
SOURCE_HEADERS = "WARC-Source-HTTP-Headers"


def member(record: dict) -> bytes:
    """One record as a gzip member; members in a row are a WARC file."""
    lines = ["WARC/1.1", *(f"{name}: {record[key]}" for key, name in HEADERS if record[key] != "")]
    lines.append(f"{SOURCE_HEADERS}: {json.dumps(record['source_headers'])}")
    head = "".join(x.replace("\r", "%0D").replace("\n", "%0A") + "\r\n" for x in lines)
    return gzip.compress(head.encode() + b"\r\n" + record["block"] + b"\r\n\r\n", mtime=0)


def read_members(data: bytes) -> list[dict]:
    """The records of a WARC file made of members."""
    raw, out, at = gzip.decompress(data) if data else b"", [], 0
    keys = {name: key for key, name in HEADERS}
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        record = dict.fromkeys(keys.values(), "")
        for line in raw[at:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(": ")
            value = value.replace("%0D", "\r").replace("%0A", "\n") if name == "WARC-Target-URI" else value
            record["source_headers" if name == SOURCE_HEADERS else keys[name]] = (
                json.loads(value) if name == SOURCE_HEADERS else value)
        size = record["content_length"] = int(record["content_length"])
        record["block"] = raw[end + 4:end + 4 + size]
        out.append(record)
        at = end + 4 + size + 4
    return out


def warc_members(records: DataFrame) -> DataFrame:
    """Records as ``id``, ``warc_type``, ``record_id`` and ``member``
    (binary): the members of a partition, one after another, form a file."""
    names = [k for k, _ in HEADERS] + ["source_headers", "block"]

    def rows(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names]
            blobs = [member(dict(zip(names, r))) for r in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "warc_type", "record_id")),
                                              pa.array(blobs, pa.binary())], names=["id", "warc_type", "record_id", "member"])

    kind = records.schema["id"].dataType.simpleString()
    return records.mapInArrow(rows, f"id {kind}, warc_type string, record_id string, member binary")


def warc_digest(pages: DataFrame) -> DataFrame:
    """All records of all pages; the block as text."""
    out = derivatives(responses_from_pages(pages))
    return out.select(F.col("id").alias("page_id"), *[x.split()[0] for x in RECORD_DDL.split(", ")[:-1]],
                      F.col("block").cast("string").alias("content"))
