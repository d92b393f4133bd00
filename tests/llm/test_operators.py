"""The operators against brute force, exact round trips and held-out
accuracy, and on the inputs they must define: nulls in any column, empty and
long texts, ties, repeated rows, empty tables, clashing column names."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlint.llm import decontaminate, jaccard_join, language, line_rules, packing, queries, substring_dedup
from ledgerlint.llm import suffix_dedup, toxicity, url_filter, warc
from ledgerlint.llm.oracles import oracle_sql
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.oracle_compare import _rows, duck

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Repeats across and within documents, copies, near copies, nulls."""
    a, b, c = passage(1, 60), passage(2, 45), passage(3, 300)
    near = c[:150] + ["changed"] + c[151:]
    rows = [(1, " ".join(a + b)), (2, " ".join(passage(4, 30) + a + passage(5, 9))), (3, None), (4, ""), (5, " \t\n"),
            (6, " ".join(c)), (7, " ".join(near)), (8, " ".join(c)), (9, "same " * 400), (10, "a b"), (11, "A  b"),
            (12, " ".join(b + b)), (13, "é" * 300 + " " + "é" * 300), (14, "x\n" * 50 + " ".join(a)), (15, " ".join(passage(6, 30000))),
            (16, "日本語 text İ " * 30)]
    return [(d, t, ["en", "de", None][d % 3], ["s", None][d % 2], 0) for d, t in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_substring_dedup(spark, odd):
    got = substring_dedup.substring_dedup_digest(frame(spark, odd)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.substring_dedup(pairs(odd)))


def test_suffix_dedup(spark, odd):
    got = suffix_dedup.suffix_dedup_digest(frame(spark, odd)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.byte_dedup(pairs(odd)))


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_components(spark, odd, n, percent):
    rng = np.random.default_rng(7)
    base = passage(8, 120)
    rows = odd + [(100 + i, " ".join("zz" if rng.random() < 0.012 else w for w in base), "en", "s", 0) for i in range(40)]
    got = jaccard_join.ngram_components(frame(spark, rows), n, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute.jaccard_components(pairs(rows), n, percent))


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 4, 400)
    text[[100, 399]] = 0
    index = substring_dedup.FMIndex(text, 3)
    for size in (1, 2, 5):
        for s in range(0, 390, 7):
            want = text[s:s + size]
            if 0 in want:
                continue
            lo, hi = np.array([0]), np.array([400])
            for x in want[::-1]:
                lo, hi = index.extend(lo, hi, np.array([x]))
            assert hi[0] - lo[0] == sum((text[i:i + size] == want).all() for i in range(400 - size + 1))


def test_run_length_matches():
    rng = np.random.default_rng(4)
    text = rng.integers(1, 3, 200)
    text[[60, 199]] = 0
    best, runs = suffix_dedup.longest_elsewhere(text, 2)
    assert runs < 200

    def common(p, q):
        n = 0
        while p + n < 200 and q + n < 200 and text[p + n] == text[q + n] != 0:
            n += 1
        return n

    for p in range(199):
        if text[p]:
            assert best[p] == max(common(p, q) for q in range(200) if q != p)


def test_line_rules_count_documents(spark):
    words = [" ".join(passage(i, 60)) for i in range(30)]
    rows = [(i, w + "\nThe Footer 12 here", "en", "h", 0) for i, w in enumerate(words)]
    rows += [(50 + i, "\n".join(["The footer 99 here"] * 20), "en", "h", 0) for i in range(2)] + [(60, None, None, None, None)]
    got = {r.doc_id: r for r in line_rules.line_rules_digest(frame(spark, rows)).collect()}
    assert got[0].n_frequent_words == 4 and got[0].kept and not got[0].base_failed
    assert got[50].n_frequent_words == 80 and not got[50].kept and got[50].n_dup_lines == 19
    assert (got[60].n_words, got[60].kept, got[60].base_failed) == (0, False, True)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = language.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.toxic == r.predicted for r in got]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_network_gradients():
    net = toxicity.Network(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    ids = np.random.default_rng(2).integers(0, 50, (12, 4))
    before, label = np.array([0, 5, 5, 6, 12]), np.array([1.0, 0, 1, 0])

    def loss():
        z = net.pooled(ids, before).astype(np.float64) @ net.p["out"] + net.p["bias"][0]
        return np.mean(np.log1p(np.exp(z)) - label * z)

    g = net.gradients(ids, before, label)
    for k, at in (("w1", (0, 3, 2)), ("w2", (1, 4, 5)), ("w3", (2, 1, 1)), ("out", (4,)), ("bias", (0,))):
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-3
        up = loss()
        net.p[k][at] = keep - 1e-3
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-3


def test_tiles_reordered():
    a = np.arange(40).astype(np.uint64)
    text = np.concatenate([a[20:40], [99], a[10:20], [98, 97], a[:10]]).astype(np.uint64)
    tiles = decontaminate.tile(a, text, 5)
    assert tiles[0] == (20, 0, 20) and sum(t[2] for t in tiles) == 40
    assert decontaminate.tile(a, a[:4], 5) == [] and decontaminate.tile(a[:0], a, 5) == []


def test_decontamination_both_ways(spark, odd):
    item = passage(9, 30)
    rows = odd + [(200, " ".join(passage(10, 40) + item[15:] + passage(11, 8) + item[:15])), (201, " ".join(item[:8])), (202, "SHORT, one!")]
    docs = frame(spark, [(*r, None, None, None)[:5] for r in rows])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "short ONE")], "item_id long, text string")
    got = [sorted((r.doc_id, r.item_id, r.covered_tokens) for r in
                  decontaminate.contaminated(docs, bench, broadcast_bytes=b).collect()) for b in (1 << 20, 0)]
    assert got[0] == got[1] == [(200, 1, 30), (202, 4, 2)]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(packing.default_tokenizer())
    rows = odd + [(300 + i, t, "en", "s", 0) for i, t in enumerate(
        ["it's we've ''s 's can't x'y", "<|endoftext|>", "abc <|endoftext|> def<|startoftext|>", "A <|ENDOFTEXT|> b",
         "<|endoftext|>" * 3, "a\x00b", "a\u0085c ½1²", "é ǅ", " 's"])]
    pieces = packing.pack(frame(spark, rows).select("doc_id", "text"), packing.default_tokenizer()).collect()
    by_doc, stream = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32 and p.offset + p.length <= 2048
        assert p.start == len(by_doc.setdefault(p.doc_id, []))
        by_doc[p.doc_id] += ids
        stream[p.sequence_id, p.offset] = p.length
    for d, t in pairs(rows):
        assert by_doc[d] == whole.encode(t or "", add_special_tokens=False).ids + [1]
    at = 0
    for (s, o), n in sorted(stream.items()):
        assert s * 2048 + o == at
        at += n


def test_url_rules(spark):
    urls = ["http://a.com/x", "HTTP://www.EXAMPLE.com/en/1", "http://b.example.com/en/1", "http://a.net/es/", "http://a.net/x",
            "http://a.com", None, "no scheme adult", "http://adult-x.org/", "http://adults.org/", "http://ads.org/track?x", "http://ads.org/ads",
            "http://xcom/", ""]
    rows = [(i, u, "h", i) for i, u in enumerate(urls)]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, Host string, rule int")).collect()}
    assert [got[i].rule for i in range(7)] == ["com/", "www.example.com/en/", "example.com/en/", "net/es/", None, None, None]
    assert [got[i].verdict for i in range(len(urls))] == ["allow", "allow", "block", "block", "allow", "allow", "allow", "block",
                                                        "block", "allow", "block", "allow", "allow", "allow"]
    assert (got[6].host, got[6].path, got[1].host) == ("", "", "www.example.com")


def test_warc_round_trip(spark):
    page = "<html lang='fr'><head><title>A &amp; B</title></head><body><p>x<br>y</p><script>no()</script><a href='/z?a=1&amp;b=2'>l</a></body></html>"
    pages = spark.createDataFrame([(1, "http://h/p", page), (2, None, None), (3, "http://h/\r\nq", "<p>é"), (1, "http://h/p", page)],
                                  "page_id long, url string, html string")
    responses = warc.responses_from_pages(pages)
    records = warc.derivatives(responses)
    rows = [r.asDict() for r in records.orderBy("id", "warc_type").collect()]
    assert len(rows) == 8
    known = {r.record_id: r for r in responses.collect()}
    for r in rows:
        source = known[r["refers_to"]]
        assert r["payload_digest"] == warc.digest(bytes(source.payload)) and r["source_headers"] == source.http_headers
        assert r["block_digest"] == warc.digest(bytes(r["block"])) and r["content_length"] == len(r["block"])
        assert r["concurrent_to"] in {x["record_id"] for x in rows if x["refers_to"] == r["refers_to"]}
    texts = {(r["id"], r["warc_type"]): bytes(r["block"]).decode() for r in rows}
    assert texts[1, "conversion"] == "x\ny\nl" and texts[2, "conversion"] == ""
    assert texts[1, "metadata"] == "title: A & B\r\nlanguage: fr\r\noutlink: http://h/z?a=1&b=2\r\n"
    members = warc.warc_members(records).orderBy("id", "warc_type").collect()
    back = warc.read_members(b"".join(bytes(m.member) for m in members))
    assert json.dumps([{k: str(v) for k, v in b.items()} for b in back], sort_keys=True) == json.dumps(
        [{k: str(bytes(v) if k == "block" else v) for k, v in r.items() if k != "id"} for r in rows], sort_keys=True)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    df = queries.queries()[name](spark, SF_SMALL)
    res = duck(SF_SMALL).execute(oracle_sql()[name])
    cols, rows = [d[0] for d in res.description], res.fetchall()
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(cols, rows)


OPERATORS = {
    "op1": lambda d: substring_dedup.remove_repeated_words(d), "op2": lambda d: line_rules.line_frequency_rules(d),
    "op3": lambda d: language.identify(d, language.fit_dictionaries(d)), "op4": lambda d: jaccard_join.ngram_components(d),
    "op7": lambda d: toxicity.score_toxicity(d, toxicity.fit(d, d.select("doc_id", F.lit(0).alias("toxic")))),
    "op8": lambda d: suffix_dedup.remove_repeated_bytes(d), "op9": lambda d: packing.pack(d, packing.default_tokenizer()),
    "keep": lambda d: jaccard_join.one_of_each(d, 5, 80),
    "op6": lambda d: decontaminate.decontaminated(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(2)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_nulls_repeats_clashes_and_empty(spark, odd, name):
    names = ["did", "th", "kept_text", "score", "component_id", "n_words", "h", "v", "a.b", "part", "ids", "row"]
    rows = [(*r, *["z"] * len(names)) for r in odd[:14]] + [(None,) * (5 + len(names))] * 2 + [(*odd[0], *["z"] * len(names))] * 2
    docs = spark.createDataFrame(rows, DOCS + "".join(f", `{n}` string" for n in names)).repartition(3)
    out = OPERATORS[name](docs)
    got = out.collect()
    assert {"did", "th", "h", "v", "a.b", "row", "doc_id"} <= set(out.columns) and got
    if name not in ("op6", "op9", "keep"):
        assert len(got) == len(rows)
    if name == "keep":
        assert len(got) == len({tuple(r) for r in got}) + 1 and sum(r.doc_id == 1 for r in got) == 1  # the two null rows stay
    assert OPERATORS[name](docs.limit(0)).count() == 0
