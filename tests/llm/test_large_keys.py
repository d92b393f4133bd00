"""A short phrase that many documents hold in contexts of their own: its key
is split, with the same results."""

import numpy as np
import pytest

from ledgerlint.llm import common, repeats, substring_dedup, suffix_dedup
from tests.llm import brute

PHRASE = [f"phrase{i}" for i in range(8)]
DOCS = "doc_id long, text string"


def word_list(rng, n):
    return [f"w{x:07d}" for x in rng.integers(0, 10 ** 7, n)]


@pytest.fixture(scope="module")
def footers():
    """300 texts with one phrase; some also repeat a passage around it, the
    phrase itself over and over, or the whole text."""
    rng = np.random.default_rng(21)
    around = word_list(rng, 30)
    texts = []
    for i in range(300):
        middle = around[:i % 30] + PHRASE + around[i % 30:] if i % 10 == 0 else PHRASE
        texts.append(" ".join(word_list(rng, 25) + middle + word_list(rng, 25)))
    texts += [" ".join(PHRASE * 9), texts[3], None, "", " ".join(PHRASE)]
    return list(enumerate(texts))


def test_words_of_a_large_key(spark, footers):
    docs = spark.createDataFrame(footers, DOCS).repartition(4)
    got = substring_dedup.remove_repeated_words(docs, key_symbols=500).collect()
    whole = substring_dedup.remove_repeated_words(docs).collect()
    assert sorted(got) == sorted(whole)
    want = {r[0]: r[1:3] for r in brute.substring_dedup(footers)}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == want


def test_bytes_of_a_large_key(spark, footers):
    docs = spark.createDataFrame(footers, DOCS).repartition(4)
    got = suffix_dedup.remove_repeated_bytes(docs, key_symbols=5000).collect()
    assert sorted(got) == sorted(suffix_dedup.remove_repeated_bytes(docs).collect())
    want = {r[0]: r[1:4] for r in brute.byte_dedup(footers)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got} == want


@pytest.mark.parametrize("by_word", [True, False])
def test_no_key_fills_more_than_a_block(spark, footers, by_word):
    docs = spark.createDataFrame(footers, DOCS).repartition(4)
    length, gram, most = (20, 6, 500) if by_word else (200, 32, 5000)
    keyed = common.row_keys(docs, "doc_id", "text")
    found = repeats.candidates(keyed, length, gram, by_word)

    def largest(rows):
        pieces = repeats.segment_blocks(keyed, repeats.first_places(rows), length, by_word)
        return pieces.selectExpr("v", f"n + {length - 1} AS s").groupBy("v").sum("s").toPandas()["sum(s)"].max()

    assert largest(found) > 2 * most
    assert largest(repeats.routed(keyed, found, length, gram, by_word, most)) <= most


@pytest.mark.parametrize("by_word", [True, False])
def test_split_follows_distinct_segments(spark, footers, by_word):
    """Twenty and forty copies of the same texts give the split the same rows
    to write; copies keep the results of brute force."""
    length, gram, most = (20, 6, 500) if by_word else (200, 32, 5000)
    rows = []
    for copies in (20, 40):
        docs = [(i * 1000 + c, t) for i, t in footers[:40] for c in range(copies)]
        keyed = common.row_keys(spark.createDataFrame(docs, DOCS).repartition(4), "doc_id", "text")
        found = repeats.candidates(keyed, length, gram, by_word)
        split = repeats.routed(keyed, found, length, gram, by_word, most)
        rows.append(repeats.first_places(split).count())
        assert split.where("v IS NOT NULL AND m > 1").groupBy("did", "th", "at", "n").count().where("count > 1").isEmpty()
        assert split.where("v IS NULL").count() <= found.count()
    assert rows[0] == rows[1] > 0


def test_copies_of_a_large_key(spark, footers):
    docs = [(i * 10 + c, t) for i, t in footers[::6] for c in range(4)] + [(7, footers[12][1]), (7, footers[12][1])]
    frame = spark.createDataFrame(docs, DOCS).repartition(4)
    got = substring_dedup.remove_repeated_words(frame, key_symbols=300).collect()
    want = {(r[0], *r[1:3]) for r in brute.substring_dedup([d for d in docs[:-1]])}
    assert {(r.doc_id, r.n_words, r.n_removed) for r in got} == want
    got = suffix_dedup.remove_repeated_bytes(frame, key_symbols=3000).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == sorted(r[:4] for r in brute.byte_dedup(docs))
